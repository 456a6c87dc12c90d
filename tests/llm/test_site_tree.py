import html
import math
import random
import re
import time
from collections import Counter
from xml.etree import ElementTree

import pytest

from sievelake.llm import site_tree as S

CASES = [
    ("", ""),
    ("<p>a<p>b", "a\nb"),
    ("x <b>bold</b> y<div>z &amp; &lt;q&gt; &eacute;&#x41;</div>", "x bold y\nz & <q> éA"),
    ("<ul><li>1<li>2</ul><table><tr><td>a<td>b</table>", "1\n2\na\nb"),
    ("<div class='cookie-notice'>c</div><main><h1>T</h1><div class=comments>no</div><p>yes<script>if(a<b)</script> more</p></main><aside>s</aside>", "T\nyes more"),
    ("<!-- open <p>x", ""),
    ('<p>a<a href="x>y">l</a>', "al"),
    ("a < b & c", "a < b & c"),
    ("<article><header><h1>H</h1></header><p>t</p><footer>f</footer></article><article class='comment'>c</article>", "H\nt"),
    ("<p>open <b>q", "open q"),
    ("<p>one<br>two  \n three</p></div></p>", "one two three"),
    ("<form>f</form><nav>n</nav><header>h</header><p>t</p><style>p{}</style><title>x</title>", "t"),
    ("<p hidden>h</p><p>v</p><div role=navigation>n</div><div id='sidebar-left'>s</div>", "v"),
]


@pytest.mark.parametrize("source, want", CASES)
def test_pages_of_any_shape(source, want):
    assert S.main_text(source, frozenset()) == want


def test_articles_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"

    def want(source):
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [re.sub(r"<br>", " ", p) for p in re.split(r"</?p>|</?h1>", inner)]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
        return "\n".join(p for p in parts if p)

    got = {r.page_id: (r.text, r.n_chars) for r in S.op2_query(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id] == (want(p.html), len(want(p.html)))


def test_repeated_branches_go_without_any_telling_markup(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(n))
    bodies = [(words(20), words(10)) for _ in range(60)]
    pages = [
        (i, f"http://h.example/{i}", f"<div class=t1>Home Contact</div><div class=t2><p>{a}</p><p>{b}</p></div><div class=t3><i>All rights</i></div>")
        for i, (a, b) in enumerate(bodies)
    ]
    got = {r.page_id: r.text for r in S.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"{a}\n{b}" for i, (a, b) in enumerate(bodies)}


def test_one_article_on_many_pages_of_a_host_stays(spark):
    pages = [(i, "http://one.example/", "<article><p>same text</p></article><div class=z9>same foot</div>") for i in range(50)]
    pages += [(100, None, None), (101, "", ""), (102, "nonsense", "<p>alone</p>"), (0, "http://one.example/", "<p>x</p>")]
    docs = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, text int")
    got = [(r.page_id, r.text) for r in S.extract(docs).collect()]
    assert len(got) == len(pages) and (0, "same text") in got and (100, "") in got and (102, "alone") in got
    assert S.extract(docs.limit(0)).collect() == []


def test_deep_and_long_pages():
    assert S.main_text("<div>" * 3000 + "deep" + "</div>" * 3000, frozenset()) == "deep"
    assert len(S.main_text("<p>word</p>" * 50_000, frozenset()).split("\n")) == 50_000
    assert S.main_text("<" * 20_000, frozenset()) == "<" * 20_000


def test_hosts(spark):
    urls = ["https://user:x@A.example:80/p?q#f", None, "nonsense", "//b.example", "http://c.example?x"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [r.h for r in rows.orderBy("i").select(S.host_of(rows.url).alias("h")).collect()]
    assert got == ["a.example", "", "", "b.example", "c.example"]


def test_a_notice_of_its_own_on_each_host_goes(spark):
    """The host's tree decides where it has enough pages; all hosts' tree for hosts with few."""
    body = lambda i: f"<div class=t2><p>text {i} of its own</p></div>"
    pages = [(100 * h + i, f"http://h{h}.example/{i}", f"{body(100 * h + i)}<div class=t3>Notice of host {h}</div><div class=t4>All rights</div>") for h in range(10) for i in range(20)]
    pages += [(5000, "http://small.example/", f"{body(5000)}<div class=t4><i>All rights</i></div>")]
    got = {r.page_id: r.text for r in S.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"text {i} of its own" for i, *_ in pages}


PAGES = [
    ("<p title=it's>Hello</p><p>World's end</p><p>more</p>", "Hello\nWorld's end\nmore"),
    ("<!--><p>a</p><!---><p>b</p><!-- x --!><p>c</p>", "a\nb\nc"),
    ("<form><article><p>Body</p></article></form>", "Body"),
    ("<form><p>all there is</p><select><option>1</option></select></form>", "all there is"),
    ("<article><div class='article-header'><h1>H</h1></div><p>t</p></article>", "H\nt"),
    ("<body class='single no-sidebar'><div class='layout-with-header'><p>text</p><div class=post-comments>c</div></div></body>", "text"),
    ("<div class='post has-comments'><article><p>a</p></article></div><div class=comments><article>c</article></div>", "a"),
    ("<article>teaser</article><div><p>the text is much longer than any teaser</p></div>", "teaser\nthe text is much longer than any teaser"),
    ("<div class=sidebar><article>teaser</article></div><div><p>the text is in a plain element</p></div>", "the text is in a plain element"),
    ("<p class='x' class='ad'>first one counts</p>", "first one counts"),
    ("<p>a</p></ ><p>b</>c</p>", "a\nbc"),
]


@pytest.mark.parametrize("source, want", PAGES)
def test_markup_and_names(source, want):
    assert S.main_text(source, frozenset()) == want


def test_any_nesting_is_linear():
    n = 100_000
    shapes = ["<div>" * n + "x", "<b>x" * n, "<div>" * n + "</span>" * n, "<ul><li><div>" * (n // 3), "<p><table>" * (n // 2), "<svg>" * n, "<table>" + "<td><div>" * n, "<form><article>" * n + "x"]
    for source in shapes:
        began = time.perf_counter()
        S.features(source)
        S.main_text(source, frozenset())
        assert time.perf_counter() - began < 15, source[:30]
    assert S.main_text(shapes[0], frozenset()) == "x"


def plain_tree(pages):
    """{host: paths to remove} from well-formed pages, by the formulas alone."""
    phrases, sequences, shown_on = {}, {}, {}
    for host, source in pages:
        seen = set()

        def walk(element, path):
            path = (*path, f"{element.tag}.{element.get('class', '')}")
            kids = tuple(f"{k.tag}.{k.get('class', '')}" for k in element)
            if kids:
                seen.add(("kids", path, kids))
            for text in [element.text, *(k.tail for k in element)]:
                for phrase in re.split(r"[.!?;:]+(?:\s+|$)|©", " ".join((text or "").split())):
                    if phrase.strip():
                        seen.add(("phrase", path, phrase.strip()))
            for kid in element:
                walk(kid, path)

        walk(ElementTree.fromstring(source.replace("<span>", "").replace("</span>", "")), ())
        for kind, path, what in seen:
            if kind == "kids":
                sequences.setdefault(path, Counter())[what] += 1
            else:
                phrases.setdefault(path, Counter())[what] += 1
                shown_on.setdefault((host, path), Counter())[what] += 1
    words = lambda p: len(p.split())
    entropy = lambda path, some: sum(words(p) * math.log(phrases[path][p]) for p in some) / sum(map(words, some))

    def around(path):
        under = [q for q in phrases if q[: len(path)] == path]
        content = sum(sum(map(words, phrases[q])) * entropy(q, phrases[q]) for q in under) / sum(sum(map(words, phrases[q])) for q in under)
        styles = sequences.get(path, Counter())
        m = sum(styles.values())
        spread = 1 if m < 2 else -sum(c / m * math.log(c / m) for c in styles.values()) / math.log(m)
        rest = 0.9 ** len(styles)
        return -math.log(max(1e-9, (1 - rest) * spread + rest * math.exp(-content)))

    def mixed(own, shown, other):
        return (shown * own + 50 * other) / (shown + 50)

    value, size = {}, {}
    for (host, path), some in shown_on.items():
        everywhere = entropy(path, phrases[path])
        total = sum(words(p) * c for p, c in phrases[path].items())
        everywhere = mixed(everywhere, total, around(path[:-1]) if len(path) > 1 else everywhere)
        size[host, path] = sum(words(p) * c for p, c in some.items())
        value[host, path] = mixed(entropy(path, some), size[host, path], everywhere)
    out = {}
    for host in {h for h, _ in value}:
        own = {p: value[h, p] for h, p in value if h == host}
        total = sum(size[host, p] for p in own)
        least = min(v for p, v in own.items() if size[host, p] >= 0.1 * total)
        out[host] = {p for p, v in own.items() if v - least > -math.log(0.4)}
    return out


def plain_text(source, gone):
    out = []

    def walk(element, path):
        path = (*path, f"{element.tag}.{element.get('class', '')}")
        texts = [element.text]
        for kid in element:
            out_of(texts.pop(), path)
            walk(kid, path)
            texts.append(kid.tail)
        out_of(texts.pop(), path)

    def out_of(text, path):
        if (text or "").split() and path not in gone:
            out.append(" ".join(text.split()))

    walk(ElementTree.fromstring(source), ())
    return "\n".join(out)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_tree_equals_a_plain_one(spark, monkeypatch, broadcast):
    """Noise that only its repetition gives away, inside the article as well; hosts of one page to forty."""
    monkeypatch.setattr(S, "BROADCAST_ROWS", broadcast)
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(999)) for _ in range(n))
    shared = [words(6) for _ in range(5)]
    pages = []
    for h, n in enumerate((40, 25, 10, 3, 1, 1)):
        notice, terms = words(12), words(8)
        for _ in range(n):
            body = "".join(f"<p>{words(rng.randint(5, 30))}. {words(4)}</p>" for _ in range(rng.randint(1, 5)))
            links = "".join(f"<li>{w}</li>" for w in rng.choice(shared).split())
            pages.append((f"h{h}", f"<html><body><ul class='x1'>{links}</ul><div class='x2'><h1>{words(5)}</h1>{body}<div class='x3'>{notice}</div></div>"
                          f"<div class='x4'><span>{terms}</span> &#169; h{h}</div></body></html>"))  # fmt: skip
    pages += [("copies", pages[0][1])] * 12
    gone = plain_tree(pages)
    rows = spark.createDataFrame([(i, f"http://{h}/", s) for i, (h, s) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in S.extract(rows, names=False).collect()}
    # span is inline: it stands in its block
    plain = {i: plain_text(s.replace("<span>", "").replace("</span>", ""), gone[h]) for i, (h, s) in enumerate(pages)}
    assert got == plain
    big = [i for i, (h, _) in enumerate(pages) if h in ("h0", "h1")]
    assert {len(got[i].split("\n")) - pages[i][1].count("<p>") for i in big} == {1}  # headline and paragraphs


def test_the_tree_alone_gives_the_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    with_names = {r.page_id: r.text for r in S.extract(pages).collect()}
    assert {r.page_id: r.text for r in S.extract(pages, names=False).collect()} == with_names
