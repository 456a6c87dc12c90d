"""HTML extraction by a site style tree.

Every page is read into a tree of elements. The trees of one host are merged: elements with the same
presentation path (tag and class, id or role of the element and its ancestors) are one node of the
site style tree. All elements go into it, menus and articles alike.

A content node's features are the phrases of the text that stands in it. A phrase that c pages show
at that node has entropy log(c); a node's entropy is the mean over its different phrases, by words, and
its importance e to the power of minus that: 1 where every page has phrases of its own, 1/c where
each stands on c pages. Phrases are counted over the pages of all hosts, so what a host repeats and what many
hosts repeat both tell, and a host with a single page borrows from the rest. A presentation node's features are
the sequences of its child elements; its importance is the entropy of their distribution as a
share of the highest possible. Both are combined up the tree: of an element with l sequences the
presentation counts ``1 - DECAY**l`` and the content of its whole branch the rest.

What little a node shows on a host is not left to speak alone: its entropy is a mean with that of
the node on all hosts, and this with that of the branch around it, which count as ``BORROWED`` words.
A node is removed from a host's pages if its importance is under ``LEAST_IMPORTANCE`` times that of the
most important node that holds a tenth of the host's text. So pages that are copies of each other lose
nothing by that.

Not everything that isn't the main text repeats: adverts and reader comments may be different on
each page. So elements and names that stand for menus, headers, footers, sidebars, notices, adverts,
forms and reader comments are removed, too (``names=False`` leaves all to the tree). A name never
counts on ``html`` or ``body``, nor where it only says what a layout has (``no-sidebar``, ``with-header``),
nor for the header of an article; and if nothing else is left, or they hold the main element and that half of the
text, forms and named elements count as plain wrappers. Where an element that stands for the main content
(``article`` or ``main``) holds at least half of the text that is left, only what stands in it is kept.

What is left is the text: references decoded, white space within a block turned into one space, blocks
joined by a line break in page order. Markup may be broken: end tags may be missing or stand alone, quotes,
comments and elements may be unclosed. From ``DEPTH`` levels on elements share a node. Null html counts as
empty, and an empty page gives an empty text. A page without url belongs to the host ''. Rows that repeat an
id are pages of their own. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, discard, written

#: Nodes below this share of the importance of a host's main nodes are removed.
LEAST_IMPORTANCE = 0.4
#: Share of a host's text that a node must hold to be the measure for the others.
MAIN_SHARE = 0.1
#: Words that the entropy of the same node on all hosts, or of the branch around it, counts for.
BORROWED = 50.0
#: Weight of the content under an element by the number of its child sequences.
DECAY = 0.9
#: Levels of the tree that are told apart.
DEPTH = 64
#: Removed nodes that are broadcast at most (with the host's name, under 100 bytes each); more are joined page by page.
BROADCAST_ROWS = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style title noscript template iframe object svg math canvas audio video".split())
#: Elements whose content the tokeniser must not read as markup.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br".split()
)
#: Elements that stand for other things than the main content.
NOISE = frozenset("nav header footer aside form button select textarea input dialog menu".split()) | HIDDEN
MAIN = frozenset(("article", "main"))
NOISE_NAMES = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|footer|masthead|"
    r"side-?bar\w*|aside|widget\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|comments?|comment-?list|disqus|replies|reply|discussion|share|sharing|social|related|recommended|"
    r"pagination|pager|search|form|hidden|copyright|disclaimer|toolbar|tags|meta)(?=$|[_-])"
)
#: Names that only say what a layout has, and those of the head of an article.
LAYOUT_NAMES = re.compile(r"(?:^|[_-])(?:no|without|with|has|have|layout|wrap|wrapper|container)(?=$|[_-])|(?:^|[_-])(?:article|post|entry|story|content)[_-](?:header|meta)$")
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: A start tag of the key's kind ends an open element of these kinds (within the nearest of the last ones).
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "p": (("p",), ("table", "td", "th", "button", "object")),
}

_markup = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|\Z)",
    re.S,
)
_attribute = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")
_telling = re.compile("class|id|role|itemprop|hidden", re.I)
_digits = re.compile(r"\d{3,}")
_phrase = re.compile(r"[.!?;:]+(?:\s+|\Z)|\s*[©·|•]\s*")

NEUTRAL, WRAPPER, NOISY, CENTRAL = 0, 1, 2, 3


def noisy_name(names: str) -> bool:
    return any(NOISE_NAMES.search(n) and not LAYOUT_NAMES.search(n) for n in names.lower().split())


def prior(tag: str, names: dict[str, str], in_main: bool) -> int:
    """What the presentation of an element says about its content: WRAPPER may be noise or hold the page."""
    if tag in NOISE and not (tag == "header" and in_main):
        return WRAPPER if tag == "form" else NOISY
    if names and tag not in ("html", "body"):
        if "hidden" in names or names.get("role", "").lower() in NOISE_ROLES:
            return NOISY
        if noisy_name(names.get("class", "")) or noisy_name(names.get("id", "")):
            return WRAPPER
        if names.get("role", "").lower() == "main" or names.get("itemprop", "").lower() == "articlebody":
            return CENTRAL
    return CENTRAL if tag in MAIN else NEUTRAL


_closing: dict[str, re.Pattern] = {}


def closing(tag: str) -> re.Pattern:
    """Finds the end tag of an element; only for the few elements whose content is skipped or taken raw."""
    if tag not in _closing:
        _closing[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
    return _closing[tag]


class Element:
    __slots__ = ("tag", "node", "parent", "depth", "noise", "central", "kids", "block")

    def __init__(self, tag: str, node: int, parent: Element | None, noise: int, central: bool):
        self.tag, self.node, self.noise, self.central, self.kids = tag, node, noise, central, 0
        self.parent, self.depth, self.block = parent, 0, self


class Page:
    """Blocks of a page in order, each with its element, and the child sequences of its elements."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Element, str]] = []
        self.sequences: list[tuple[int, int]] = []
        self.text: list[str] = []
        self.open = [Element("", 0, None, NEUTRAL, False)]
        #: Places of the open elements of each kind.
        self.at: dict[str, list[int]] = {}
        self.block_of = self.open[0]
        at = 0
        find = _markup.search
        skipped: dict[str, int] = {}  # elements that are closed nowhere after this place
        while m := find(source, at):
            if m.start() > at:
                self.characters(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in HIDDEN:
                # skipped as a whole, so that a block goes on after it; unclosed, a script or style lasts to the end
                close = None if tag in skipped else closing(tag).search(source, at)
                if not close:
                    skipped[tag] = at
                if close or tag in RAW:
                    at = close.end() if close else len(source)
            else:
                self.start(tag, m[3])
                if tag in RAW:
                    close = closing(tag).search(source, at)
                    self.characters(source[at : close.start() if close else len(source)])
                    at = close.end() if close else len(source)
                    self.end(tag)
        if at < len(source):
            self.characters(source[at:])
        self.cut(1)

    def characters(self, raw: str) -> None:
        if not self.text:
            self.block_of = self.open[-1].block
        self.text.append(raw)

    def flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            if text:
                self.blocks.append((self.block_of, text))

    def cut(self, to: int) -> None:
        """Close all elements from a place on."""
        self.flush()
        while len(self.open) > to:
            element = self.open.pop()
            self.at[element.tag].pop()
            if element.kids:
                self.sequences.append((element.node, element.kids))

    def last(self, tags: tuple) -> int:
        """Place of the innermost open element of these kinds, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.characters(" ")
            return
        if tag not in INLINE:
            self.flush()
            self.close("p")
        if tag in CLOSES and tag != "p":
            self.close(tag)
        if tag in VOID:
            return
        names = {}
        if attributes and _telling.search(attributes):
            for m in _attribute.finditer(attributes):
                names.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
        parent = self.open[-1]
        kind = prior(tag, names, parent.central)
        element = Element(tag, parent.node, parent, max(parent.noise, kind) if kind in (WRAPPER, NOISY) else parent.noise, parent.central or kind == CENTRAL)
        element.depth = parent.depth + 1
        label = _digits.sub("#", f"{tag} {names.get('class', '')} {names.get('id', '')} {names.get('role', '')}")
        if element.depth <= DEPTH:
            element.node = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), parent.node) >> 1
        if tag in INLINE and element.noise == parent.noise:
            element.block = parent.block
        else:
            self.flush()
            parent.kids = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), parent.kids) >> 1 | 1
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(element)

    def close(self, tag: str) -> None:
        """What the start of an element closes."""
        kinds, within = CLOSES[tag]
        place = self.last(kinds)
        if place and place > self.last(within):
            self.cut(place)

    def end(self, tag: str) -> None:
        places = self.at.get(tag)
        if not places:
            if tag not in INLINE:
                self.flush()
            return
        k = places[-1]
        if tag in INLINE and all(e.block is not e for e in self.open[k:]):
            for element in self.open[k:]:
                self.at[element.tag].pop()
            del self.open[k:]
        else:
            self.cut(k)


def host_of(url: Column) -> Column:
    """The host of an absolute url, lower-cased; '' where there is none."""
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host_of(F.col("url").cast("string")).alias("host"),
    )


def phrases(text: str) -> list[tuple[int, int]]:
    """(hash, words) of the phrases of a block."""
    out = []
    for phrase in _phrase.split(text):
        if n := len(phrase.split()):
            out.append((xxhash.xxh64_intdigest(phrase.encode("utf-8", "replace")) >> 1, n))
    return out


#: Kinds of features: a phrase of a node, a child sequence of it, a node with text under it, its parent.
PHRASE, SEQUENCE, UNDER, PARENT = range(4)


def features(source: str) -> set[tuple[int, int, int, int]]:
    """(node, kind, feature, words) of a page, each once."""
    page = Page(source)
    out = {(node, SEQUENCE, kids, 0) for node, kids in page.sequences}
    known: set[int] = set()
    for element, text in page.blocks:
        out.update((element.node, PHRASE, h, n) for h, n in phrases(text))
        if element.node not in known:
            known.add(element.node)
            up = element
            while up.depth > DEPTH:
                up = up.parent
            while up.parent is not None:
                out.add((up.node, UNDER, element.node, 0))
                out.add((up.node, PARENT, up.parent.node, 0))
                up = up.parent
    return out


def site_features(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, words, c): on how many pages of a host a node shows a feature."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                counts: Counter = Counter()
                for source, host in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    counts.update([(host if kind == PHRASE else "", node, kind, f, n) for node, kind, f, n in features(source)])
                keys = list(counts)
                columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(list(counts.values()), pa.int64())], names=["host", "node", "kind", "feature", "words", "c"]
                )

    found = pages.mapInArrow(run, "host string, node bigint, kind int, feature bigint, words bigint, c bigint")
    return found.groupBy("host", "node", "kind", "feature", "words").agg(F.sum("c").alias("c"))


def removed_nodes(tree: DataFrame) -> DataFrame:
    """(host, node) of the nodes to remove, from the features of the site style tree."""
    of_host = tree.where(F.col("kind") == PHRASE)
    overall = of_host.groupBy("node", "feature", "words").agg(F.sum("c").alias("pages"))
    shown = [F.sum(F.col("words") * F.col("c")).alias("shown"), (F.sum(F.col("words") * F.log("pages")) / F.sum("words")).alias("entropy")]
    own = of_host.join(overall, ["node", "feature", "words"]).groupBy("host", "node").agg(*shown)
    whole = overall.withColumn("c", F.col("pages")).groupBy("node").agg(F.sum("words").alias("words"), *shown)
    whole = written(whole, "site-nodes")
    # presentation: entropy of the child sequences of a node as a share of the highest possible
    styles = tree.where(F.col("kind") == SEQUENCE).groupBy("node", "feature").agg(F.sum("c").alias("c")).groupBy("node").agg(
        F.count(F.lit(1)).alias("styles"), F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc")
    )
    spread = F.when(F.col("m") < 2, 1.0).otherwise(1 - F.col("clogc") / F.col("m") / F.log("m"))
    styles = styles.select("node", F.pow(F.lit(DECAY), "styles").alias("rest"), spread.alias("spread"))
    # content of the branch under a node, and both combined
    under = tree.where(F.col("kind") == UNDER).select("node", F.col("feature").alias("leaf")).distinct()
    branch = under.join(whole.withColumnRenamed("node", "leaf"), "leaf").groupBy("node").agg((F.sum(F.col("words") * F.col("entropy")) / F.sum("words")).alias("entropy"))
    rest = F.coalesce("rest", F.lit(1.0))
    both = (1 - rest) * F.coalesce("spread", F.lit(0.0)) + rest * F.exp(-F.col("entropy"))
    around = branch.join(styles, "node", "left").select(F.col("node").alias("parent"), (-F.log(F.greatest(both, F.lit(1e-9)))).alias("around"))
    parents = tree.where(F.col("kind") == PARENT).select("node", F.col("feature").alias("parent")).distinct()
    mixed = lambda own, up: (F.col("shown") * F.col(own) + BORROWED * up) / (F.col("shown") + BORROWED)
    up = parents.join(around, "parent").select("node", "around")
    every = whole.join(up, "node", "left").select("node", mixed("entropy", F.coalesce("around", "entropy")).alias("everywhere"))
    nodes = written(own.join(every, "node").select("host", "node", "shown", mixed("entropy", F.col("everywhere")).alias("entropy")), "site-importance")
    total = nodes.groupBy("host").agg(F.sum("shown").alias("total"), (F.sum(F.col("shown") * F.col("entropy")) / F.sum("shown")).alias("mean"))
    large = nodes.join(total, "host").groupBy("host").agg(
        F.coalesce(F.min(F.when(F.col("shown") >= MAIN_SHARE * F.col("total"), F.col("entropy"))), F.min("mean")).alias("least")
    )
    return nodes.join(large, "host").where(F.col("entropy") - F.col("least") > -math.log(LEAST_IMPORTANCE)).select("host", "node")


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """(page_id, url, text) of every page; without ``names`` the tree alone decides."""
    bounded_batches(pages.sparkSession)
    rows = page_rows(pages)
    tree = written(site_features(rows), "site-tree")
    low = written(removed_nodes(tree), "removed-nodes")
    discard(tree)
    n_low = low.count()
    if n_low <= BROADCAST_ROWS:
        # nodes of templates, not of pages, and a checked number of them
        per_host = low.groupBy("host").agg(F.collect_list("node").alias("low"))
        rows = rows.join(F.broadcast(per_host), "host", "left").select("page_id", "url", "html", "low")
    else:
        rows = with_own_nodes(rows, low)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                texts = []
                for source, low in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    texts.append(main_text(source, frozenset(low or ()), names))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
                )

    return rows.mapInArrow(run, "page_id bigint, url string, text string")


def with_own_nodes(rows: DataFrame, low: DataFrame) -> DataFrame:
    """``rows`` with the removed nodes that a page itself has, joined by the digest of the page."""
    keyed = rows.withColumn("digest", F.sha2(F.concat_ws("\n", "host", "html"), 256))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "html"):
                found = []
                for digest, host, source in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    found += [(digest, host, node) for node in {e.node for e, _ in Page(source).blocks}]
                kinds = (pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names=["digest", "host", "node"])

    nodes = keyed.select("digest", "host", "html").mapInArrow(run, "digest string, host string, node bigint").distinct()
    own = nodes.join(low, ["host", "node"], "left_semi").groupBy("digest").agg(F.collect_list("node").alias("low"))
    return keyed.join(own, "digest", "left").select("page_id", "url", "html", "low")


def size(blocks: list[tuple[Element, str]]) -> int:
    return sum(len(t) for _, t in blocks)


def main_text(source: str, low: frozenset, names: bool = True) -> str:
    """Text of a page without the branches of low importance."""
    blocks = Page(source).blocks
    if names:
        clear = [(e, t) for e, t in blocks if e.noise == NEUTRAL]
        wrapped = [(e, t) for e, t in blocks if e.noise < NOISY]
        inside = [(e, t) for e, t in wrapped if e.central]
        if not clear or inside and not any(e.central for e, _ in clear) and 2 * size(inside) >= size(wrapped):
            clear = wrapped
        blocks = clear
    left = [(e, t) for e, t in blocks if e.node not in low]
    if names:
        main = [(e, t) for e, t in left or blocks if e.central]
        if 2 * size(main) >= size(left or main):
            left = main or left
    return "\n".join(t for _, t in left)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
