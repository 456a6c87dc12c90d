import os
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from sievelake.llm import sentence_spans as S
from sievelake.llm.common import shared_dir



@given(st.text(alphabet="ab .!?,\n\té\u3000", max_size=400))
def test_sentences_join_to_the_text(text):
    assert "".join(S.sentences(text)) == text
    found = [re.findall(r"[^ \t\n\v\f\r]+", s) for s in S.sentences(text)]
    assert [w for w in found if w] == [w for w in plain_sentences(text) if w]


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choice(["ab", "c" * 70, "d", "é" * 9]) + str(i % 13) for i in range(3000))
    whole = S.sentences(text)
    monkeypatch.setattr(S, "BLOCK", 100)
    S._powers.clear()
    assert S.sentences(text) == whole
    S._powers.clear()


def test_runs_depend_on_what_follows_only():
    rng = random.Random(3)
    sentence = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(7)) + ". "
    passage = "".join(sentence() for _ in range(6))
    a, b = sentence() + passage, sentence() + sentence() + passage + sentence()
    ha, hb = ({tuple(h) for h in S.Cut([t.encode()]).runs()[3].tolist()} for t in (a, b))
    assert len(ha & hb) == 3


def mark(word, before):
    """The word's bytes as digits, low ones first, those of the word before, and the mixing step."""
    value = lambda w: sum(b * pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i, b in enumerate(w.encode()))
    h = (value(word) + value(before) * 0xD6E8FEB86659FD93) % 2**64
    h ^= h >> 32
    return (h * 0xD6E8FEB86659FD93 % 2**64) >> 32


def plain_sentences(text):
    """(words, characters) of each sentence, token by token."""
    out, words, size = [], [], 0
    tokens = re.findall(r"[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+", text)
    for k, token in enumerate(tokens):
        if token[0] not in " \t\n\v\f\r":
            words.append(token)
            size += len(token)
        elif k and tokens[k - 1][-1] in ".!?,;:|":
            out.append((words, size + len(token)))
            words, size = [], 0
        elif "\n" in token:
            out.append((words, size + len(token)))
            words, size = [], 0
        else:
            size += len(token)
    if size:
        out.append((words, size))
    cut, last = [], ""
    for words, size in out:
        marks = [mark(w, b) for w, b in zip(words, [last, *words], strict=False)]
        last = words[-1] if words else last
        after = set()
        for a in range(len(words) - 7 if len(words) > 8 else 0):
            least = min(marks[a : a + 8])
            after.add(max(i for i in range(a, a + 8) if marks[i] == least))
        part = []
        for i, w in enumerate(words):
            part.append(w)
            if i in after and i < len(words) - 1:
                cut.append(part)
                part = []
        cut.append(part)
    return cut


def brute(rows):
    """Text that is left of each row that loses some, by all pairs of word runs held in a dictionary."""
    first, places = {}, []
    for k, (doc, text) in enumerate(rows):
        units = plain_sentences(text or "")
        for a in range(len(units)):
            for b in range(a + 2, len(units) + 1):
                words = tuple(w for u in units[a:b] for w in u)
                if len(words) >= 25:
                    places.append((words, k, a, b))
                    first[words] = min(first.get(words, ((doc is not None, doc or 0), k, a)), ((doc is not None, doc or 0), k, a))
                    break
    gone = {}
    for words, k, a, b in places:
        if first[words][1:] != (k, a):
            gone.setdefault(k, set()).update(range(a, b))
    return {k: [w for i, u in enumerate(plain_sentences(rows[k][1])) if i not in lost for w in u] for k, lost in gone.items()}


def kept_words(out, rows):
    """Words that are left by the row's number, which goes along in the lang column."""
    return {int(r.lang): r.text.split() for r in out.collect()}


def test_result_matches_brute_force(spark, sf, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    passage = "This passage has quite a few words in it. It goes on for a while. There are several sentences. Each one is short, and plain. Then it ends."
    rows += [(10_000 + i, f"Text number {i}. {passage} And then it ends with {i}.") for i in range(30)]
    rows += [(20_000, None), (20_001, ""), (20_002, "One sentence."), (20_003, (passage + " ") * 2000), (20_004, "word " * 5000), (20_005, "x" * 100_000)]
    rows += [(None, f"No id {i}. {passage}") for i in range(3)] + [(10_001, "Again with an id. " + passage)]
    docs = spark.createDataFrame([(*r, str(k), "c") for k, r in enumerate(rows)], "doc_id bigint, text string, lang string, n_removed string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    out = S.remove_spans(spark.read.parquet(str(tmp_path / "d")))
    got, want = kept_words(out, rows), brute(rows)
    assert got == want
    assert len([k for k in want if rows[k][0] and 10_000 <= rows[k][0] < 20_000]) == 31  # the first one without an id keeps the passage
    assert out.columns.count("n_removed") == 1


def test_rows_of_one_id_keep_what_repeats_nowhere(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" + "." * (i % 9 == 8) for i in range(60))
    shared = text()
    rows = [(1, shared), (2, shared), (2, text()), (None, text()), (None, text())]
    out = S.remove_spans(spark.createDataFrame([(*r, str(k)) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string"))
    assert [r.lang for r in out.collect()] == ["1"]


def test_every_long_repeat_inside_running_text_is_found(spark):
    """Passages of fifty words without any mark, in texts without any."""
    rng = random.Random(6)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(n))
    rows = []
    for i in range(60):
        passage = words(50)
        rows += [(2 * i, f"{words(rng.randint(0, 40))} {passage} {words(30)}"), (2 * i + 1, f"{words(rng.randint(0, 40))} {passage} {words(20)}")]
    out = S.remove_spans(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id for r in out.collect()} == {2 * i + 1 for i in range(60)}


def test_removed_stretches_name_what_went(spark):
    passage = "one two three four five six seven. eight nine ten eleven twelve thirteen. a b c d e f g h i j. k l m n."
    original = "Before it all. " + passage + " After it all."
    docs = spark.createDataFrame([(1, passage), (2, original)], "doc_id bigint, text string")
    (row,) = S.remove_spans(docs).collect()
    cut = "".join(original[s.begin : s.end] for s in row.removed)
    assert row.doc_id == 2 and len(row.text) + len(cut) == len(original) and row.text == "Before it all. After it all."
    assert S.remove_spans(docs.limit(0)).collect() == []


def test_query_gives_every_document(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = S.op3_query(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.text == docs[r.doc_id] and not r.removed for r in out if not r.n_removed)
    assert all(r.n_sentences == len(S.sentences(docs[r.doc_id] or "")) for r in out)


def test_documents_that_lose_nothing_come_out_as_they_were(spark):
    passage = "one two three four five six seven. eight nine ten eleven twelve thirteen. a b c d e f g h i j. k l m n."
    rows = [(1, passage), (2, "Before é it all. " + passage + " After."), (3, "x "), (3, None), (None, ""), (5, " \n "), (5, "One. Two\n three ")]
    out = S.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.n_sentences == len(S.sentences({1: passage, 2: rows[1][1]}.get(r.doc_id, r.text or ""))) for r in out)
    assert sorted((r.doc_id or 0, r.text or "", r.text is None, r.n_removed > 0) for r in out) == [
        (0, "", False, False), (1, passage, False, False), (2, "Before é it all. After.", False, True), (3, "", True, False),
        (3, "x ", False, False), (5, " \n ", False, False), (5, "One. Two\n three ", False, False),
    ]


def bytes_under(path):
    return sum(os.path.getsize(os.path.join(where, f)) for where, _, files in os.walk(path) for f in files)


def test_disk_stays_within_its_budget_even_if_nothing_is_cleaned(spark, tmp_path):
    """All that is shuffled or written to the shared folder, against four times an input of documents and their copies."""
    once = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    once.union(once.selectExpr("doc_id + 1000000", "text")).coalesce(1).write.parquet(str(tmp_path / "d"))
    shared = shared_dir(spark).removeprefix("file://")

    def used():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return bytes_under(shared) + spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = used()
    S.deduplicated(spark.read.parquet(str(tmp_path / "d"))).write.format("noop").mode("overwrite").save()
    times = (used() - before) / bytes_under(tmp_path / "d")
    assert 1 < times < 4


def test_places_in_many_blocks_match_brute_force(spark, tmp_path):
    """Rows of one id in several blocks, extreme ids, and tasks that begin within a block's group of rows."""
    rng = random.Random(8)
    passages = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" + "." * (i % 9 == 8) for i in range(40)) for _ in range(60)]
    ids = [None, -(2**63) + 1, -1, 0, 1, 300, 70_000, 2**63 - 1]
    rows = [(rng.choice(ids), f"Row {k} {k * k}. {rng.choice(passages)} {rng.choice(passages)}") for k in range(900)]
    rows[400:560] = [(7, None if k % 2 else "Short.") for k in range(160)]
    docs = spark.createDataFrame([(*r, str(k)) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    docs.coalesce(1).write.option("parquet.block.size", 20_000).option("parquet.page.size.row.check.min", 10).parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        read = spark.read.parquet(str(tmp_path / "d"))
        every = S.deduplicated(read)
        assert read.rdd.getNumPartitions() > 4
        got = {int(r.lang): r for r in every.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = brute(rows)
    assert {k: r.text.split() for k, r in got.items() if r.n_removed} == want
    assert all(r.text == rows[k][1] for k, r in got.items() if k not in want) and len(got) == len(rows)
