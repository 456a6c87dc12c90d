import itertools
import random
import zlib

import numpy as np

from sievelake.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def brute_kernel(a, b):
    """All common subsequences of LENGTH characters, each weighted by the stretches it takes."""
    a, b = "\x01" + a, "\x01" + b
    total = 0.0
    for i in itertools.combinations(range(len(a)), T.LENGTH):
        for j in itertools.combinations(range(len(b)), T.LENGTH):
            if all(a[x] == b[y] for x, y in zip(i, j, strict=True)):
                total += T.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_matches_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(30)]
    others = words[::-1]
    got = T.kernel(T.codes(words, 0), T.codes(others, -1))
    want = np.array([brute_kernel(a, b) for a, b in zip(words, others, strict=True)])
    want *= T.DECAY ** (2 * T.LENGTH) / np.array([T.DECAY ** (2 * T.LENGTH)] * len(words))
    scale = got.sum() / want.sum()
    assert np.allclose(got, want * scale, rtol=1e-4)


def test_gaps_and_insertions_are_tolerated():
    marks = T.Landmarks(["idiot", "stupid", "worthless"])
    for word in ("idiot", "id*iot", "stuupid", "wor.thless"):
        assert marks.similarity([word]).max() >= T.FLOOR
    assert marks.similarity(["banana"]).max() == 0
    assert T.words_of("an i d i o t here")[1] == "idiot"
    assert "idiot" in T.windows("i.d.i.o.t")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text, r.toxic) for r in docs.join(labels, "doc_id").collect()]
    learn = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    test = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    score = np.array(T.train(learn).score([t for t, _ in test]))
    y = np.array([y for _, y in test])
    found = score >= T.THRESHOLD
    assert (found & (y == 1)).sum() / y.sum() > 0.8
    assert (found & (y == 0)).sum() / found.sum() < 0.1


def test_degenerate_training():
    assert T.train([]).score(["x", ""]) == [0.0, 0.0]
    assert T.train([("a b c", 1)]).score(["x"]) == [1.0]
    assert T.train([("a b c", 0)]).score(["x"]) == [0.0]


def test_frames_with_nulls_and_long_texts(spark):
    rows = [("you idiot and moron. fine", 1), ("a nice day for all. fine", 0)] * 20
    model = T.train(rows)
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "you idiot and moron", "x"), (3, "you idiot and moron", "x"), (4, "nice day " * 30_000, "x"), (5, "z" * 10_000, "x")],
        "doc_id bigint, text string, SCORE string",
    )
    out = T.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = {r.doc_id: r.score for r in out.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[3] > max(got[1], got[4]) and got[1] == got[2]
    assert T.score(docs.limit(0), model).collect() == []


def test_a_full_memo_does_not_change_scores(monkeypatch):
    model = T.train([("you idiot and moron. fine", 1), ("a nice day for all. fine", 0)] * 20)
    texts = ["idiot", "nice", "moron idiot", "day"]
    whole = model.score(texts)
    monkeypatch.setattr(T, "MEMO", 1)
    assert [model.score([t])[0] for t in texts] == whole


def test_op7_query_on_a_whole_table(spark):
    """Held-out rows by their remainder, predictions by the threshold, and how many of them are right."""
    import zlib

    sf = "/root/testdata/sf0.01"
    rows = T.op7_query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p == t for p, t in held) > 0.9 * len(held) and len(held) > 50
    assert sum(p and not t for p, t in held) <= 0.02 * len(held)


def test_the_landmark_matrix_is_a_kernel_matrix():
    words = ["idiot", "idiots", "idiotic", "moron", "stupid", "stupidity", "x" * 30]
    square = T.Landmarks(words).gram()
    assert np.allclose(np.diag(square), 1) and np.linalg.eigvalsh(square).min() > -1e-6
    assert square[0, 1] > square[0, 3] >= 0 and square[0, 1] > 0.5


def test_counting_the_sample_reads_sizes_not_texts(spark, monkeypatch):
    """The join that counts the labelled rows has no texts in it, and the sample is the one that counting them gives."""
    seen = []

    def sample(rows, id_col, most, *more, **named):
        seen.append((rows, named.get("sizes")))
        return T_sample(rows, id_col, most, *more, **named)

    T_sample = T.spread_sample
    monkeypatch.setattr(T, "spread_sample", sample)
    docs = spark.createDataFrame([(i, None if i == 7 else f"text é {i} " * (i % 5)) for i in range(300)] + [(5, "again")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(0, 400, 2)] + [(6, True), (None, True)], "doc_id bigint, toxic boolean")
    T.fit(docs, labels.selectExpr("doc_id", "cast(toxic as int) as toxic"), 40)
    ((rows, sizes),) = seen
    assert sizes is not None and "text" not in sizes.columns
    count = lambda df, size: df.selectExpr("count(1)", f"sum({size})").first()
    assert tuple(count(sizes, "bytes")) == tuple(count(rows, "octet_length(text)"))
    got = [tuple(r) for r in T_sample(rows, "doc_id", 40, sizes=sizes)]
    assert 0 < len(got) <= 40 and got == [tuple(r) for r in T_sample(rows, "doc_id", 40)]
