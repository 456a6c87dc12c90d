import random

import corpus_pipeline as C


def test_stages_and_planted_cases(spark, tmp_path):
    """Against a plain version on a small corpus: copies, near copies, leaks and unreadable texts go, the rest stays."""
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(80))
    item = "an item of the benchmark that nobody should train on at all"
    clean = [(i, text(), "en") for i in range(60)]
    near = []
    for i, t, lang in clean[:10]:
        words = t.split()
        words[70] = "changed"
        near.append((300 + i, " ".join(words), lang))
    rows = clean + [(100 + i, t, lang) for i, t, lang in clean[20:30]] + near
    rows += [(400, text() + " " + item + " " + text(), "en"), (500, "12345 !!", "en"), (501, None, "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = C.run(spark, str(tmp_path))
    left = {r.doc_id for r in out.collect()}
    want = {i for i, *_ in clean[:20]} | {100 + i for i in range(20, 30)} | {i for i, *_ in clean[30:]}
    assert left == want
    assert out.where("not round_trip").count() == 0 and [n for n, _ in C.STAGES][0] == "language ID"


def test_whole_tables(spark, sf):
    out = C.run(spark, sf)
    assert 0 < out.count() <= 200 and set(spark.read.parquet(f"{sf}/documents.parquet").columns) <= set(out.columns)
