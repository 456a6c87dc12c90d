import zlib

from pyspark.sql import functions as F

from sievelake.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = L.op10_query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.accepted for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def model():
    rows = [("the cat and the dog sat on the mat " * 3, "en"), ("der hund und die katze auf der matte " * 3, "de")] * 40
    return L.train(rows)


def test_texts_without_letters_are_undetermined():
    names, scores, accepted = model().predict(["", "123 !?", "the dog", "DER HUND", "\n"])
    assert names == ["und", "und", "en", "de", "und"]
    assert scores[0] == scores[1] == 0 and not accepted[0] and accepted[2]


def test_predictions_do_not_depend_on_the_batch(monkeypatch):
    texts = ["the dog", "", "katze und hund", "x", "the " * 1000, "日本語"] * 5
    own = model()
    whole = own.predict(texts)
    assert [own.predict([t])[0][0] for t in texts] == whole[0]
    monkeypatch.setattr(L, "BLOCK", 10)
    assert own.predict(texts)[0] == whole[0]


def test_frames_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, "en", "x"), (2, "the cat", "en", "x"), (2, "the cat", None, "x"), (3, "die katze " * 30_000, "de", "x"), (None, "und", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, SCORE string")
    out = L.identify(docs, L.fit(docs, F.lit(True)))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "accepted"] and out.count() == 5
    kept = L.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert L.identify(docs.limit(0), model()).collect() == []
    nothing = L.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} <= {"und"}


def test_stage_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id bigint, text string, lang string")
    assert L.stage(spark, docs, "").count() == 2
