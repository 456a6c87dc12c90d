import hashlib

from pyspark.sql import functions as F

from sievelake.llm import exact_dedup as E

SCHEMA = "doc_id bigint, text string, keep_id string"
ROWS = [
    (1, "a", "x"), (2, "b", None), (3, "a", None), (4, None, None), (5, "", None), (6, "a", None),
    (7, "long " * 50_000, None), (8, "long " * 50_000, None), (9, "B", None),
]


def brute(rows):
    best, size = {}, {}
    for i, t, *_ in rows:
        t = t or ""
        best[t] = max(best.get(t, -1), i)
        size[t] = size.get(t, 0) + 1
    return {(i, best[t or ""], size[t or ""], i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows}


def result(groups):
    return {(r._id, r._keep, r._n, r._kept, bytes(r._digest).hex()) for r in groups.collect()}


def test_groups_match_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert result(E.exact_groups(docs)) == brute(ROWS)


def test_colliding_digests_do_not_merge_texts(spark, tmp_path):
    rows = [(i, "abcdefgh"[i % 8] * (1 + i % 3)) for i in range(60)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    weak = lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1).cast("string"))
    got = {(r._id, r._keep, r._n, r._kept) for r in E.exact_groups(docs, digest=weak).collect()}
    assert got == {x[:4] for x in brute(rows)}


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(E, "CHECK_ROWS", 8)
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(E.exact_groups(docs)) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert E.exact_groups(docs).collect() == []
    assert E.exact_dedup(docs).collect() == []


def test_repeated_rows_from_files_keep_one(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "a", "p"), (1, "a", "p"), (2, "b", "q"), (None, "b", "r"), (None, "c", "s")], "doc_id bigint, text string, _file string").write.parquet(path)
    out = E.exact_dedup(spark.read.parquet(path))
    assert out.columns == ["doc_id", "text", "_file"]
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == [(-1, "c"), (1, "a"), (2, "b")]


def test_dedup_keeps_columns_and_largest_id(spark):
    out = E.exact_dedup(spark.createDataFrame(ROWS, SCHEMA))
    assert out.columns == ["doc_id", "text", "keep_id"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 5, 6, 8, 9]


def test_no_python_in_the_plan(spark, sf):
    plan = E.op6_query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_equals_sql_on_repeated_and_null_ids(spark, tmp_path):
    import duckdb

    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "a"), (None, "n"), (None, "n"), (3, None), (4, ""), (4, "b"), (5, " a"), (6, "é"), (7, "e\u0301")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, keep_id, group_size, kept, text_sha256"
    want = sorted(map(str, duckdb.sql(f"SELECT {names} FROM ({E.OP6_SQL})").fetchall()))
    got = sorted(str(tuple(r)) for r in E.op6_query(spark, str(tmp_path)).select(*names.split(", ")).collect())
    assert got == want and len(got) == len(rows)
