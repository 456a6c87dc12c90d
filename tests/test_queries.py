"""Every registered query of the engine against its SQL in DuckDB."""

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sievelake.operators import hybrid
from sievelake.plans import inputs, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or (isinstance(v, float) and np.isnan(v)) or str(v) in ("<NA>", "NaT"):
                cells.append("null")
            elif isinstance(v, int | float | np.integer | np.floating) and not isinstance(v, bool):
                cells.append(f"{float(v):.9g}")
            else:
                cells.append(str(v))
        rows.append(tuple(cells))
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_without_sql_is_tested_otherwise():
    assert set(QUERIES) - set(SQL) == {"q_diverse", "q_embed", "q_summaries", "q_synthetic_documents", "q_text_search", "q_approximate", "q_sliding"}
    assert set(SQL) <= set(QUERIES)


def words(text):
    return text.lower().split()


def test_diverse_matches_a_plain_greedy_choice(spark):
    from sievelake.plans.inputs import hits

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {}
    for r in hits(spark, SF).orderBy("task_id", "rank").collect():
        found.setdefault(r.task_id, []).append((r.rank, r.doc_id, r.dist))
    want = set()
    for task, rows in found.items():
        taken = []
        while len(taken) < 5 and rows:
            def value(r):
                own = set(words(docs[r[1]]))
                likes = [len(own & t) / len(own | t) if own | t else 0.0 for t in (set(words(docs[x[1]])) for x in taken)]
                return round(0.7 / (1 + r[2]) - 0.3 * max([0.0, *likes]), 9)

            best = max(rows, key=lambda r: (value(r), -r[0]))
            taken.append(best)
            rows = [r for r in rows if r is not best]
            want.add((task, len(taken), best[0], best[1]))
    got = {(r.task_id, r.pick, r["rank"], r.doc_id) for r in QUERIES["q_diverse"](spark, SF).collect()}
    assert got == want


def test_summaries_hold_the_best_sentences(spark):
    import hashlib
    import re

    from sievelake.plans.inputs import hits, tasks

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    asked = {r.task_id: set(words(r.query)) for r in tasks(spark, SF).collect()}
    want = set()
    for r in hits(spark, SF).where("rank <= 5").collect():
        parts = [s for s in re.split(r"[.!?\n]+", docs[r.doc_id]) if s.strip(" ")]
        scored = [(-len(set(words(s)) & asked[r.task_id]), i) for i, s in enumerate(parts)]
        best = sorted(i for _, i in sorted(scored)[:2])
        text = ". ".join(parts[i].strip(" ") for i in best)
        want.add((r.task_id, r.doc_id, hashlib.md5(text.encode()).hexdigest()))
    got = {(r.task_id, r.doc_id, r.summary_md5) for r in QUERIES["q_summaries"](spark, SF).collect()}
    assert got == want


def test_embeddings_have_length_one(spark):
    rows = QUERIES["q_embed"](spark, SF).collect()
    assert len(rows) == 200 and all(r.dimensions == 32 for r in rows)
    assert sum(abs(r.norm - 1) < 1e-3 for r in rows) > 190


def test_synthetic_documents_have_the_asked_lengths(spark):
    rows = QUERIES["q_synthetic_documents"](spark, SF).collect()
    assert len(rows) == 200 and all(100 <= r.chars < 2000 for r in rows)


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_bm25_matches_a_plain_ranking(spark, monkeypatch, block):
    """Equal queries, queries and documents in several rows, no id, no text, ties."""
    monkeypatch.setattr(hybrid, "BLOCK_WORDS", block)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("AbcdefghiJ") * rng.randint(1, 2) for _ in range(n))
    docs = [(i, text(rng.randint(1, 12))) for i in range(40)] + [(3, "zz x"), (None, "c d x"), (None, "y y"), (50, None), (51, ""), (52, "a b"), (53, "b A")]
    asked = [("p", "a b"), ("q", "b  A b"), ("r", "c x dd y"), ("r", "C d"), ("s", "none"), ("t", None), ("u", "")]
    lens = [len(t.split()) for _, t in docs if t is not None]
    posts = {}
    for doc, t in docs:
        for w in (t or "").lower().split():
            n, size = posts.get((w, doc), (0, len(t.split())))
            posts[w, doc] = n + 1, size
    want = set()
    for key in {a for a, _ in asked}:
        words = {w for a, t in asked if a == key for w in (t or "").lower().split()}
        scores = {}
        for (w, doc), (n, size) in posts.items():
            if w in words:
                df = sum(v == w for v, _ in posts)
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                scores[doc] = scores.get(doc, 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / (sum(lens) / len(lens))))
        best = sorted((-round(x, 9), d is None, d or 0) for d, x in scores.items())[:6]
        want |= {(key, i + 1, None if none else d, -x) for i, (x, none, d) in enumerate(best)}
    # the rows that share an id hold no common word, or their length would be open
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {tuple(r) for r in hybrid.bm25(spark.createDataFrame(asked, "task_id string, query string"), docs, 6).collect()}
    assert {r[:3] for r in got} == {r[:3] for r in want}
    assert all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(*[sorted(x, key=lambda r: r[:2]) for x in (got, want)], strict=True))
    assert hybrid.bm25(spark.createDataFrame(asked, "task_id string, query string"), docs.limit(0), 6).collect() == []


def test_a_task_passes_on_k_documents_per_query_at_most():
    """However many documents hold the words that a hybrid search asks for."""
    block = hybrid.Block([("x", ["a", "b"]), ("y", ["b"]), ("z", ["c"])])
    rows = [["a", "b", "a"][: i % 3 + 1] for i in range(600)]
    counted = block.count(pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(rows)], names=["doc_id", "w"]))
    assert [sum(counted["ids"].to_pylist(), []).count(i) for i in range(3)] == [600, 400, 0]
    block.weigh(600, 2.0, {0: 600, 1: 400})
    lens = pa.array([[n] * len(ids) for n, ids in zip(counted["len"].to_pylist(), counted["ids"].to_pylist(), strict=True)])
    posts = pa.RecordBatch.from_arrays([counted["doc_id"], counted["ids"], counted["tfs"], lens], names=["doc_id", "ids", "tfs", "lens"])
    query, _, doc, score = block.best(iter([posts.slice(0, 300), posts.slice(300)]), 4)
    assert query.tolist() == [0] * 4 + [1] * 4 and doc.tolist() == [1, 4, 7, 10] * 2 and (score > 0).all()


def exchanged(df):
    """The columns of each exchange in the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]", plan)


def test_a_search_shuffles_no_vectors(spark):
    """Where documents are too many to be broadcast, only ids meet."""
    at = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(at)
    spark.conf.set(at, -1)
    try:
        found = exchanged(inputs.hits(spark, SF))
    finally:
        spark.conf.set(at, before)
    assert found and not any("embedding" in columns for columns in found)


@pytest.mark.parametrize("most", [1 << 16, 3, 2, 0])
def test_vectors_without_a_document_are_left_out(spark, monkeypatch, most):
    """Three ids of four rows have none; repeated ids, no id."""
    monkeypatch.setattr(inputs, "MOST_LOST", most)
    vectors = spark.createDataFrame([(i, [float(i or 0)]) for i in (1, 2, 2, 3, 7, 8, 8, 9, None)], "doc_id bigint, embedding array<float>")
    docs = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 3, 4, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in inputs.held(vectors, docs).collect()) == [1, 2, 2, 3]
    assert inputs.held(vectors, docs.limit(0)).collect() == []
    assert sorted(r.doc_id for r in inputs.held(vectors.where("doc_id < 4"), docs).collect()) == [1, 2, 2, 3]
