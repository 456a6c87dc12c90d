"""The base relations of the registered queries, as DataFrames and as SQL.

Tasks are the embeddings whose id is divisible by fifty: their text queries are the benchmark items in turn
and their type follows from the label. The pool is documents joined to embeddings by id; a task's own
document is no hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..sources.tables import table

EVERY = 50
TOPK = [5, 10, 20]
BUDGETS = [500, 1000, 2000, 4000, 8000, 16000]
#: Ids of vectors without a document that are shipped to every task.
MOST_LOST = 1 << 16


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    n_items = b.agg(F.count(F.lit(1)).alias("n_items"))
    e = e.crossJoin(F.broadcast(n_items)).withColumn("item_id", (F.col("vec_id") / EVERY).cast("bigint") % F.col("n_items"))  # one row
    kind = F.when(F.col("label") % 3 == 0, "code").when(F.col("label") % 3 == 1, "sql").otherwise("dialog")
    return e.join(b, "item_id").select(
        F.concat(F.lit("task_"), F.col("vec_id")).alias("task_id"), "query", kind.alias("task_type"),
        F.col("embedding").alias("query_vector"), "vec_id", "label",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) over all documents: each leads to the one with half its number, as if derived from it."""
    d = table(spark, sf_dir, "documents").where("doc_id > 0")
    return d.select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 2).alias("dst"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"]).select("doc_id", "text", "lang", "source", "embedding", "label")


def held(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of ``vectors`` whose doc_id is that of a document.

    Only ids are shuffled: those without a document are told to every task. Where they are more than MOST_LOST, the
    vectors are joined themselves.
    """
    ids = documents.select("doc_id")
    lost = vectors.where("doc_id IS NOT NULL").select("doc_id").join(ids, "doc_id", "left_anti").limit(MOST_LOST + 1).collect()
    if len(lost) > MOST_LOST:
        return vectors.join(ids, "doc_id", "left_semi")
    kept = vectors.where("doc_id IS NOT NULL")
    if not lost:
        return kept
    named = vectors.sparkSession.createDataFrame(lost, kept.select("doc_id").schema)
    return kept.join(F.broadcast(named), "doc_id", "left_anti")


def hits(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieval.top_k(tasks(spark, sf_dir), held(vectors, table(spark, sf_dir, "documents")), k, exclude="vec_id")


TASKS_SQL = f"""
tasks AS (
    SELECT 'task_' || e.vec_id AS task_id, b.text AS query,
           CASE e.label % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'sql' ELSE 'dialog' END AS task_type,
           e.embedding AS query_vector, e.vec_id, e.label
    FROM embeddings e JOIN benchmark b ON b.item_id = (e.vec_id // {EVERY}) % (SELECT count(*) FROM benchmark) WHERE e.vec_id % {EVERY} = 0
)"""
HITS_SQL = (
    TASKS_SQL
    + """,
pool AS (
    SELECT d.doc_id, d.text, d.lang, d.source, e.embedding, e.label
    FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
),
distances AS (
    SELECT t.task_id, p.doc_id,
           list_sum(list_transform(list_zip(p.embedding, t.query_vector), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS dist
    FROM tasks t CROSS JOIN pool p WHERE p.doc_id <> t.vec_id
),
hits AS (
    SELECT * FROM (
        SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY dist, doc_id)::INT AS rank, doc_id, dist FROM distances
    ) WHERE rank <= 20
)"""
)
COSTS_SQL = (
    HITS_SQL
    + """,
costs AS (
    SELECT h.task_id, t.task_type, k.topk, ceil((sum(length(d.text)) + 2 * (count(*) - 1)) / 4)::BIGINT AS token_cost
    FROM hits h JOIN (VALUES (5), (10), (20)) AS k(topk) ON h.rank <= k.topk
    JOIN documents d USING (doc_id) JOIN tasks t USING (task_id)
    GROUP BY ALL
)"""
)
