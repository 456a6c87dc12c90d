"""Exact vector retrieval: k nearest neighbours by squared L2 distance, and contexts made from them.

Queries are a stated set of bounded size: they are shipped to every task, which scans its part of the
pool once in blocks and passes on its k best hits per query. The shuffle so carries k rows per query
and task, whatever the pool's size, and the final ranking is a window over those. Ties are broken by
document id, so ranks are a total order; a pool with fewer documents gives fewer hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Bytes of query vectors shipped to the executors at once; more queries go in further blocks.
BLOCK_BYTES = 64 << 20
#: Distances estimated at once in a task.
BLOCK_CELLS = 1 << 22


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance of two vector columns, in double precision."""
    cells = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + x)


class Nearest:
    """The k best hits of each query of a block, kept while the pool goes by.

    A product of matrices estimates all distances of a piece of the pool; only what the estimate can't rule out is
    computed exactly, so most rows cost a multiplication per dimension and query and nothing else.
    """

    def __init__(self, vectors: np.ndarray, excluded: list, k: int):
        self.vectors, self.k = vectors, k
        self.squares = (vectors**2).sum(axis=1)
        self.skip = np.array([-1 if e is None else e for e in excluded], np.int64)
        self.has_skip = np.array([e is not None for e in excluded])
        self.limit = np.full(len(vectors), np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, id, distance

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        squares = (matrix**2).sum(axis=1)
        guess = squares[:, None] + self.squares[None, :] - 2 * (matrix @ self.vectors.T)
        margin = 1e-9 * (squares.max(initial=0) + self.squares.max(initial=0))
        if self.has_skip.any():
            guess[(ids[:, None] == self.skip[None, :]) & self.has_skip[None, :]] = np.inf
        most = self.limit
        if len(ids) > self.k:
            most = np.minimum(most, np.partition(guess, self.k - 1, axis=0)[self.k - 1])
        row, query = np.nonzero((guess <= most + margin) & np.isfinite(guess))
        dist = ((matrix[row] - self.vectors[query]) ** 2).sum(axis=1)
        query, near, dist = (np.concatenate(x) for x in zip(self.found, (query, ids[row], dist), strict=True))
        order = np.lexsort((near, dist, query))
        query, near, dist = query[order], near[order], dist[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        last = place == self.k - 1
        self.limit[query[last]] = dist[last]
        self.found = (query[kept], near[kept], dist[kept])


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[list, np.ndarray, list]]:
    block, size = [], 0
    for row in queries.toLocalIterator():
        block.append(row)
        size += 8 * len(row[vector])
        if size >= BLOCK_BYTES:
            yield [r[key] for r in block], np.array([r[vector] for r in block], float), [r["_exclude"] for r in block]
            block, size = [], 0
    if block:
        yield [r[key] for r in block], np.array([r[vector] for r in block], float), [r["_exclude"] for r in block]


def top_k(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    key: str = "task_id",
    vector: str = "query_vector",
    doc: str = "doc_id",
    embedding: str = "embedding",
    exclude: str | None = None,
) -> DataFrame:
    """(key, rank, doc_id, dist) of the k nearest documents of each query.

    ``exclude`` names a query column with a document id that doesn't count as its hit.
    """
    spark = pool.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(
        F.col(key), F.col(vector), (F.col(exclude) if exclude else F.lit(None)).cast("bigint").alias("_exclude")
    )
    key_field = asked.schema[key]
    partial = T.StructType([key_field, T.StructField("doc_id", T.LongType()), T.StructField("dist", T.DoubleType())])
    kind = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}[key_field.dataType]
    docs = pool.where(F.col(embedding).isNotNull() & F.col(doc).isNotNull()).select(
        F.col(doc).cast("bigint").alias("doc_id"), F.col(embedding).alias("embedding")
    )
    parts = None
    for block in _blocks(asked, key, vector):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches, shipped=shipped):
            keys, vectors, excluded = shipped.value
            best = Nearest(vectors, excluded, k)
            step = max(1, BLOCK_CELLS // max(1, len(vectors)))
            for batch in batches:
                ids = batch.column(0).to_numpy()
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                matrix = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, vectors.shape[1]))
                for at in range(0, len(ids), step):
                    best.add(ids[at : at + step], matrix[at : at + step])
            query, near, dist = best.found
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, kind).take(pa.array(query)), pa.array(near), pa.array(dist)], names=partial.names
            )

        found = docs.mapInArrow(run, partial)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = spark.createDataFrame([], partial)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("dist", "doc_id")))
    return ranked.where(F.col("rank") <= k).select(key, "rank", "doc_id", "dist")


def sweep(hits: DataFrame, sizes: list[int]) -> DataFrame:
    """Hits for each k of ``sizes``, from one search for the largest."""
    return hits.withColumn("topk", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("rank <= topk")


def mean_similarity(dist: Column) -> Column:
    """Mean of 1 / (1 + distance) over a group's hits."""
    return F.avg(1 / (1 + dist))


def context(rank: Column, text: Column) -> Column:
    """The texts of a group of hits in order of rank, with a blank line between."""
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), text.alias("text"))))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n")


def context_chars(chars: Column) -> Column:
    """Characters of the context of a group of hits, from the texts' lengths alone."""
    return F.sum(chars) + 2 * (F.count(chars) - 1)


def context_cost(hits: DataFrame, docs: DataFrame, by: list[str], model: str = "chars4") -> DataFrame:
    """Token cost of the context of each group; only the lengths of texts (or counts of pieces) are shuffled."""
    if model == "pieces":
        measured = docs.select("doc_id", X.count_pieces(F.col("text")).alias("size"))
        cost = F.sum("size")
    else:
        measured = docs.select("doc_id", F.char_length("text").alias("size"))
        cost = F.ceil(context_chars(F.col("size")) / 4)
    return hits.join(measured, "doc_id").groupBy(*by).agg(cost.cast("bigint").alias("token_cost"))


def noisy(queries: DataFrame, runs: int, sigma: float = 0.01, seed: int = 0, key: str = "task_id", vector: str = "query_vector") -> DataFrame:
    """Each query in ``runs`` variants (run_id) with Gaussian noise per dimension, drawn by key."""
    from ..functions import keyed_random as R

    runs_of = queries.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    cells = F.transform(
        F.col(vector),
        lambda x, i: x.cast("double") + sigma * R.gaussian(seed, F.col(key), F.col("run_id"), i),
    )
    return runs_of.withColumn(vector, cells)
