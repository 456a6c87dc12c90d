"""Associations between memories: bounded-hop traversal and dependency closure over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_hops(seeds: DataFrame, edges: DataFrame, hops: int, by: list[str]) -> DataFrame:
    """(by, node, hop) of the nodes that can be reached from each seed, with the fewest hops.

    ``seeds`` has by and node; ``edges`` has src and dst. Each hop is one join with the edges and a
    minimum per node, so a node enters the next hop once.
    """
    reached = seeds.select(*by, "node", F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(*by, F.col("dst").alias("node"))
        fresh = step.distinct().join(reached.select(*by, "node"), [*by, "node"], "left_anti")
        frontier = fresh.withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def similarity_edges(hits: DataFrame, node: str = "task_id") -> DataFrame:
    """Edges from a search of documents for documents: (src, dst, weight)."""
    return hits.select(F.col(node).alias("src"), F.col("doc_id").alias("dst"), (1 / (1 + F.col("dist"))).alias("weight"))


def closure(edges: DataFrame, most: int) -> DataFrame:
    """(src, dst, depth) of all dependencies of a workflow graph up to ``most`` steps, with the least depth."""
    roots = edges.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct()
    return within_hops(roots, edges, most, ["root"]).where("hop > 0").select(F.col("root").alias("src"), F.col("node").alias("dst"), F.col("hop").alias("depth"))
