"""Query hardness, the choice between a fast and a heavy plan, and what it costs and gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Words that make a query count as hard or as easy.
HARD_WORDS = ["complex", "optimize", "advanced", "recursive", "distributed", "scalable", "performance", "efficient", "algorithm", "architecture"]
EASY_WORDS = ["what", "how", "explain", "difference", "example", "simple"]
THRESHOLD = 0.5


def hardness(query: Column, draw: Column | float = 0.5) -> Column:
    """Hardness in [0, 1]; ``draw`` is the uniform term, its mean by default."""
    own = X.word_set(query)
    hard = X.overlap(own, F.array(*map(F.lit, HARD_WORDS)))
    easy = X.overlap(own, F.array(*map(F.lit, EASY_WORDS)))
    long = F.least(F.size(X.words(query)) / 20, F.lit(1.0))
    return X.clamp(0.5 * (hard / (hard + easy + 1)) + 0.3 * long + 0.2 * (F.lit(draw) if isinstance(draw, float) else draw))


def hardness_class(h: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(h >= threshold, "hard").otherwise("easy")


def plan(h: Column) -> Column:
    """The plan for a hardness: strategy, topk and cost multiplier. Class and strategy follow from one draw."""
    heavy = h >= THRESHOLD
    return F.struct(
        F.when(heavy, "heavy").otherwise("fast").alias("strategy"),
        F.when(heavy, 20).otherwise(5).alias("topk"),
        F.when(heavy, 2.0).otherwise(0.5).alias("multiplier"),
        h.alias("hardness"),
    )


def planned(tasks: DataFrame, query: str = "query", draw: Column | float = 0.5) -> DataFrame:
    h = hardness(F.col(query), draw)
    return tasks.withColumn("hardness", h).withColumn("plan", plan(F.col("hardness"))).withColumn("hardness_class", hardness_class(F.col("hardness")))


def execute(tasks: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of each planned task, from one ranked search: as many as its plan asks for."""
    return tasks.join(hits, "task_id").where(F.col("rank") <= F.col("plan.topk"))


def success_probability(chars: Column, h: Column, strategy: Column) -> Column:
    """Chance of success by characters retrieved, hardness and strategy ("fixed" counts as not heavy)."""
    return (
        F.when(strategy == "heavy", F.when(chars > 5000, 0.8 + 0.2 * h).otherwise(0.3 + 0.2 * h))
        .when(chars > 2000, 0.9 - 0.2 * h)
        .otherwise(0.6 - 0.2 * h)
    )


def compare(tasks: DataFrame, hits: DataFrame, docs: DataFrame, fixed: int = 10) -> DataFrame:
    """Adaptive plan against a fixed top-k: cost and success of both, savings and improvement, per task.

    One pass over one ranked search; the chances of success stand for their means.
    """
    sized = hits.join(docs.select("doc_id", F.char_length("text").alias("chars")), "doc_id")
    both = tasks.join(sized, "task_id")

    def total(most: Column) -> tuple[Column, Column]:
        inside = F.col("rank") <= most
        n = F.count(F.when(inside, 1))
        chars = F.coalesce(F.sum(F.when(inside, F.col("chars"))), F.lit(0)) + F.greatest(F.lit(0), 2 * (n - 1))
        return chars, F.ceil(chars / 4).cast("bigint")

    own_chars, own_cost = total(F.col("plan.topk"))
    fixed_chars, fixed_cost = total(F.lit(fixed))
    by = ["task_id", "task_type", "query", "hardness", "hardness_class", "plan"]
    out = both.groupBy(*by).agg(
        own_chars.alias("own_chars"), own_cost.alias("adaptive_cost"), fixed_chars.alias("fixed_chars"), fixed_cost.alias("naive_cost")
    )
    out = out.select(
        "task_id", "task_type", "query", "hardness", "hardness_class",
        F.col("plan.strategy").alias("adaptive_strategy"), F.col("plan.topk").alias("adaptive_topk"),
        "adaptive_cost", (F.col("adaptive_cost") * F.col("plan.multiplier")).alias("estimated_cost"),
        success_probability(F.col("own_chars"), F.col("hardness"), F.col("plan.strategy")).alias("adaptive_success"),
        "naive_cost",
        success_probability(F.col("fixed_chars"), F.col("hardness"), F.lit("fixed")).alias("naive_success"),
        (F.col("naive_cost") - F.col("adaptive_cost")).alias("cost_savings"),
    )
    return out.withColumn("success_improvement", F.col("adaptive_success") - F.col("naive_success"))
