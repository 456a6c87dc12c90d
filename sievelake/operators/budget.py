"""Token budgets: what a budget does to a task, and which hits fit into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def within_budget(tokens: Column, budget: Column) -> Column:
    """Tokens left when a context is cut to its budget."""
    return F.least(tokens, budget)


def success_probability(tokens: Column, budget: Column) -> Column:
    """Chance of success: by the share left if the context is cut, else by the budget's utilisation."""
    left = within_budget(tokens, budget)
    kept = X.ratio(left, budget)
    use = X.ratio(tokens, budget)
    cut = F.greatest(F.lit(0.0), 1 - 2 * (1 - kept))
    whole = (
        F.when(use < 0.5, use * 1.5)
        .when((use >= 0.7) & (use <= 1.0), 0.9 + (use - 0.7) / 3)
        .when((use >= 0.5) & (use < 0.7), 0.7 + (use - 0.5))
        .otherwise(0.0)
    )
    return F.when(tokens > budget, cut).otherwise(whole)


def simulate(costs: DataFrame, budgets: list[int]) -> DataFrame:
    """``costs`` (token_cost) against each budget: context_tokens, deviation, deviation_ratio, utilization, success_prob."""
    grid = costs.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("bigint") for b in budgets])))
    tokens, budget = F.col("token_cost"), F.col("budget")
    left = within_budget(tokens, budget)
    return grid.select(
        "*",
        left.alias("context_tokens"),
        (left - budget).alias("deviation"),
        X.ratio(left - budget, budget).alias("deviation_ratio"),
        X.ratio(left, budget).alias("utilization"),
        success_probability(tokens, budget).alias("success_prob"),
    )


def select_prefix(hits: DataFrame, budget: int, by: list[str], most: int | None = None) -> DataFrame:
    """The longest prefix of each group's hits, by rank, whose tokens stay within the budget."""
    ranked = hits.where(F.col("rank") <= most) if most else hits
    running = F.sum("tokens").over(Window.partitionBy(*by).orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used_tokens", running).where(F.col("used_tokens") <= budget)


def _fold(hits: DataFrame, budget: int, by: list[str], order: list[Column]) -> DataFrame:
    """Take a group's hits in order, leaving out each that no longer fits."""
    fields = ["doc_id", "rank", "tokens"]
    item = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *fields)
    packed = hits.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = dict(packed.dtypes)["items"]
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.expr(f"cast(array() as {kind})").alias("taken"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["tokens"] <= budget
        return F.struct(
            F.when(fits, state["used"] + x["tokens"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.array_append(state["taken"], x)).otherwise(state["taken"]).alias("taken"),
        )

    taken = packed.select(*by, F.explode(F.aggregate("items", start, step, lambda s: s["taken"])).alias("x"))
    return taken.select(*by, *[F.col(f"x.{f}") for f in fields])


def select_skipping(hits: DataFrame, budget: int, by: list[str]) -> DataFrame:
    """Hits by rank, skipping each that doesn't fit into what is left. Groups are bounded by the search's k."""
    return _fold(hits, budget, by, [F.col("rank")])


def select_dense(hits: DataFrame, budget: int, by: list[str], relevance: str = "relevance") -> DataFrame:
    """Hits by relevance per token, skipping each that doesn't fit."""
    return _fold(hits, budget, by, [-(F.round(F.col(relevance) / F.col("tokens"), 9)), F.col("rank")])


def fixed_block(hits: DataFrame, blocks: int, by: list[str]) -> DataFrame:
    """Baseline: the first so many hits, whatever their size."""
    return hits.where(F.col("rank") <= blocks)
