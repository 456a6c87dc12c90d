"""A declarative context query: a small plan representation, a builder, a cost-based choice and execution."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget as B
from ..operators import graph, hybrid, retrieval


@dataclass(frozen=True)
class Plan:
    """What a context query computes; immutable, and written to traces as JSON."""

    topk: int = 20
    budget: int = 1000
    selection: str = "prefix"  # or "skip", "dense"
    hops: int = 0
    prune: bool = False
    sentences: int = 0
    token_model: str = "chars4"
    where: str | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class ContextQuery:
    """``ContextQuery().nearest(20).where("lang = 'en'").within(1000)``: each call gives a new query."""

    plan: Plan = Plan()

    def nearest(self, k: int) -> ContextQuery:
        return replace(self, plan=replace(self.plan, topk=k))

    def where(self, predicate: str) -> ContextQuery:
        return replace(self, plan=replace(self.plan, where=predicate))

    def expand(self, hops: int) -> ContextQuery:
        return replace(self, plan=replace(self.plan, hops=hops))

    def without_copies(self) -> ContextQuery:
        return replace(self, plan=replace(self.plan, prune=True))

    def summarised(self, sentences: int) -> ContextQuery:
        return replace(self, plan=replace(self.plan, sentences=sentences))

    def within(self, budget: int, selection: str = "prefix", token_model: str = "chars4") -> ContextQuery:
        return replace(self, plan=replace(self.plan, budget=budget, selection=selection, token_model=token_model))

    def run(self, tasks: DataFrame, pool: DataFrame, edges: DataFrame | None = None, exclude: str | None = None) -> DataFrame:
        """(task_id, doc_id, rank, tokens) of the context of each task, and the summary if there are any.

        Vector search, then expansion along ``edges``, then pruning, then summaries, then the budget.

        ``tasks``: task_id, query, query_vector; ``pool``: doc_id, text, embedding and whatever the
        predicate names. Ids are chosen first; texts are only measured, and read when the caller joins.
        """
        p = self.plan
        seen = pool.where(p.where) if p.where else pool
        if p.hops and edges is None:
            raise ValueError("a query that expands needs edges")
        hits = retrieval.top_k(tasks, seen, p.topk, exclude=exclude)
        if p.hops:
            near = graph.within_hops(hits.select("task_id", F.col("doc_id").alias("node")), edges, p.hops, ["task_id"])
            allowed = near.where("hop > 0").join(seen.select("doc_id"), F.col("node") == F.col("doc_id"), "left_semi")
            if exclude:
                own = tasks.select("task_id", F.col(exclude).alias("node"))
                allowed = allowed.join(own, ["task_id", "node"], "left_anti")
            hits = hits.unionByName(
                allowed.select(
                    "task_id",
                    (F.col("hop") * p.topk + 1).alias("rank"),
                    F.col("node").alias("doc_id"),
                    F.lit(None).cast("double").alias("dist"),
                )
            )
        if p.prune:
            hits = hybrid.prune_copies(hits, seen, ["task_id"])
        size = X.count_tokens(F.col("text"), p.token_model)
        if p.sentences:
            short = hybrid.summarise(tasks, hits, seen, p.sentences, ["task_id"]).select("task_id", "doc_id", "summary")
            sized = hits.join(short.select("task_id", "doc_id", X.count_tokens(F.col("summary"), p.token_model).alias("tokens")), ["task_id", "doc_id"])
        else:
            sized = hits.join(seen.select("doc_id", size.alias("tokens")), "doc_id")
        sized = sized.withColumn("relevance", 1 / (1 + F.coalesce("dist", F.lit(1.0))))
        if p.selection == "skip":
            chosen = B.select_skipping(sized, p.budget, ["task_id"])
        elif p.selection == "dense":
            chosen = B.select_dense(sized, p.budget, ["task_id"])
        else:
            chosen = B.select_prefix(sized, p.budget, ["task_id"])
        chosen = chosen.select("task_id", "doc_id", "rank", "tokens")
        return chosen.join(short, ["task_id", "doc_id"]) if p.sentences else chosen


@dataclass(frozen=True)
class CostWeights:
    """What a context costs: per token of the prompt, per document fetched (retrieval latency), per token that is read to
    be summarised, and per token of the prompt in the model's forward pass."""

    token: float = 1.0
    document: float = 20.0
    summarised: float = 0.5
    forward: float = 0.125


def cost_terms(tokens: Column, docs: Column, summarised: Column | None = None, weights: CostWeights = CostWeights()) -> dict[str, Column]:
    """The terms of a plan's cost; ``summarised`` are the tokens that summaries were made from."""
    read = F.lit(0) if summarised is None else summarised
    return {
        "token_cost": weights.token * tokens,
        "retrieval_cost": weights.document * docs,
        "summary_cost": weights.summarised * read,
        "forward_cost": weights.forward * tokens,
    }


def estimated_cost(tokens: Column, docs: Column, summarised: Column | None = None, weights: CostWeights = CostWeights()) -> Column:
    """Linear cost of a plan: the sum of its terms."""
    first, *rest = cost_terms(tokens, docs, summarised, weights).values()
    for term in rest:
        first = first + term
    return first


def choose(candidates: DataFrame, budget: int, least_recall: float) -> DataFrame:
    """The cheapest candidate (task_id, topk, est_tokens, est_recall) per task that keeps budget and recall.

    Where none does, the one with the highest recall among those that keep the budget, else the smallest.
    """
    cost = estimated_cost(F.col("est_tokens"), F.col("topk"))
    order = F.struct(
        (F.col("est_tokens") > budget).alias("over"),
        F.when(F.col("est_tokens") > budget, F.col("est_tokens")).otherwise(0).alias("excess"),
        F.when(F.col("est_recall") >= least_recall, 0.0).otherwise(1 - F.col("est_recall")).alias("short"),
        cost.alias("cost"),
        F.col("topk").alias("k"),
    )
    best = candidates.groupBy("task_id").agg(F.min_by(F.struct("topk", "est_tokens", "est_recall", cost.alias("est_cost")), order).alias("b"))
    return best.select("task_id", "b.*")
