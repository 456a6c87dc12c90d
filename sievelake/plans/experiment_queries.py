"""Registered queries: retrieval, token cost, budgets, adaptive plans and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget as B
from ..operators import hardness as H
from ..operators import relevance, retrieval
from ..operators import statistics as S
from ..sources.tables import embed, hashed_embedder, table
from .inputs import BUDGETS, COSTS_SQL, HITS_SQL, TOPK, hits, pool, tasks


def r9(column: str):
    return F.round(column, 9).alias(column)


def m9(column):
    """An exact mean, rounded to nine digits."""
    return F.round(column, 9)


def costs(spark: SparkSession, d: str) -> DataFrame:
    """Token cost of each task's context for each k, from one search."""
    kinds = tasks(spark, d).select("task_id", "task_type")
    swept = retrieval.sweep(hits(spark, d), TOPK)
    return retrieval.context_cost(swept, table(spark, d, "documents"), ["task_id", "topk"]).join(kinds, "task_id")


def topk(spark, d):
    return hits(spark, d).select("task_id", "rank", "doc_id", F.round("dist", 6).alias("dist"))


def topk_sweep(spark, d):
    return retrieval.sweep(hits(spark, d), TOPK).groupBy("task_id", "topk").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum("doc_id").alias("id_sum"), F.round(F.max("dist"), 6).alias("max_dist")
    )


def hit_prefix(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")
    return hits(spark, d).where("rank <= 5").groupBy("task_id").agg(ids.alias("doc_ids"))


def similarity(spark, d):
    swept = retrieval.sweep(hits(spark, d), TOPK)
    return swept.groupBy("task_id", "topk").agg(F.round(retrieval.mean_similarity(F.col("dist")), 9).alias("similarity"))


def context_text(spark, d):
    held = hits(spark, d).where("rank <= 5").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    made = held.groupBy("task_id").agg(retrieval.context(F.col("rank"), F.col("text")).alias("context"))
    return made.select("task_id", F.char_length("context").alias("chars"), F.md5("context").alias("context_md5"))


def token_cost(spark, d):
    return costs(spark, d).join(tasks(spark, d).select("task_id", "query"), "task_id").select("task_id", "task_type", "query", "topk", "token_cost")


def cost_percentiles(spark, d):
    p = S.percentile_ratios(S.percentiles(costs(spark, d), "token_cost", ["topk"]))
    return p.select("topk", "p50", "p95", "p99", r9("p95_p50"), r9("p99_p50"))


def cost_cdf(spark, d):
    return S.cdf(costs(spark, d), "token_cost", ["topk"], ["task_id"]).withColumn("cdf", F.round("cdf", 9))


def cost_spread(spark, d):
    out = S.spread(costs(spark, d), "token_cost", ["task_type", "topk"])
    return out.select("task_type", "topk", F.round("mean", 6).alias("mean"), F.round("variance", 3).alias("variance"), r9("cv"))


def cost_pivot(spark, d):
    means = costs(spark, d).groupBy("task_type", "topk").agg(F.avg("token_cost").alias("m"))
    return S.pivot(means, "task_type", "topk", TOPK, F.round(F.first("m"), 6))


def cost_box(spark, d):
    return S.box(costs(spark, d), "token_cost", ["task_type", "topk"])


def cost_unpivot(spark, d):
    wide = S.pivot(costs(spark, d), "task_id", "topk", TOPK, F.first("token_cost"))
    return S.unpivot(wide, ["task_id"], ["c5", "c10", "c20"])


def cost_rollup(spark, d):
    cube = costs(spark, d).cube("task_type", "topk").agg(F.sum("token_cost").alias("total"), F.count(F.lit(1)).alias("n"))
    return cube.select(F.coalesce("task_type", F.lit("all")).alias("task_type"), F.coalesce("topk", F.lit(-1)).alias("topk"), "total", "n")


def budget(spark, d):
    out = B.simulate(costs(spark, d), BUDGETS)
    return out.withColumn("success", relevance.outcome(F.col("success_prob"), F.col("task_id"), F.col("topk"), F.col("budget")))


def budget_simulation(spark, d):
    return budget(spark, d).select(
        "task_id", "task_type", "topk", "budget", "context_tokens", "deviation", r9("deviation_ratio"), r9("utilization"), r9("success_prob"), "success"
    )


def budget_bins(spark, d):
    out = S.bin_means(budget(spark, d), "deviation_ratio", "success_prob", -1.0, 0.1, 24)
    return out.select("bin", m9(F.col("mean")).alias("mean"), "n")


def budget_centers(spark, d):
    out = S.center_means(budget(spark, d), "utilization", "success_prob", ["budget"], 0.0, 0.05, 39)
    return out.select("budget", "center", m9(F.col("mean")).alias("mean"), "n")


def deviation_centers(spark, d):
    out = S.center_means(budget(spark, d), "deviation_ratio", "success_prob", ["budget"], -1.0, 0.05, 49)
    return out.select("budget", "center", m9(F.col("mean")).alias("mean"), "n")


def budget_pivot(spark, d):
    means = budget(spark, d).groupBy("budget", "topk").agg(X.exact_mean(F.col("success_prob")).alias("m"))
    return S.pivot(means, "budget", "topk", TOPK, m9(F.first("m")))


def gold_pairs(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("query"))
    out = relevance.gold(asked, table(spark, d, "documents"))
    return out.select("task_id", "doc_id", "overlap", r9("jaccard"))


def same_label_gold(spark, d):
    t = tasks(spark, d)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("doc_label"))
    e = e.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    return t.join(e, (t["label"] == e["doc_label"]) & (t["vec_id"] != e["doc_id"])).select("task_id", "doc_id")


def quality(spark, d, found=None):
    """Retrieval quality of each task and k; ``found`` are the hits, if the caller needs them as well."""
    swept = retrieval.sweep(hits(spark, d) if found is None else found, TOPK)
    grid = tasks(spark, d).select("task_id", F.explode(F.array(*map(F.lit, TOPK))).alias("topk"))
    out = relevance.evaluate(grid, swept, same_label_gold(spark, d), ["task_id", "topk"])
    kinds = tasks(spark, d).select("task_id", "task_type")
    out = out.join(kinds, "task_id").withColumn("success", relevance.success_probability(F.col("recall")))
    return out.withColumn("agent_success", relevance.outcome(F.col("success"), F.col("task_id"), F.col("topk")))


def keyword_quality(spark, d):
    """Retrieval against the documents that share words with the task's query."""
    asked, held = tasks(spark, d), pool(spark, d).select("doc_id", "text")
    useful = relevance.gold(asked, held).join(asked.select("task_id", "vec_id"), "task_id").where("doc_id <> vec_id")
    grid = asked.select("task_id", F.explode(F.array(*map(F.lit, TOPK))).alias("topk"))
    out = relevance.evaluate(grid, retrieval.sweep(hits(spark, d), TOPK), useful, ["task_id", "topk"])
    out = out.join(asked.select("task_id", "task_type"), "task_id").withColumn("success", relevance.success_probability(F.col("recall")))
    return out.select(
        "task_id", "task_type", "topk", "retrieved_count", "gold_count", "overlap", r9("recall"), r9("precision"), r9("f1"), r9("success"),
        relevance.outcome(F.col("success"), F.col("task_id"), F.col("topk")).alias("agent_success"),
    )


def text_search(spark, d):
    """From text to vector to hits: queries and documents embedded by one model, then searched."""
    model = hashed_embedder(64)
    asked = embed(tasks(spark, d).select("task_id", "query"), model, "query", "query_vector")
    held = embed(table(spark, d, "documents").select("doc_id", "text"), model)
    return retrieval.top_k(asked, held, 10).select("task_id", "rank", "doc_id", F.round("dist", 6).alias("dist"))


def similarity_points(spark, d):
    """Mean similarity against recall, one row per task and k."""
    found = hits(spark, d)
    sim = retrieval.sweep(found, TOPK).groupBy("task_id", "topk").agg(retrieval.mean_similarity(F.col("dist")).alias("similarity"))
    return quality(spark, d, found).join(sim, ["task_id", "topk"]).select("task_id", "task_type", "topk", r9("similarity"), r9("recall"))


def retrieval_quality(spark, d):
    return quality(spark, d).select(
        "task_id", "task_type", "topk", "retrieved_count", "gold_count", "overlap", r9("recall"), r9("precision"), r9("f1"), r9("success"), "agent_success"
    )


def quality_by_topk(spark, d):
    return quality(spark, d).groupBy("topk").agg(
        *[m9(X.exact_mean(F.col(c))).alias(c) for c in ("recall", "precision", "f1", "success")],
        F.round(F.stddev_samp("recall"), 9).alias("recall_std"),
    )


def quality_pivot(spark, d):
    means = quality(spark, d).groupBy("task_type", "topk").agg(X.exact_mean(F.col("recall")).alias("m"))
    return S.pivot(means, "task_type", "topk", TOPK, m9(F.first("m")))


def recall_density(spark, d):
    return S.histogram(quality(spark, d), "recall", ["topk"], density=True).select("topk", "bin", F.round("density", 6).alias("density"))


def recall_centers(spark, d):
    out = S.center_means(quality(spark, d), "recall", "success", ["topk"], 0.0, 0.05, 21)
    return out.select("topk", "center", m9(F.col("mean")).alias("mean"), "n")


def similarity_recall(spark, d):
    found = hits(spark, d)
    sim = retrieval.sweep(found, TOPK).groupBy("task_id", "topk").agg(retrieval.mean_similarity(F.col("dist")).alias("similarity"))
    both = quality(spark, d, found).join(sim, ["task_id", "topk"])
    return both.groupBy("topk").agg(F.round(F.corr("similarity", "recall"), 6).alias("correlation"), F.count(F.lit(1)).alias("n"))


def task_queries(spark, d):
    """Tasks whose queries mix benchmark texts with hard and easy words, so that both classes occur."""
    extra = F.when(F.col("vec_id") % 3 == 0, "complex distributed recursive algorithm ").when(F.col("vec_id") % 3 == 1, "what example ").otherwise("")
    return tasks(spark, d).withColumn("query", F.concat(extra, F.col("query")))


def hardness(spark, d):
    return H.planned(task_queries(spark, d)).select("task_id", r9("hardness"), "hardness_class", F.col("plan.strategy").alias("strategy"), F.col("plan.topk").alias("topk"))


def plan_hits(spark, d):
    done = H.execute(H.planned(task_queries(spark, d)), hits(spark, d))
    return done.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("rank").alias("last_rank"))


def comparison(spark, d):
    return H.compare(H.planned(task_queries(spark, d)), hits(spark, d), table(spark, d, "documents"))


def adaptive_comparison(spark, d):
    return comparison(spark, d).select(
        "task_id", "task_type", r9("hardness"), "hardness_class", "adaptive_strategy", "adaptive_topk", "adaptive_cost", "estimated_cost",
        r9("adaptive_success"), "naive_cost", r9("naive_success"), "cost_savings", r9("success_improvement"),
    )


def adaptive_by_class(spark, d):
    out = S.class_means(
        comparison(spark, d), "hardness_class", ["easy", "hard"],
        {"adaptive_cost": "adaptive_cost", "naive_cost": "naive_cost", "adaptive_success": "adaptive_success", "naive_success": "naive_success"},
    )
    return out.select("hardness_class", "n", *[m9(F.col(c)).alias(c) for c in ("adaptive_cost", "naive_cost", "adaptive_success", "naive_success")])


def savings_histogram(spark, d):
    return S.histogram(comparison(spark, d), "cost_savings", [])


def cost_success_points(spark, d):
    c = comparison(spark, d)
    own = c.select("task_id", F.lit("adaptive").alias("plan"), F.col("adaptive_cost").alias("cost"), F.round("adaptive_success", 9).alias("success"))
    fixed = c.select("task_id", F.lit("fixed").alias("plan"), F.col("naive_cost").alias("cost"), F.round("naive_success", 9).alias("success"))
    return own.unionByName(fixed)


def pieces_cost(spark, d):
    swept = retrieval.sweep(hits(spark, d), TOPK)
    return retrieval.context_cost(swept, table(spark, d, "documents"), ["task_id", "topk"], model="pieces")


QUERIES = {
    "q_topk": topk,
    "q_topk_sweep": topk_sweep,
    "q_hit_prefix": hit_prefix,
    "q_similarity": similarity,
    "q_context": context_text,
    "q_token_cost": token_cost,
    "q_pieces_cost": pieces_cost,
    "q_cost_percentiles": cost_percentiles,
    "q_cost_cdf": cost_cdf,
    "q_cost_spread": cost_spread,
    "q_cost_pivot": cost_pivot,
    "q_cost_box": cost_box,
    "q_cost_unpivot": cost_unpivot,
    "q_cost_rollup": cost_rollup,
    "q_budget_simulation": budget_simulation,
    "q_budget_bins": budget_bins,
    "q_budget_centers": budget_centers,
    "q_deviation_centers": deviation_centers,
    "q_budget_pivot": budget_pivot,
    "q_gold": gold_pairs,
    "q_quality": retrieval_quality,
    "q_quality_by_topk": quality_by_topk,
    "q_quality_pivot": quality_pivot,
    "q_recall_density": recall_density,
    "q_recall_centers": recall_centers,
    "q_similarity_recall": similarity_recall,
    "q_similarity_points": similarity_points,
    "q_keyword_quality": keyword_quality,
    "q_text_search": text_search,
    "q_hardness": hardness,
    "q_plan_hits": plan_hits,
    "q_adaptive": adaptive_comparison,
    "q_adaptive_by_class": adaptive_by_class,
    "q_savings_histogram": savings_histogram,
    "q_cost_success": cost_success_points,
}

def _drawn(probability: str, *key: str) -> str:
    text = " || '|' || ".join(("'outcome'", *key))
    return f"(('0x' || md5({text})[1:12])::BIGINT / {float(2**48)!r} < {probability})"


_BUDGET_SQL = (
    COSTS_SQL
    + """,
budget AS (
    SELECT *, CASE WHEN tokens > budget THEN greatest(0, 1 - 2 * (1 - left_tokens / budget))
                   WHEN tokens / budget < 0.5 THEN tokens / budget * 1.5
                   WHEN tokens / budget >= 0.7 THEN 0.9 + (tokens / budget - 0.7) / 3
                   ELSE 0.7 + (tokens / budget - 0.5) END AS success_prob,
           (left_tokens - budget) / budget AS deviation_ratio, left_tokens / budget AS utilization
    FROM (SELECT task_id, task_type, topk, b.budget, token_cost::DOUBLE AS tokens, least(token_cost, b.budget)::DOUBLE AS left_tokens
          FROM costs CROSS JOIN (VALUES (500::BIGINT), (1000), (2000), (4000), (8000), (16000)) AS b(budget))
)"""
)
_QUALITY_SQL = (
    HITS_SQL
    + """,
gold AS (SELECT t.task_id, p.doc_id FROM tasks t JOIN pool p ON p.label = t.label AND p.doc_id <> t.vec_id),
n_gold AS (SELECT task_id, count(*) AS gold_count FROM gold GROUP BY 1),
counted AS (
    SELECT t.task_id, t.task_type, k.topk, count(h.doc_id) AS retrieved_count, coalesce(max(n.gold_count), 0) AS gold_count, count(g.doc_id) AS common
    FROM tasks t CROSS JOIN (VALUES (5), (10), (20)) AS k(topk)
    LEFT JOIN hits h ON h.task_id = t.task_id AND h.rank <= k.topk
    LEFT JOIN gold g ON g.task_id = h.task_id AND g.doc_id = h.doc_id
    LEFT JOIN n_gold n ON n.task_id = t.task_id GROUP BY ALL
),
rates AS (
    SELECT *, CASE WHEN gold_count > 0 THEN common ELSE 0 END AS overlap,
           CASE WHEN gold_count > 0 THEN common / gold_count ELSE 0 END AS recall,
           CASE WHEN gold_count > 0 AND retrieved_count > 0 THEN common / retrieved_count ELSE 0 END AS precision
    FROM counted
),
quality AS (
    SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END AS f1,
           CASE WHEN recall >= 0.8 THEN 0.9 + 0.1 * recall WHEN recall >= 0.5 THEN 0.5 + (recall - 0.5) * (0.4 / 0.3) ELSE recall END AS success
    FROM rates
)"""
)
_KEYWORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''){1})"
_KEYWORD_SQL = _QUALITY_SQL.replace(
    "gold AS (SELECT t.task_id, p.doc_id FROM tasks t JOIN pool p ON p.label = t.label AND p.doc_id <> t.vec_id)",
    f"""sets AS (SELECT task_id, doc_id, {_KEYWORDS.format('query', '')} AS a, {_KEYWORDS.format('p.text', '[1:20]')} AS b
    FROM tasks t CROSS JOIN pool p WHERE p.doc_id <> t.vec_id),
gold AS (SELECT task_id, doc_id FROM sets WHERE len(list_intersect(a, b)) >= 3
    OR (len(list_intersect(a, b)) > 0 AND len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) > 0.15))""",
)
_HARD_SQL = (
    HITS_SQL
    + f""",
asked AS (
    SELECT task_id, task_type, CASE vec_id % 3 WHEN 0 THEN 'complex distributed recursive algorithm ' WHEN 1 THEN 'what example ' ELSE '' END || query AS query
    FROM tasks
),
words AS (
    SELECT *, list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '') AS all_words,
           list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')) AS word_set
    FROM asked
),
counts AS (
    SELECT *, len(list_intersect(word_set, {H.HARD_WORDS})) AS hard, len(list_intersect(word_set, {H.EASY_WORDS})) AS easy FROM words
),
hardness AS (
    SELECT task_id, task_type, query, greatest(0, least(1, 0.5 * (hard / (hard + easy + 1)) + 0.3 * least(len(all_words) / 20, 1) + 0.2 * 0.5)) AS hardness FROM counts
),
plans AS (
    SELECT *, CASE WHEN hardness >= 0.5 THEN 'hard' ELSE 'easy' END AS hardness_class,
           CASE WHEN hardness >= 0.5 THEN 'heavy' ELSE 'fast' END AS strategy,
           CASE WHEN hardness >= 0.5 THEN 20 ELSE 5 END AS topk, CASE WHEN hardness >= 0.5 THEN 2.0 ELSE 0.5 END AS multiplier
    FROM hardness
),
sized AS (
    SELECT p.*, (sum(length(d.text)) FILTER (WHERE h.rank <= p.topk) + 2 * (count(*) FILTER (WHERE h.rank <= p.topk) - 1))::BIGINT AS own_chars,
           (sum(length(d.text)) FILTER (WHERE h.rank <= 10) + 2 * (count(*) FILTER (WHERE h.rank <= 10) - 1))::BIGINT AS fixed_chars
    FROM plans p JOIN hits h USING (task_id) JOIN documents d USING (doc_id) GROUP BY ALL
),
compared AS (
    SELECT *, ceil(own_chars / 4)::BIGINT AS adaptive_cost, ceil(fixed_chars / 4)::BIGINT AS naive_cost,
           CASE WHEN strategy = 'heavy' THEN CASE WHEN own_chars > 5000 THEN 0.8 + 0.2 * hardness ELSE 0.3 + 0.2 * hardness END
                WHEN own_chars > 2000 THEN 0.9 - 0.2 * hardness ELSE 0.6 - 0.2 * hardness END AS adaptive_success,
           CASE WHEN fixed_chars > 2000 THEN 0.9 - 0.2 * hardness ELSE 0.6 - 0.2 * hardness END AS naive_success
    FROM sized
)"""
)


def _bins(low: float, width: float, n: int, name: str = "bins") -> str:
    values = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(S.edges(low, width, n), S.edges(low, width, n)[1:], strict=False)))
    return f"{name} AS (SELECT * FROM (VALUES {values}) AS v(bin, lo, hi))"


def _centers(base: str, table_: str, value: str, target: str, by: str, low: float, width: float, n: int) -> str:
    return (
        f"WITH {base}, {_bins(low, width, n)} SELECT {by}, round({low} + (bin + 0.5) * {width}, 6) AS center, round(sum(({target})::DECIMAL(38,12))::DOUBLE / count({target}), 9) AS mean, count(*) AS n "
        f"FROM {table_} JOIN bins ON {value} > lo AND {value} <= hi GROUP BY {by}, bin HAVING count(*) >= 3"
    )


SQL = {
    "q_topk": f"WITH {HITS_SQL} SELECT task_id, rank, doc_id, round(dist, 6) AS dist FROM hits",
    "q_topk_sweep": f"""WITH {HITS_SQL} SELECT task_id, topk, count(*) AS n_hits, sum(doc_id)::BIGINT AS id_sum, round(max(dist), 6) AS max_dist
        FROM hits JOIN (VALUES (5), (10), (20)) AS k(topk) ON rank <= topk GROUP BY ALL""",
    "q_hit_prefix": f"WITH {HITS_SQL} SELECT task_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids FROM hits WHERE rank <= 5 GROUP BY 1",
    "q_similarity": f"""WITH {HITS_SQL} SELECT task_id, topk, round(avg(1 / (1 + dist)), 9) AS similarity
        FROM hits JOIN (VALUES (5), (10), (20)) AS k(topk) ON rank <= topk GROUP BY ALL""",
    "q_context": f"""WITH {HITS_SQL}, c AS (SELECT task_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
        FROM hits JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1) SELECT task_id, length(context)::INT AS chars, md5(context) AS context_md5 FROM c""",
    "q_token_cost": f"WITH {COSTS_SQL} SELECT task_id, c.task_type, query, topk, token_cost FROM costs c JOIN tasks USING (task_id)",
    "q_pieces_cost": f"""WITH {HITS_SQL} SELECT task_id, topk, sum(len(regexp_extract_all(text, '\\p{{L}}+|\\p{{N}}{{1,3}}|[^\\s\\p{{L}}\\p{{N}}]+')))::BIGINT AS token_cost
        FROM hits JOIN documents USING (doc_id) JOIN (VALUES (5), (10), (20)) AS k(topk) ON rank <= topk GROUP BY ALL""",
    "q_cost_percentiles": f"""WITH {COSTS_SQL}, s AS (SELECT topk, list_sort(list(token_cost)) AS v, count(*) AS n FROM costs GROUP BY 1),
        p AS (SELECT topk, v[least(n * 50 // 100, n - 1) + 1] AS p50, v[least(n * 95 // 100, n - 1) + 1] AS p95, v[least(n * 99 // 100, n - 1) + 1] AS p99 FROM s)
        SELECT topk, p50, p95, p99, round(p95 / p50, 9) AS p95_p50, round(p99 / p50, 9) AS p99_p50 FROM p""",
    "q_cost_cdf": f"""WITH {COSTS_SQL} SELECT topk, task_id, token_cost,
        round(row_number() OVER (PARTITION BY topk ORDER BY token_cost, task_id) / count(*) OVER (PARTITION BY topk) * 100, 9) AS cdf FROM costs""",
    "q_cost_spread": f"""WITH {COSTS_SQL} SELECT task_type, topk, round(avg(token_cost), 6) AS mean, round(var_pop(token_cost), 3) AS variance,
        round(CASE WHEN avg(token_cost) > 0 THEN stddev_pop(token_cost) / avg(token_cost) ELSE 0 END, 9) AS cv FROM costs GROUP BY ALL""",
    "q_cost_pivot": f"""WITH {COSTS_SQL} SELECT task_type, {', '.join(f'round(avg(token_cost) FILTER (WHERE topk = {k}), 6) AS c{k}' for k in TOPK)} FROM costs GROUP BY 1""",
    "q_cost_box": f"""WITH {COSTS_SQL}, q AS (SELECT task_type, topk, quantile_cont(token_cost::DOUBLE, 0.25) AS q1, quantile_cont(token_cost::DOUBLE, 0.5) AS median,
        quantile_cont(token_cost::DOUBLE, 0.75) AS q3 FROM costs GROUP BY ALL)
        SELECT task_type, topk, q1, median, q3, min(token_cost) AS low, max(token_cost) AS high FROM q JOIN costs USING (task_type, topk)
        WHERE token_cost BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""",
    "q_cost_unpivot": f"WITH {COSTS_SQL} SELECT task_id, 'c' || topk AS variable, token_cost AS value FROM costs",
    "q_cost_rollup": f"WITH {COSTS_SQL} SELECT coalesce(c.task_type, 'all') AS task_type, coalesce(c.topk, -1)::INT AS topk, sum(token_cost)::BIGINT AS total, count(*) AS n FROM costs c GROUP BY CUBE (c.task_type, c.topk)",
    "q_budget_simulation": f"""WITH {_BUDGET_SQL} SELECT task_id, task_type, topk, budget, left_tokens::BIGINT AS context_tokens, (left_tokens - budget)::BIGINT AS deviation,
        round(deviation_ratio, 9) AS deviation_ratio, round(utilization, 9) AS utilization, round(success_prob, 9) AS success_prob,
        {_drawn('success_prob', 'task_id', 'topk::VARCHAR', 'budget::VARCHAR')} AS success FROM budget""",
    "q_budget_bins": f"""WITH {_BUDGET_SQL}, {_bins(-1.0, 0.1, 24)} SELECT bin::INT AS bin, round(sum((success_prob)::DECIMAL(38,12))::DOUBLE / count(success_prob), 9) AS mean, count(success_prob) AS n
        FROM bins LEFT JOIN budget ON deviation_ratio > lo AND deviation_ratio <= hi GROUP BY 1""",
    "q_budget_centers": _centers(_BUDGET_SQL, "budget", "utilization", "success_prob", "budget", 0.0, 0.05, 39),
    "q_deviation_centers": _centers(_BUDGET_SQL, "budget", "deviation_ratio", "success_prob", "budget", -1.0, 0.05, 49),
    "q_budget_pivot": f"""WITH {_BUDGET_SQL} SELECT budget, {', '.join(f'round(sum((success_prob)::DECIMAL(38,12)) FILTER (WHERE topk = {k})::DOUBLE / count(success_prob) FILTER (WHERE topk = {k}), 9) AS c{k}' for k in TOPK)} FROM budget GROUP BY 1""",
    "q_gold": """WITH q AS (SELECT item_id AS task_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS a FROM benchmark),
        d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')[1:20]) AS b FROM documents),
        p AS (SELECT task_id, doc_id, len(list_intersect(a, b)) AS overlap, len(a) + len(b) AS total FROM q CROSS JOIN d)
        SELECT task_id, doc_id, overlap, round(overlap / (total - overlap), 9) AS jaccard FROM p
        WHERE overlap > 0 AND (overlap / (total - overlap) > 0.15 OR overlap >= 3)""",
    "q_quality": f"""WITH {_QUALITY_SQL} SELECT task_id, task_type, topk, retrieved_count, gold_count, overlap, round(recall, 9) AS recall,
        round(precision, 9) AS precision, round(f1, 9) AS f1, round(success, 9) AS success, {_drawn('success', 'task_id', 'topk::VARCHAR')} AS agent_success FROM quality""",
    "q_keyword_quality": f"""WITH {_KEYWORD_SQL} SELECT task_id, task_type, topk, retrieved_count, gold_count, overlap, round(recall, 9) AS recall,
        round(precision, 9) AS precision, round(f1, 9) AS f1, round(success, 9) AS success, {_drawn('success', 'task_id', 'topk::VARCHAR')} AS agent_success FROM quality""",
    "q_similarity_points": f"""WITH {_QUALITY_SQL}, s AS (SELECT task_id, topk, avg(1 / (1 + dist)) AS similarity FROM hits JOIN (VALUES (5), (10), (20)) AS k(topk) ON rank <= topk GROUP BY ALL)
        SELECT task_id, task_type, topk, round(similarity, 9) AS similarity, round(recall, 9) AS recall FROM quality JOIN s USING (task_id, topk)""",
    "q_quality_by_topk": f"""WITH {_QUALITY_SQL} SELECT topk, round(sum((recall)::DECIMAL(38,12))::DOUBLE / count(recall), 9) AS recall, round(sum((precision)::DECIMAL(38,12))::DOUBLE / count(precision), 9) AS precision, round(sum((f1)::DECIMAL(38,12))::DOUBLE / count(f1), 9) AS f1,
        round(sum((success)::DECIMAL(38,12))::DOUBLE / count(success), 9) AS success, round(stddev_samp(recall), 9) AS recall_std FROM quality GROUP BY 1""",
    "q_quality_pivot": f"""WITH {_QUALITY_SQL} SELECT task_type, {', '.join(f'round(sum((recall)::DECIMAL(38,12)) FILTER (WHERE topk = {k})::DOUBLE / count(recall) FILTER (WHERE topk = {k}), 9) AS c{k}' for k in TOPK)} FROM quality GROUP BY 1""",
    "q_recall_density": f"""WITH {_QUALITY_SQL}, l AS (SELECT topk, min(recall) AS lo, (max(recall) - min(recall)) / 20 AS w, count(*) AS n FROM quality GROUP BY 1),
        b AS (SELECT topk, CASE WHEN w > 0 THEN least(floor((recall - lo) / w), 19) ELSE 0 END::INT AS bin, n, w FROM quality JOIN l USING (topk))
        SELECT topk, bin, round(CASE WHEN any_value(w) > 0 THEN count(*) / (any_value(n) * any_value(w)) ELSE 0 END, 6) AS density FROM b GROUP BY topk, bin""",
    "q_recall_centers": _centers(_QUALITY_SQL, "quality", "recall", "success", "topk", 0.0, 0.05, 21),
    "q_similarity_recall": f"""WITH {_QUALITY_SQL}, s AS (SELECT task_id, topk, avg(1 / (1 + dist)) AS similarity FROM hits JOIN (VALUES (5), (10), (20)) AS k(topk) ON rank <= topk GROUP BY ALL)
        SELECT topk, round(corr(similarity, recall), 6) AS correlation, count(*) AS n FROM quality JOIN s USING (task_id, topk) GROUP BY 1""",
    "q_hardness": f"WITH {_HARD_SQL} SELECT task_id, round(hardness, 9) AS hardness, hardness_class, strategy, topk FROM plans",
    "q_plan_hits": f"WITH {_HARD_SQL} SELECT task_id, count(*) AS n_hits, max(rank) AS last_rank FROM plans JOIN hits USING (task_id) WHERE rank <= topk GROUP BY 1",
    "q_adaptive": f"""WITH {_HARD_SQL} SELECT task_id, task_type, round(hardness, 9) AS hardness, hardness_class, strategy AS adaptive_strategy, topk AS adaptive_topk,
        adaptive_cost, adaptive_cost * multiplier::DOUBLE AS estimated_cost, round(adaptive_success, 9) AS adaptive_success, naive_cost, round(naive_success, 9) AS naive_success,
        naive_cost - adaptive_cost AS cost_savings, round(adaptive_success - naive_success, 9) AS success_improvement FROM compared""",
    "q_adaptive_by_class": f"""WITH {_HARD_SQL} SELECT c.hardness_class, count(task_id) AS n, round(sum((adaptive_cost)::DECIMAL(38,12))::DOUBLE / count(adaptive_cost), 9) AS adaptive_cost, round(sum((naive_cost)::DECIMAL(38,12))::DOUBLE / count(naive_cost), 9) AS naive_cost,
        round(sum((adaptive_success)::DECIMAL(38,12))::DOUBLE / count(adaptive_success), 9) AS adaptive_success, round(sum((naive_success)::DECIMAL(38,12))::DOUBLE / count(naive_success), 9) AS naive_success
        FROM (VALUES ('easy'), ('hard')) AS c(hardness_class) LEFT JOIN compared USING (hardness_class) GROUP BY 1""",
    "q_savings_histogram": f"""WITH {_HARD_SQL}, s AS (SELECT naive_cost - adaptive_cost AS v FROM compared), l AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM s)
        SELECT CASE WHEN w > 0 THEN least(floor((v - lo) / w), 19) ELSE 0 END::INT AS bin, count(*) AS n FROM s CROSS JOIN l GROUP BY 1""",
    "q_cost_success": f"""WITH {_HARD_SQL} SELECT task_id, 'adaptive' AS plan, adaptive_cost AS cost, round(adaptive_success, 9) AS success FROM compared
        UNION ALL SELECT task_id, 'fixed', naive_cost, round(naive_success, 9) FROM compared""",
}
