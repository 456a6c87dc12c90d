"""Registered queries: text scalars, token models, generators, keyed random numbers, repeat runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keyed_random as R
from ..functions import text as X
from ..functions.sql import register_functions
from ..operators import memory, retrieval
from ..operators import stability as St
from ..operators import statistics as S
from ..sources import generators
from ..sources.tables import table
from .inputs import TASKS_SQL, tasks

RUNS, RUN_K = 10, 10


def token_models(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.count_tokens(t).alias("chars4"), X.count_tokens(t, "pieces").alias("pieces"))


def truncated(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(X.truncate(t, F.lit(100))).alias("chars4_md5"), F.md5(X.truncate(t, F.lit(100), "pieces")).alias("pieces_md5")
    )


def text_scalars(spark, d):
    return memory.scalars(table(spark, d, "documents"))


def word_overlap(spark, d):
    """For each document the benchmark item with the most similar words, among all items, by an equi-join on words."""
    items = table(spark, d, "benchmark").select("item_id", X.word_set(F.col("text")).alias("w"))
    asked = items.select("item_id", F.size("w").alias("n_item"), F.explode("w").alias("word"))
    held = table(spark, d, "documents").select("doc_id", X.word_set(F.col("text")).alias("w"))
    held = held.select("doc_id", F.size("w").alias("n_doc"), F.explode("w").alias("word"))
    both = held.join(asked, "word").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("common"), F.first("n_doc").alias("n_doc"), F.first("n_item").alias("n_item"))
    share = F.round(F.col("common") / (F.col("n_doc") + F.col("n_item") - F.col("common")), 9)
    order = F.struct(share.alias("jaccard"), (-F.col("item_id")).alias("i"))
    best = both.groupBy("doc_id").agg(F.max_by(F.struct("item_id", "common", share.alias("jaccard")), order).alias("b"), F.count(F.lit(1)).alias("n_items"))
    return best.select("doc_id", "b.item_id", "b.common", "b.jaccard", "n_items")


def hash_buckets(spark, d):
    return table(spark, d, "documents").groupBy(St.hash_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def keyed_draws(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id",
        F.round(R.uniform(7, k), 9).alias("u"),
        R.integer(100, 2000, 7, "len", k).alias("i"),
        R.choice(["code", "sql", "dialog"], 7, "kind", k).alias("c"),
        R.bernoulli(F.lit(0.3), 7, "coin", k).alias("b"),
        F.round(R.gaussian(7, "noise", k), 6).alias("g"),
    )


def sample_rows(spark, d):
    """Ten rows without replacement, by keyed draws: the sample is the feature."""
    return table(spark, d, "documents").select("doc_id", F.round(R.uniform("sample", F.col("doc_id")), 9).alias("u")).orderBy("u", "doc_id").limit(10)


def synthetic_tasks(spark, d):
    return generators.all_tasks(spark, 100, seed=1).groupBy("task_type", "query").agg(F.count(F.lit(1)).alias("n"))


def synthetic_documents(spark, d):
    made = generators.documents(spark, 200, seed=1)
    return made.select("doc_id", F.char_length("text").alias("chars"), F.size(X.word_set(F.col("text"))).alias("n_words"))


def noisy_retrieval(spark, d):
    """Ten noisy runs of each task: which hits they share with the run without noise."""
    asked = retrieval.noisy(tasks(spark, d), RUNS).withColumn("run_key", F.concat_ws("#", "task_id", "run_id"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    held = vectors.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    found = retrieval.top_k(asked, held, RUN_K, key="run_key", exclude="vec_id")
    return found.select(
        F.substring_index("run_key", "#", 1).alias("task_id"), F.substring_index("run_key", "#", -1).cast("int").alias("run_id"), "rank", "doc_id", "dist"
    )


def noisy_hits(spark, d):
    return noisy_retrieval(spark, d).select("task_id", "run_id", "rank", "doc_id", F.round("dist", 6).alias("dist"))


def runs(spark, d):
    held = noisy_retrieval(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    made = held.groupBy("task_id", "run_id").agg(retrieval.context(F.col("rank"), F.col("text")).alias("context"))
    asked = made.join(tasks(spark, d).select("task_id", "task_type", "query"), "task_id")
    output = St.simulated_output(F.col("context"), F.col("query"), R.integer(0, 100, "run", F.col("task_id"), F.col("run_id")))
    return asked.select("task_id", "task_type", "run_id", "context", output.alias("output"), X.count_tokens(F.col("context")).alias("token_cost"))


def simulated_outputs(spark, d):
    return runs(spark, d).select("task_id", "run_id", "output", "token_cost")


def stability(spark, d):
    return St.stability(runs(spark, d), ["task_id", "task_type"])


def run_stability(spark, d):
    return stability(spark, d).select(
        "task_id", "task_type", "num_runs", "unique_contexts", "unique_outputs", F.round("context_stability", 6).alias("context_stability"),
        F.round("output_stability", 6).alias("output_stability"), F.round("cost_mean", 6).alias("cost_mean"), F.round("cost_std", 6).alias("cost_std"),
        F.round("cost_cv", 6).alias("cost_cv"), "cost_min", "cost_max", "cost_range",
    )


STABLE = ("unique_contexts", "unique_outputs", "context_stability", "output_stability", "cost_cv", "cost_range")


def stability_means(spark, d):
    return stability(spark, d).agg(*[F.round(F.avg(c), 6).alias(c) for c in STABLE])


def stability_by_type(spark, d):
    return stability(spark, d).groupBy("task_type").agg(*[F.round(F.avg(c), 6).alias(c) for c in STABLE])


def stability_points(spark, d):
    """Context against output stability, with the cost's variation as the third dimension; a row per task."""
    return stability(spark, d).select("task_id", "task_type", *[F.round(c, 6).alias(c) for c in ("context_stability", "output_stability", "cost_cv")])


def stability_histogram(spark, d):
    return S.histogram(stability(spark, d), "context_stability", [])


def cost_cloud(spark, d):
    """Ten draws per task around its mean cost, kept within the costs seen."""
    s = stability(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(9))))
    value = F.col("cost_mean") + F.col("cost_std") * R.gaussian("cloud", F.col("task_id"), F.col("draw"))
    inside = F.least(F.greatest(value, F.col("cost_min")), F.col("cost_max"))
    return s.select("task_id", "draw", F.round(inside, 4).alias("cost"))


def embedded(spark, d):
    """Documents embedded by the download-free model, and their length-one check."""
    from ..sources.tables import embed, hashed_embedder

    made = embed(table(spark, d, "documents").select("doc_id", "text"), hashed_embedder(32))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("doc_id", F.size("embedding").alias("dimensions"), F.round(norm, 4).alias("norm"))


def distinct_keys(spark, d):
    return table(spark, d, "documents").select("lang").distinct().where("lang is not null").orderBy("lang")


def sql_functions(spark, d):
    """The scalars called from SQL text."""
    register_functions(spark)
    table(spark, d, "documents").createOrReplaceTempView("sievelake_documents")
    return spark.sql(
        "SELECT doc_id, token_count(text) AS tokens, piece_count(text) AS pieces, md5(cut_tokens(text, 50)) AS cut_md5, "
        "size(word_set(text)) AS n_words, round(word_jaccard(word_set(text), word_set(lang || ' the and of')), 9) AS jaccard, "
        "round(keyed_uniform(concat('sql|', doc_id)), 9) AS u FROM sievelake_documents"
    )


QUERIES = {
    "q_sql_functions": sql_functions,
    "q_token_models": token_models,
    "q_truncate": truncated,
    "q_text_scalars": text_scalars,
    "q_word_overlap": word_overlap,
    "q_hash_buckets": hash_buckets,
    "q_keyed_draws": keyed_draws,
    "q_sample": sample_rows,
    "q_synthetic_tasks": synthetic_tasks,
    "q_synthetic_documents": synthetic_documents,
    "q_noisy_hits": noisy_hits,
    "q_simulated_outputs": simulated_outputs,
    "q_stability": run_stability,
    "q_stability_means": stability_means,
    "q_stability_by_type": stability_by_type,
    "q_stability_points": stability_points,
    "q_stability_histogram": stability_histogram,
    "q_cost_cloud": cost_cloud,
    "q_embed": embedded,
    "q_distinct_keys": distinct_keys,
}


def _bits(*parts: str) -> str:
    key = " || '|' || ".join(parts)
    return f"('0x' || md5({key})[1:12])::BIGINT"


def _uniform(*parts: str) -> str:
    return f"({_bits(*parts)} / {float(2**48)!r})"


def _gauss(*parts: str) -> str:
    u, v = f"(({_bits(*parts, chr(39) + 'u' + chr(39))} + 1) / {float(2**48)!r})", _uniform(*parts, "'v'")
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


_SETS = "list_distinct(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
_RUNS_SQL = (
    TASKS_SQL
    + f""",
pool AS (SELECT d.doc_id, d.text, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
noise AS (
    SELECT task_id, vec_id, run_id, list_transform(query_vector, lambda x, i: x::DOUBLE + 0.01 * {_gauss("'0'", "task_id", "run_id::VARCHAR", "(i - 1)::VARCHAR")}) AS q
    FROM tasks CROSS JOIN range({RUNS}) AS r(run_id)
),
noisy AS (
    SELECT * FROM (
        SELECT task_id, run_id, doc_id, dist, row_number() OVER (PARTITION BY task_id, run_id ORDER BY dist, doc_id) AS rank FROM (
            SELECT task_id, run_id, doc_id, list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS dist
            FROM noise CROSS JOIN pool WHERE doc_id <> vec_id)
    ) WHERE rank <= {RUN_K}
),
contexts AS (
    SELECT n.task_id, n.run_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM noisy n JOIN documents USING (doc_id) GROUP BY ALL
),
runs AS (
    SELECT c.task_id, t.task_type, c.run_id, context, ceil(length(context) / 4)::BIGINT AS token_cost,
           'Response_' || (({_bits("context")} % 1000 + {_bits("query")} % 1000 + floor({_uniform("'run'", "c.task_id", "c.run_id::VARCHAR")} * 100)::BIGINT) % 100) AS output
    FROM contexts c JOIN tasks t USING (task_id)
),
sets AS (SELECT task_id, run_id, {_SETS.format("context")} AS w FROM runs),
pairs AS (
    SELECT a.task_id, avg(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) AS mean_j
    FROM sets a JOIN sets b ON a.task_id = b.task_id AND a.run_id < b.run_id WHERE len(a.w) + len(b.w) > 0 GROUP BY 1
),
stability AS (
    SELECT r.task_id, r.task_type, count(*) AS num_runs, count(DISTINCT context) AS unique_contexts, count(DISTINCT output) AS unique_outputs,
           coalesce(any_value(mean_j), 0) AS context_stability, count(DISTINCT output) / count(*) AS output_stability,
           avg(token_cost) AS cost_mean, stddev_pop(token_cost) AS cost_std,
           CASE WHEN avg(token_cost) > 0 THEN stddev_pop(token_cost) / avg(token_cost) ELSE 0 END AS cost_cv,
           min(token_cost) AS cost_min, max(token_cost) AS cost_max, max(token_cost) - min(token_cost) AS cost_range
    FROM runs r LEFT JOIN pairs USING (task_id) GROUP BY ALL
)"""
)
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in STABLE)
_PIECES = "regexp_extract_all(text, '\\p{L}+|\\p{N}{1,3}|[^\\s\\p{L}\\p{N}]+')"

SQL = {
    "q_sql_functions": f"""WITH s AS (SELECT *, {_SETS.format("lower(text)")} AS a, {_SETS.format("lower(lang || ' the and of')")} AS b FROM documents)
        SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens, len({_PIECES}) AS pieces, md5(text[1:200]) AS cut_md5, len(a)::INT AS n_words,
               round(coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0), 9) AS jaccard,
               round({_uniform("'sql'", "doc_id::VARCHAR")}, 9) AS u FROM s""",
    "q_token_models": f"SELECT doc_id, ceil(length(text) / 4)::BIGINT AS chars4, len({_PIECES}) AS pieces FROM documents",
    "q_truncate": f"""SELECT doc_id, md5(text[1:400]) AS chars4_md5,
        md5(CASE WHEN len({_PIECES}) <= 100 THEN text ELSE array_to_string({_PIECES}[1:100], ' ') END) AS pieces_md5 FROM documents""",
    "q_text_scalars": f"""SELECT doc_id, length(text)::INT AS chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT AS n_words,
        len({_SETS.format("lower(text)")})::INT AS n_word_set, len({_SETS.format("text")})::INT AS n_word_set_cased,
        len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')[1:20]))::INT AS n_first_set, text[1:10] AS prefix FROM documents""",
    "q_word_overlap": f"""WITH d AS (SELECT doc_id, {_SETS.format("lower(text)")} AS a FROM documents), b AS (SELECT item_id, {_SETS.format("lower(text)")} AS b FROM benchmark),
        p AS (SELECT doc_id, item_id, len(list_intersect(a, b)) AS common, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS jaccard
            FROM d CROSS JOIN b WHERE list_has_any(a, b))
        SELECT doc_id, item_id, common, jaccard, count(*) OVER (PARTITION BY doc_id) AS n_items FROM p
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, item_id) = 1""",
    "q_hash_buckets": f"SELECT ({_bits('text')} % 1000)::INT AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "q_keyed_draws": f"""SELECT doc_id, round({_uniform("'7'", "doc_id::VARCHAR")}, 9) AS u, (100 + floor({_uniform("'7'", "'len'", "doc_id::VARCHAR")} * 1900))::INT AS i,
        ['code', 'sql', 'dialog'][(1 + floor({_uniform("'7'", "'kind'", "doc_id::VARCHAR")} * 3))::INT] AS c, {_uniform("'7'", "'coin'", "doc_id::VARCHAR")} < 0.3 AS b,
        round({_gauss("'7'", "'noise'", "doc_id::VARCHAR")}, 6) AS g FROM documents""",
    "q_sample": f"SELECT doc_id, round({_uniform(chr(39) + 'sample' + chr(39), 'doc_id::VARCHAR')}, 9) AS u FROM documents ORDER BY u, doc_id LIMIT 10",
    "q_synthetic_tasks": "WITH q AS ("
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS task_type, {qs!r}[(1 + floor({_uniform(chr(39) + '1' + chr(39), chr(39) + kind + chr(39), 'i::VARCHAR')} * 10))::INT] AS query FROM range(100) AS r(i)"
        for kind, qs in generators.QUERIES.items()
    )
    + ") SELECT task_type, query, count(*) AS n FROM q GROUP BY ALL",
    "q_noisy_hits": f"WITH {_RUNS_SQL} SELECT task_id, run_id::INT AS run_id, rank::INT AS rank, doc_id, round(dist, 6) AS dist FROM noisy",
    "q_simulated_outputs": f"WITH {_RUNS_SQL} SELECT task_id, run_id::INT AS run_id, output, token_cost FROM runs",
    "q_stability": f"""WITH {_RUNS_SQL} SELECT task_id, task_type, num_runs, unique_contexts, unique_outputs, round(context_stability, 6) AS context_stability,
        round(output_stability, 6) AS output_stability, round(cost_mean, 6) AS cost_mean, round(cost_std, 6) AS cost_std, round(cost_cv, 6) AS cost_cv, cost_min, cost_max, cost_range FROM stability""",
    "q_stability_means": f"WITH {_RUNS_SQL} SELECT {_MEANS} FROM stability",
    "q_stability_by_type": f"WITH {_RUNS_SQL} SELECT task_type, {_MEANS} FROM stability GROUP BY 1",
    "q_stability_points": f"""WITH {_RUNS_SQL} SELECT task_id, task_type, round(context_stability, 6) AS context_stability, round(output_stability, 6) AS output_stability,
        round(cost_cv, 6) AS cost_cv FROM stability""",
    "q_stability_histogram": f"""WITH {_RUNS_SQL}, l AS (SELECT min(context_stability) AS lo, (max(context_stability) - min(context_stability)) / 20 AS w FROM stability)
        SELECT CASE WHEN w > 0 THEN least(floor((context_stability - lo) / w), 19) ELSE 0 END::INT AS bin, count(*) AS n FROM stability CROSS JOIN l GROUP BY 1""",
    "q_cost_cloud": f"""WITH {_RUNS_SQL} SELECT task_id, draw::INT AS draw, round(least(greatest(cost_mean + cost_std * {_gauss("'cloud'", "task_id", "draw::VARCHAR")}, cost_min), cost_max), 4) AS cost
        FROM stability CROSS JOIN range(10) AS r(draw)""",
    "q_distinct_keys": "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL ORDER BY lang",
}
