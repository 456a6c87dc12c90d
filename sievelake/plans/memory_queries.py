"""Registered queries: selection under budgets, optimiser, graph, hybrid search, memory log, streaming."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget as B
from ..operators import statistics as S
from ..operators import graph, hybrid, memory, retrieval, temporal
from ..sources.tables import table
from ..streaming import memory_metrics
from .context_query import ContextQuery, choose, cost_terms, estimated_cost
from .experiment_queries import same_label_gold
from .inputs import HITS_SQL, TOPK, edges, hits, pool, tasks

BUDGET = 2000


def sized_hits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))
    return hits(spark, d).join(docs, "doc_id").withColumn("relevance", F.round(1 / (1 + F.col("dist")), 9))


def select_prefix(spark, d):
    return B.select_prefix(sized_hits(spark, d), BUDGET, ["task_id"]).select("task_id", "rank", "doc_id", "tokens", "used_tokens")


def select_skipping(spark, d):
    return B.select_skipping(sized_hits(spark, d), BUDGET, ["task_id"])


def select_dense(spark, d):
    return B.select_dense(sized_hits(spark, d), BUDGET, ["task_id"])


def fixed_block(spark, d):
    return B.fixed_block(sized_hits(spark, d), 4, ["task_id"]).groupBy("task_id").agg(F.sum("tokens").alias("tokens"))


def plan_candidates(spark, d):
    gold = same_label_gold(spark, d).groupBy("task_id").agg(F.count(F.lit(1)).alias("n_gold"))
    marked = sized_hits(spark, d).join(same_label_gold(spark, d).withColumn("g", F.lit(1)), ["task_id", "doc_id"], "left")
    per = retrieval.sweep(marked, TOPK).groupBy("task_id", "topk").agg(F.sum("tokens").alias("est_tokens"), F.count("g").alias("common"))
    return per.join(gold, "task_id", "left").select("task_id", "topk", "est_tokens", F.round(F.coalesce(F.col("common") / F.col("n_gold"), F.lit(0.0)), 9).alias("est_recall"))


def cost_model(spark, d):
    """The terms of each candidate's cost, as it is and with summaries of a quarter of its tokens."""
    both = plan_candidates(spark, d).withColumn("summarised", F.explode(F.array(F.lit(False), F.lit(True))))
    read = F.when(F.col("summarised"), F.col("est_tokens")).otherwise(0)
    left = F.when(F.col("summarised"), F.ceil(F.col("est_tokens") / 4)).otherwise(F.col("est_tokens"))
    terms = cost_terms(left, F.col("topk"), read)
    return both.select("task_id", "topk", "summarised", *[c.alias(n) for n, c in terms.items()], estimated_cost(left, F.col("topk"), read).alias("est_cost"))


def optimizer(spark, d):
    return choose(plan_candidates(spark, d), 8000, 0.1)


def context_query(spark, d):
    q = ContextQuery().nearest(10).where("lang = 'en'").without_copies().within(BUDGET)
    return q.run(tasks(spark, d), pool(spark, d), exclude="vec_id").select("task_id", "doc_id", "rank", "tokens")


def graph_hops(spark, d):
    e = edges(spark, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seeds = tasks(spark, d).select("task_id", F.col("vec_id").alias("node"))
    return graph.within_hops(seeds, both, 2, ["task_id"])


def pipeline_plan(spark, d):
    """Vector search, graph expansion, then pruning of copies, and the budget."""
    q = ContextQuery().nearest(5).expand(1).without_copies().within(BUDGET)
    return q.run(tasks(spark, d), pool(spark, d), edges(spark, d), exclude="vec_id").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


def workflow_closure(spark, d):
    """Dependencies between the turns of each conversation, as a chain, up to three steps."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("dst"))
    held = c.join(c.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    return graph.closure(held, 3)


def vector_graph_relational(spark, d):
    """Hits in the task document's language that a label links to the task."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    own = tasks(spark, d).join(docs.withColumnRenamed("doc_id", "vec_id").withColumnRenamed("lang", "own_lang"), "vec_id")
    linked = hits(spark, d).join(same_label_gold(spark, d), ["task_id", "doc_id"], "left_semi")
    return linked.join(docs, "doc_id").join(own.select("task_id", "own_lang"), "task_id").where("lang = own_lang").select("task_id", "rank", "doc_id", "lang")


def prune_copies(spark, d):
    return hybrid.prune_copies(hits(spark, d), table(spark, d, "documents"), ["task_id"]).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


def diverse(spark, d):
    return hybrid.diverse(hits(spark, d), table(spark, d, "documents"), 5, ["task_id"])


def summaries(spark, d):
    found = hybrid.summarise(tasks(spark, d), hits(spark, d).where("rank <= 5"), table(spark, d, "documents"), 2, ["task_id"])
    return found.select("task_id", "doc_id", F.md5("summary").alias("summary_md5"), "score")


def bm25(spark, d):
    found = hybrid.bm25(tasks(spark, d), table(spark, d, "documents"), 10)
    return found.select("task_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def hybrid_search(spark, d):
    text = hybrid.bm25(tasks(spark, d), table(spark, d, "documents"), 20)
    return hybrid.fuse(hits(spark, d), text, 10).select("task_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def trace_rows(spark, d):
    return memory.trace(B.select_prefix(sized_hits(spark, d), BUDGET, ["task_id"]), ["task_id"], "prefix")


def replay(spark, d):
    """Traces that a replay doesn't give again, after documents with an id divisible by five have gone from the pool."""
    changed = B.select_prefix(sized_hits(spark, d).where("doc_id % 5 <> 0"), BUDGET, ["task_id"])
    diff = memory.replay_diff(trace_rows(spark, d), memory.trace(changed, ["task_id"], "prefix"))
    return diff.select("side", "task_id", "doc_ids", "n")


def fingerprint(spark, d):
    return memory.pool_fingerprint(table(spark, d, "documents"))


def snapshot_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    after = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    more = docs.where("doc_id % 11 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    return memory.snapshot_diff(docs, after.unionByName(more), "doc_id", F.md5("text"))


def branch_merge(spark, d):
    """Ours changes and deletes, theirs changes, deletes and sets nulls: all kinds of conflict occur."""
    base = table(spark, d, "documents").select("doc_id", "lang")
    ours = base.where("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang")))
    theirs = base.where("doc_id % 5 <> 0").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "yy").when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("lang")))
    return memory.merge_branches(base, ours, theirs, "doc_id", "lang").groupBy("lang", "deleted", "conflict").agg(F.count(F.lit(1)).alias("n"))


def tenant_view(spark, d):
    seen = memory.for_tenant(table(spark, d, "documents"), F.col("source"), "src0", {"text": F.sha2("text", 256)})
    return seen.select("doc_id", "text", "lang")


def capabilities(spark, d):
    """The documents that agent "a" may read, by grants on sources; texts are masked where it may not see them."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    kinds = F.array(F.lit("read"), F.when(number % 3 == 0, F.lit("unmask")))
    sources = docs.select("source").distinct().where(number % 2 == 0)
    grants = sources.select(F.lit("a").alias("agent"), F.col("source").alias("scope"), F.explode(kinds).alias("capability"))
    return memory.with_capabilities(docs, grants, "a", "source", {"text": F.sha2("text", 256)}).select("doc_id", "source", F.md5("text").alias("text_md5"))


def injection(spark, d):
    return table(spark, d, "documents").select("lang", memory.injection_flag(F.col("text")).cast("int").alias("f")).groupBy("lang").agg(F.sum("f").alias("flagged"), F.count(F.lit(1)).alias("n"))


def stale_users(spark, d):
    found = memory.stale(table(spark, d, "events"), "user_id", "ts", 2)
    return found.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


def compaction(spark, d):
    e = table(spark, d, "events")
    return memory.compaction_effect(e, ["user_id", "event_type"], ["event_type"]).withColumn("saved", F.round("saved", 9))


def latest_state(spark, d):
    last = memory.latest(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type"], ["ts", "event_id"])
    return last.select("user_id", "event_type", "event_id", "value")


def _place(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a temporary one only where all runs in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="memory-")
    return f"{root.rstrip('/')}/memory-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    place = _place(spark)
    return memory_metrics.run_to_table(stream, f"{place}/out", f"{place}/checkpoint")


def batch_growth(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = memory_metrics.growth(e)
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.round("total", 4).alias("total"),
        F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"),
    )


def stream_growth(spark, d):
    """Windows that the stream has closed: those that end before the last event less the lateness allowed."""
    out = _streamed(spark, memory_metrics.growth(memory_metrics.read_events(spark, f"{d}/events.parquet*")))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.round("total", 4).alias("total"))


def batch_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return memory_metrics.sessions(e).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("longest"))


def stream_sessions(spark, d):
    out = _streamed(spark, memory_metrics.sessions(memory_metrics.read_events(spark, f"{d}/events.parquet*")))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"))


def props_json(spark, d):
    kinds = table(spark, d, "events").select("event_type", F.size(F.json_object_keys("props")).alias("n_keys"))
    return kinds.groupBy("event_type").agg(F.sum("n_keys").alias("n_keys"), F.count(F.lit(1)).alias("n"))


def _timed(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def as_of_join(spark, d):
    """Each purchase with the user's last view before it."""
    e = _timed(spark, d)
    kinds = ("purchase", "view")
    bought, seen = (e.where(F.col("event_type") == k) for k in kinds)
    return temporal.as_of(bought, seen, "user_id", "ts", ["event_id", "value"], "event_id").select("event_id", "user_id", "last_event_id", "last_value")


def range_join(spark, d):
    """Pairs of one user's events at most an hour apart, views first and purchases second."""
    e = _timed(spark, d)
    pairs = temporal.within_range(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", 3600)
    return pairs.select("event_id", "event_id_right", "user_id")


def approximate_profile(spark, d):
    """Sketches of event values per type."""
    return S.approximate(table(spark, d, "events"), "value", "user_id", ["event_type"])


def sliding_growth(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return memory_metrics.sliding(e).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n_events", "users")


QUERIES = {
    "q_as_of_join": as_of_join,
    "q_range_join": range_join,
    "q_approximate": approximate_profile,
    "q_sliding": sliding_growth,
    "q_select_prefix": select_prefix,
    "q_select_skipping": select_skipping,
    "q_select_dense": select_dense,
    "q_fixed_block": fixed_block,
    "q_cost_model": cost_model,
    "q_optimizer": optimizer,
    "q_context_query": context_query,
    "q_graph_hops": graph_hops,
    "q_pipeline_plan": pipeline_plan,
    "q_workflow_closure": workflow_closure,
    "q_vector_graph_relational": vector_graph_relational,
    "q_prune_copies": prune_copies,
    "q_diverse": diverse,
    "q_summaries": summaries,
    "q_bm25": bm25,
    "q_hybrid_search": hybrid_search,
    "q_trace": trace_rows,
    "q_replay": replay,
    "q_pool_fingerprint": fingerprint,
    "q_snapshot_diff": snapshot_diff,
    "q_branch_merge": branch_merge,
    "q_tenant_view": tenant_view,
    "q_capabilities": capabilities,
    "q_injection": injection,
    "q_stale": stale_users,
    "q_compaction": compaction,
    "q_latest_state": latest_state,
    "q_growth": batch_growth,
    "q_stream_growth": stream_growth,
    "q_sessions": batch_sessions,
    "q_stream_sessions": stream_sessions,
    "q_event_props": props_json,
}

_SIZED = (
    HITS_SQL
    + """,
sized AS (SELECT h.*, ceil(length(d.text) / 4)::BIGINT AS tokens, round(1 / (1 + dist), 9) AS relevance FROM hits h JOIN documents d USING (doc_id)),
gold AS (SELECT t.task_id, p.doc_id FROM tasks t JOIN pool p ON p.label = t.label AND p.doc_id <> t.vec_id)"""
)
_PREFIX = (
    _SIZED
    + f""",
prefix AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY task_id ORDER BY rank) AS used_tokens FROM sized) WHERE used_tokens <= {BUDGET})"""
)
_PLANS = (
    _SIZED
    + """,
n_gold AS (SELECT task_id, count(*) AS n_gold FROM gold GROUP BY 1),
plans AS (
    SELECT s.task_id, k.topk, sum(tokens)::BIGINT AS est_tokens, round(coalesce(count(g.doc_id) / any_value(n.n_gold), 0), 9) AS est_recall
    FROM sized s JOIN (VALUES (5), (10), (20)) AS k(topk) ON s.rank <= k.topk LEFT JOIN gold g ON g.task_id = s.task_id AND g.doc_id = s.doc_id
    LEFT JOIN n_gold n ON n.task_id = s.task_id GROUP BY s.task_id, k.topk
)"""
)
_GREEDY = """, o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {order}) AS i FROM sized),
picked AS (
    SELECT task_id, i, rank, doc_id, tokens, CASE WHEN tokens <= {budget} THEN tokens ELSE 0 END AS used, tokens <= {budget} AS taken FROM o WHERE i = 1
    UNION ALL
    SELECT o.task_id, o.i, o.rank, o.doc_id, o.tokens, CASE WHEN p.used + o.tokens <= {budget} THEN p.used + o.tokens ELSE p.used END, p.used + o.tokens <= {budget}
    FROM picked p JOIN o ON o.task_id = p.task_id AND o.i = p.i + 1
) SELECT task_id, doc_id, rank, tokens FROM picked WHERE taken"""
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"
_BM25 = f"""
asked AS (SELECT DISTINCT task_id, unnest({_WORDS.format("query")}) AS word FROM tasks),
lens AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
corpus AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM lens),
posts AS (SELECT doc_id, len(w) AS l, unnest(w) AS word FROM lens),
tf AS (SELECT word, doc_id, count(*) AS tf, any_value(l) AS l FROM posts WHERE word IN (SELECT word FROM asked) GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
parts AS (SELECT word, doc_id, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len)) AS part FROM tf JOIN df USING (word) CROSS JOIN corpus),
scored AS (SELECT task_id, doc_id, round(sum(part), 9) AS score FROM asked JOIN parts USING (word) GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored) WHERE rank <= 20)"""
_EDGES = """
edges AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0)"""

SQL = {
    "q_range_join": """SELECT a.event_id, b.event_id AS event_id_right, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
        WHERE a.event_type = 'view' AND b.event_type = 'purchase'""",
    "q_as_of_join": """SELECT p.event_id, p.user_id, v.event_id AS last_event_id, v.value AS last_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN LATERAL
            (SELECT event_id, value FROM events e WHERE e.event_type = 'view' AND e.user_id = p.user_id AND e.ts <= p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true""",
    "q_select_prefix": f"WITH {_PREFIX} SELECT task_id, rank, doc_id, tokens, used_tokens::BIGINT AS used_tokens FROM prefix",
    "q_select_skipping": f"WITH RECURSIVE {_SIZED}" + _GREEDY.format(order="rank", budget=BUDGET),
    "q_select_dense": f"WITH RECURSIVE {_SIZED}" + _GREEDY.format(order="round(relevance / tokens, 9) DESC, rank", budget=BUDGET),
    "q_fixed_block": f"WITH {_SIZED} SELECT task_id, sum(tokens)::BIGINT AS tokens FROM sized WHERE rank <= 4 GROUP BY 1",
    "q_cost_model": f"""WITH {_PLANS}, b AS (SELECT task_id, topk, s AS summarised, CASE WHEN s THEN est_tokens ELSE 0 END AS src, CASE WHEN s THEN ceil(est_tokens / 4) ELSE est_tokens END AS t
            FROM plans CROSS JOIN (VALUES (false), (true)) AS v(s))
        SELECT task_id, topk, summarised, t::DOUBLE AS token_cost, 20.0::DOUBLE * topk AS retrieval_cost, 0.5::DOUBLE * src AS summary_cost, 0.125::DOUBLE * t AS forward_cost,
               1.125::DOUBLE * t + 20.0::DOUBLE * topk + 0.5::DOUBLE * src AS est_cost FROM b""",
    "q_optimizer": f"""WITH {_PLANS} SELECT task_id, topk, est_tokens, est_recall, 1.125::DOUBLE * est_tokens + 20.0::DOUBLE * topk AS est_cost FROM plans
        QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY est_tokens > 8000, CASE WHEN est_tokens > 8000 THEN est_tokens ELSE 0 END,
            CASE WHEN est_recall >= 0.1 THEN 0 ELSE 1 - est_recall END, 1.125::DOUBLE * est_tokens + 20 * topk, topk) = 1""",
    "q_context_query": f"""WITH {HITS_SQL}, en AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY dist, doc_id)::INT AS r FROM distances JOIN documents USING (doc_id) WHERE lang = 'en'),
        once AS (SELECT * FROM en WHERE r <= 10 QUALIFY row_number() OVER (PARTITION BY task_id, text ORDER BY r) = 1),
        used AS (SELECT task_id, doc_id, r AS rank, ceil(length(text) / 4)::BIGINT AS tokens, sum(ceil(length(text) / 4)) OVER (PARTITION BY task_id ORDER BY r) AS used FROM once)
        SELECT task_id, doc_id, rank, tokens FROM used WHERE used <= {BUDGET}""",
    "q_graph_hops": f"""WITH {HITS_SQL}, {_EDGES}, e AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
        h0 AS (SELECT task_id, vec_id AS node FROM tasks), h1 AS (SELECT DISTINCT task_id, dst AS node FROM h0 JOIN e ON src = node),
        h2 AS (SELECT DISTINCT task_id, dst AS node FROM h1 JOIN e ON src = node)
        SELECT task_id, node, min(hop)::INT AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2""",
    "q_pipeline_plan": f"""WITH {HITS_SQL}, {_EDGES}, near AS (SELECT task_id, rank, doc_id FROM hits WHERE rank <= 5),
        more AS (SELECT DISTINCT n.task_id, 6 AS rank, e.dst AS doc_id FROM near n JOIN edges e ON e.src = n.doc_id JOIN tasks t ON t.task_id = n.task_id
            WHERE e.dst IN (SELECT doc_id FROM pool) AND e.dst <> t.vec_id AND NOT EXISTS (SELECT 1 FROM near x WHERE x.task_id = n.task_id AND x.doc_id = e.dst)),
        cands AS (SELECT c.*, d.text FROM (SELECT * FROM near UNION ALL SELECT * FROM more) c JOIN documents d USING (doc_id)
            QUALIFY row_number() OVER (PARTITION BY task_id, text ORDER BY rank, doc_id) = 1),
        used AS (SELECT task_id, ceil(length(text) / 4)::BIGINT AS tokens, sum(ceil(length(text) / 4)) OVER (PARTITION BY task_id ORDER BY rank, doc_id) AS used FROM cands)
        SELECT task_id, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM used WHERE used <= {BUDGET} GROUP BY 1""",
    "q_workflow_closure": """WITH n AS (SELECT conv_id * 1000 + turn AS id FROM conversations), e AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON b.id = a.id + 1),
        e2 AS (SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src), e3 AS (SELECT a.src, b.dst FROM e2 a JOIN e b ON a.dst = b.src)
        SELECT src, dst, min(depth)::INT AS depth FROM (SELECT *, 1 AS depth FROM e UNION ALL SELECT *, 2 FROM e2 UNION ALL SELECT *, 3 FROM e3) GROUP BY 1, 2""",
    "q_vector_graph_relational": f"""WITH {_SIZED} SELECT h.task_id, h.rank, h.doc_id, d.lang FROM hits h JOIN gold USING (task_id, doc_id) JOIN documents d ON d.doc_id = h.doc_id
        JOIN tasks t ON t.task_id = h.task_id JOIN documents o ON o.doc_id = t.vec_id WHERE d.lang = o.lang""",
    "q_prune_copies": f"""WITH {HITS_SQL}, o AS (SELECT h.* FROM hits h JOIN documents d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY task_id, text ORDER BY rank) = 1)
        SELECT task_id, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM o GROUP BY 1""",
    "q_bm25": f"WITH {HITS_SQL}, {_BM25} SELECT task_id, rank, doc_id, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
    "q_hybrid_search": f"""WITH {HITS_SQL}, {_BM25}, f AS (SELECT task_id, doc_id, round(sum(1 / (60 + rank)), 12) AS score
            FROM (SELECT task_id, doc_id, rank FROM hits UNION ALL SELECT task_id, doc_id, rank FROM bm25) GROUP BY 1, 2),
        r AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM f)
        SELECT task_id, rank, doc_id, round(score, 9) AS score FROM r WHERE rank <= 10""",
    "q_trace": f"""WITH {_PREFIX}, t AS (SELECT task_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM prefix GROUP BY 1)
        SELECT *, md5(task_id || '|prefix|' || doc_ids) AS trace_id FROM t""",
    "q_replay": f"""WITH {_PREFIX}, t AS (SELECT task_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids, count(*) AS n FROM prefix GROUP BY 1),
        p2 AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY task_id ORDER BY rank) AS used FROM sized WHERE doc_id % 5 <> 0) WHERE used <= {BUDGET}),
        t2 AS (SELECT task_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids, count(*) AS n FROM p2 GROUP BY 1)
        SELECT 'recorded' AS side, * FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM t2) UNION ALL SELECT 'replayed', * FROM (SELECT * FROM t2 EXCEPT ALL SELECT * FROM t)""",
    "q_pool_fingerprint": """WITH h AS (SELECT md5(doc_id || '|' || (text IS NULL)::INT || '|' || coalesce(text, '')) AS d FROM documents)
        SELECT count(*) AS n, sum(('0x' || d[1:15])::BIGINT)::VARCHAR AS sum_a, sum(('0x' || d[16:30])::BIGINT)::VARCHAR AS sum_b FROM h""",
    "q_snapshot_diff": """WITH a AS (SELECT doc_id, md5(text) AS v FROM documents),
        b AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END) AS v FROM documents WHERE doc_id % 7 <> 0
              UNION ALL SELECT doc_id + 1000000000, md5(text) FROM documents WHERE doc_id % 11 = 0)
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.v IS DISTINCT FROM b.v""",
    "q_branch_merge": """WITH s AS (
            SELECT doc_id, lang AS b, doc_id % 7 <> 0 AS o_in, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END END AS o,
                   doc_id % 5 <> 0 AS t_in, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'yy' WHEN doc_id % 11 = 0 THEN NULL ELSE lang END END AS t FROM documents),
        c AS (SELECT *, (NOT o_in OR o IS DISTINCT FROM b) AS oc, (NOT t_in OR t IS DISTINCT FROM b) AS tc, (o_in <> t_in OR o IS DISTINCT FROM t) AS apart FROM s),
        m AS (SELECT CASE WHEN oc THEN o ELSE t END AS lang, NOT (CASE WHEN oc THEN o_in ELSE t_in END) AS deleted, oc AND tc AND apart AS conflict FROM c)
        SELECT lang, deleted, conflict, count(*) AS n FROM m WHERE conflict OR NOT deleted GROUP BY ALL""",
    "q_tenant_view": "SELECT doc_id, sha256(text) AS text, lang FROM documents WHERE source = 'src0'",
    "q_capabilities": """WITH s AS (SELECT *, regexp_extract(source, '(\\d+)$', 1)::INT AS k FROM documents WHERE regexp_matches(source, '\\d$'))
        SELECT doc_id, source, md5(CASE WHEN k % 3 = 0 THEN text ELSE sha256(text) END) AS text_md5 FROM s WHERE k % 2 = 0""",
    "q_injection": f"""SELECT lang, sum(regexp_matches(text, '{memory.INJECTION}')::INT)::BIGINT AS flagged, count(*) AS n FROM documents GROUP BY 1""",
    "q_stale": """WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1)
        SELECT user_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, last_seen < (SELECT max(ts) FROM events) - INTERVAL 2 DAYS AS stale FROM l""",
    "q_compaction": """SELECT event_type, count(*) AS rows_before, count(DISTINCT user_id) AS rows_after, round(1 - count(DISTINCT user_id) / count(*), 9) AS saved FROM events GROUP BY 1""",
    "q_latest_state": """SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "q_growth": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread
        FROM events GROUP BY 1, 2""",
    "q_stream_growth": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAYS GROUP BY 1, 2""",
    "q_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS longest FROM c GROUP BY 1""",
    "q_stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, max(ts) + INTERVAL 30 MINUTES AS ends FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS n_sessions FROM c WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 2 DAYS GROUP BY 1""",
    "q_event_props": "SELECT event_type, sum(len(json_keys(props)))::BIGINT AS n_keys, count(*) AS n FROM events GROUP BY 1",
}
