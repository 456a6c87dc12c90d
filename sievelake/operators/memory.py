"""Memory as a log: versions, compaction, traces and replay, tenants and masks, staleness, injection flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

INJECTION = r"(?i)ignore (all |any )?(previous|prior|above) instructions|disregard (the|all) (system|previous)|you are now|system prompt|<\|im_(start|end)\|>"


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def compaction_effect(log: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Rows before and after compaction, and the share that goes, per group."""
    per_key = log.groupBy(*by, *[k for k in key if k not in by]).agg(F.count(F.lit(1)).alias("c"))
    out = per_key.groupBy(*by).agg(F.sum("c").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
    return out.withColumn("saved", 1 - F.col("rows_after") / F.col("rows_before"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, change) of the rows that were added, removed or changed between two snapshots."""
    a = before.select(F.col(key), value.alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(F.col(key), value.alias("_b"), F.lit(True).alias("_in_b"))
    change = (
        F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def merge_branches(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """Three-way merge of snapshots: (key, value, deleted, conflict) of the rows that are left, and of conflicts.

    A side that changed a row (its value, or whether it is there) wins over one that didn't. If both did and not to the
    same, ours wins and the row is flagged, as deleted if ours deleted it. A null value is a value.
    """
    parts = [d.select(F.col(key), F.col(value).alias(n), F.lit(True).alias(f"in_{n}")) for d, n in ((base, "b"), (ours, "o"), (theirs, "t"))]
    all_ = parts[0].join(parts[1], key, "full").join(parts[2], key, "full")
    state = {n: F.struct(F.coalesce(f"in_{n}", F.lit(False)).alias("there"), F.col(n).alias("v")) for n in "bot"}
    ours_changed, theirs_changed = ~state["o"].eqNullSafe(state["b"]), ~state["t"].eqNullSafe(state["b"])
    clash = ours_changed & theirs_changed & ~state["o"].eqNullSafe(state["t"])
    merged = all_.select(key, F.when(ours_changed, state["o"]).otherwise(state["t"]).alias("_m"), clash.alias("conflict"))
    return merged.select(key, F.col("_m.v").alias(value), (~F.col("_m.there")).alias("deleted"), "conflict").where("conflict or not deleted")


def trace(selected: DataFrame, by: list[str], plan_json: str) -> DataFrame:
    """One trace row per group: a fingerprint of plan and selection, the ids in order, tokens and count."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")
    out = selected.groupBy(*by).agg(ids.alias("doc_ids"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("trace_id", F.md5(F.concat_ws("|", *by, F.lit(plan_json), "doc_ids")))


def pool_fingerprint(docs: DataFrame) -> DataFrame:
    """One row that tells pools apart, whatever their order: count, and sums of two 60-bit parts of each row's md5.

    A null text differs from an empty one. The sums are decimals of any size, given as text.
    """
    d = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text").isNull().cast("int").cast("string"), F.coalesce("text", F.lit(""))))
    part = lambda at: F.sum(F.conv(F.substring(d, at, 15), 16, 10).cast("decimal(28,0)")).cast("string")
    return docs.agg(F.count(F.lit(1)).alias("n"), part(1).alias("sum_a"), part(16).alias("sum_b"))


def replay_diff(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Trace rows that a replay doesn't give again, from either side."""
    cols = recorded.columns
    gone = recorded.exceptAll(replayed.select(*cols)).withColumn("side", F.lit("recorded"))
    new = replayed.select(*cols).exceptAll(recorded).withColumn("side", F.lit("replayed"))
    return gone.unionByName(new)


def for_tenant(docs: DataFrame, tenant: Column, own: str, masked: dict[str, Column]) -> DataFrame:
    """Rows of one tenant, with masked columns: the predicate reaches the scan."""
    seen = docs.where(tenant == own)
    for name, column in masked.items():
        seen = seen.withColumn(name, column)
    return seen


def with_capabilities(docs: DataFrame, grants: DataFrame, agent: str, scope: str, masked: dict[str, Column]) -> DataFrame:
    """What an agent may see: rows whose ``scope`` it was granted to read, masked unless it was granted to unmask them, too.

    ``grants`` has agent, scope and capability ("read" or "unmask"); an agent without a grant sees nothing. Grants of one
    agent are one row per scope after the aggregation, so a document is never repeated.
    """
    own = grants.where(F.col("agent") == agent).groupBy(F.col("scope").alias("_scope")).agg(
        F.bool_or(F.col("capability") == "read").alias("_read"), F.bool_or(F.col("capability") == "unmask").alias("_unmask")
    )
    seen = docs.join(own.where("_read"), docs[scope] == F.col("_scope"))
    for name, column in masked.items():
        seen = seen.withColumn(name, F.when(F.col("_unmask"), F.col(name)).otherwise(column))
    return seen.drop("_scope", "_read", "_unmask")


def injection_flag(text: Column) -> Column:
    return text.rlike(INJECTION)


def stale(log: DataFrame, key: str, time: str, days: int) -> DataFrame:
    """(key, last_seen, stale) with memories unseen for more than ``days`` before the log's last moment."""
    last = log.groupBy(key).agg(F.max(time).alias("last_seen"))
    end = log.agg(F.max(time).alias("_end"))
    return last.crossJoin(F.broadcast(end)).select(  # one row
        key, "last_seen", (F.col("last_seen") < F.col("_end") - F.expr(f"INTERVAL {days} DAYS")).alias("stale")
    )


def scalars(docs: DataFrame) -> DataFrame:
    """The text scalars of every document in one projection."""
    t = F.col("text")
    return docs.select(
        "doc_id",
        F.char_length(t).alias("chars"),
        F.size(X.words(t)).alias("n_words"),
        F.size(X.word_set(t)).alias("n_word_set"),
        F.size(X.word_set(t, lower=False)).alias("n_word_set_cased"),
        F.size(X.word_set(t, first=20)).alias("n_first_set"),
        F.substring(t, 1, 10).alias("prefix"),
    )
