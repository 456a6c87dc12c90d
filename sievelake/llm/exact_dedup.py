"""Exact deduplication as a stateful stream (DataFrame operations only).

A log of (digest, identifier, content locator) is streamed through a keyed aggregation whose state
lies in RocksDB, on disk and checkpointed to the shared folder, without watermark or expiry: per
digest the stable identifier of the row that stays, the locator of its content and the number of
rows. The state is then read back as a table. Every hit (a row whose digest another row already
owns) is checked byte for byte against the content at the locator; digests for which a check fails
are grouped by their full texts instead, so that a collision never merges different texts.

Null text counts as empty, so null and '' are copies of each other. The largest ``doc_id`` stays.
A row that repeats both id and text of another is told apart by its locator (file and row index), so exactly
one stays. A null id sorts lowest. An empty table gives an empty result.
Other columns are ignored by :func:`exact_groups` and passed through by :func:`exact_dedup`.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, fresh_path, located, text_or_empty, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one group that one task checks against the kept content at most; larger groups are salted.
CHECK_ROWS = 4096
#: Rows of groups of several that are broadcast at most to fetch their texts (under 100 bytes each).
BROADCAST_ROWS = 200_000
#: Log files that one micro-batch takes in; after a failure the stream goes on from the last one.
FILES_PER_BATCH = 20_000

KEYS = ["_file", "_row", "_id"]


def sha256_binary(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def rocksdb(spark: SparkSession):
    """Keep streaming state in RocksDB while the block runs, without space set aside on disk for each partition."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def stream_state(log: DataFrame, log_path: str, place: str) -> DataFrame:
    """Stream the log at ``log_path`` into keyed state at ``place`` and return the state as a table."""
    spark = log.sparkSession
    with rocksdb(spark):
        keyed = (
            spark.readStream.schema(log.schema)
            .option("maxFilesPerTrigger", FILES_PER_BATCH)
            .parquet(log_path)
            .groupBy("_digest")
            .agg(
                F.max(F.coalesce("_id", F.lit(-(2**63)))).alias("keep"),
                F.max_by("_file", F.coalesce("_id", F.lit(-(2**63)))).alias("keep_file"),
                F.max_by("_row", F.coalesce("_id", F.lit(-(2**63)))).alias("keep_row"),
                F.count(F.lit(1)).alias("n"),
            )
        )
        query = (
            keyed.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", place)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(place)
    # The value holds the aggregation buffers in order; two share a name, so they are renamed by position.
    names = ["keep", "keep_file", "file_id", "keep_row", "row_id", "n"]
    value = F.col("value").cast("struct<" + ", ".join(f"{x}: bigint" for x in names) + ">")
    return state.select(F.col("key._digest").alias("_digest"), value.alias("v")).select(
        "_digest",
        F.col("v.keep").alias("_keep"),
        F.col("v.keep_file").alias("_keep_file"),
        F.col("v.keep_row").alias("_keep_row"),
        F.col("v.n").alias("_n"),
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_binary
) -> DataFrame:
    """One row per row of ``docs``: its id, locator, digest, the id that stays and the group's size.

    ``digest`` maps the text to a binary key; any collision it has is found by the byte check.
    """
    return groups_of(located(docs), id_col, text_col, digest)


def groups_of(placed: DataFrame, id_col: str, text_col: str, digest=sha256_binary) -> DataFrame:
    """:func:`exact_groups` of rows with their locators."""
    spark = placed.sparkSession
    rows = placed.select(
        F.col("_doc")[id_col].cast("long").alias("_id"), "_file", "_row", text_or_empty(F.col("_doc")[text_col]).alias("_text")
    )
    log_path, place = fresh_path(spark, "dedup-log"), fresh_path(spark, "dedup-state")
    rows.select("_id", "_file", "_row", digest(F.col("_text")).alias("_digest")).write.parquet(log_path)
    log = spark.read.parquet(log_path)
    groups = log.join(stream_state(log, log_path, place), "_digest").withColumn(
        "_kept",
        F.coalesce("_id", F.lit(-(2**63))).eqNullSafe(F.col("_keep"))
        & (F.col("_file") == F.col("_keep_file"))
        & (F.col("_row") == F.col("_keep_row")),
    )
    groups = written(groups, "dedup-groups")
    delete(spark, log_path)
    delete(spark, place)
    broken = mismatches(rows, groups)
    if not broken.isEmpty():
        groups = regrouped(rows, groups, broken)
    return groups.withColumn("_keep", F.when(F.col("_keep") > F.lit(-(2**63)), F.col("_keep")))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return (
        (left["_file"] == right["_file"]) & (left["_row"] == right["_row"]) & left["_id"].eqNullSafe(right["_id"])
    )


def mismatches(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests with a row whose full text differs from the content at the group's locator."""
    several = groups.where("_n > 1").select(*KEYS, "_digest", "_n", "_kept")
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    full = rows.join(several, same_row(rows, several)).select(
        several["_digest"], several["_n"], several["_kept"], rows["_id"], rows["_row"], rows["_text"]
    )
    salts = F.ceil(F.col("_n") / F.lit(CHECK_ROWS))
    hits = full.where("not _kept").select(
        "_digest", F.pmod(F.xxhash64("_id", "_row"), salts).alias("_salt"), F.col("_text").alias("_hit")
    )
    kept = full.where("_kept").select(
        "_digest", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"), "_text"
    )
    return hits.join(kept, ["_digest", "_salt"]).where("_hit <> _text").select("_digest").distinct()


def regrouped(rows: DataFrame, groups: DataFrame, broken: DataFrame) -> DataFrame:
    """Group the rows of colliding digests by their full texts."""
    odd = groups.join(broken, "_digest", "left_semi").select(*KEYS, "_digest")
    full = rows.join(odd, same_row(rows, odd)).select(*[rows[c] for c in (*KEYS, "_text")], odd["_digest"])
    order = F.struct(F.coalesce("_id", F.lit(-(2**63))).alias("i"), F.col("_file").alias("f"), F.col("_row").alias("r"))
    best = full.groupBy("_text").agg(F.max(order).alias("_best"), F.count(F.lit(1)).alias("_n"))
    mended = full.join(best, "_text").select(
        "_digest", *KEYS, F.col("_best.i").alias("_keep"), F.col("_best.f").alias("_keep_file"),
        F.col("_best.r").alias("_keep_row"), "_n",
        (order == F.col("_best")).alias("_kept"),
    )
    return groups.join(broken, "_digest", "left_anti").unionByName(mended)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one of each group of equal texts, with its columns as they were."""
    placed = located(docs)
    gone = groups_of(placed, id_col, text_col).where("not _kept").select("_file", "_row")
    return placed.join(gone, ["_file", "_row"], "left_anti").select("_doc.*")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
