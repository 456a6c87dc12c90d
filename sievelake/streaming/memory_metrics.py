"""Memory growth, sessions and success over time as Structured Streaming queries on an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The event log as a stream, with ts as a timestamp. ``path`` may be a pattern; a single file needs one."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def growth(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Writes, value and latency stability per window and event type; works on streams and tables."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread")
    )
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total", "mean", "spread")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions per user: events closer than ``gap`` belong together."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def sliding(events: DataFrame, window: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", window, step).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("window_start"), "n_events", "users")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, write it as Parquet, and read the result."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
