"""Joins on time: the latest earlier row (as of), and rows within a range, without a pass over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tie: str) -> DataFrame:
    """``left`` with each of ``values`` of the last row of ``right`` that has the same key and no later time.

    Both sides are put in one order per key and the last seen row of ``right`` is carried along: one shuffle on the key,
    no pairs. At one time the right side comes first, and of several its largest ``tie`` is taken. Names that both
    sides have come from the left; the carried ones are prefixed with ``last_``.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    seen = F.struct(*[F.col(f"`{v}`").alias(f"last_{v}") for v in values])
    kinds = left.select(own.alias("l")).schema["l"].dataType, right.select(seen.alias("s")).schema["s"].dataType
    a = left.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_tie"), own.alias("_left"), F.lit(None).cast(kinds[1]).alias("_seen"))
    b = right.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(0).alias("_side"), F.col(tie).cast("bigint").alias("_tie"), F.lit(None).cast(kinds[0]).alias("_left"), seen.alias("_seen"))
    w = Window.partitionBy("_key").orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_last", F.last("_seen", ignorenulls=True).over(w))
    return carried.where("_side = 1").select("_left.*", "_last.*")


def within_range(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int, suffix: str = "_right") -> DataFrame:
    """Pairs of one key whose times are at most ``seconds`` apart, the right side no earlier.

    Time is cut into buckets of that width: a left row meets the right rows of its own bucket and the next, so this is
    an equi-join on key and bucket, with the exact condition on top. The right side's columns get a suffix.
    """
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    b = right.select(*[F.col(f"`{c}`").alias(c + suffix) for c in right.columns], bucket.alias("_bucket_right"))
    apart = F.unix_micros(F.col(time + suffix).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    on = (F.col(key) == F.col(key + suffix)) & (F.col("_bucket") == F.col("_bucket_right"))
    return a.join(b, on).where(apart.between(0, seconds * 1_000_000)).drop("_bucket", "_bucket_right")
