"""Distribution statistics and chart frames: percentiles, CDFs, bins, histograms, pivots, box plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, rows, before, total) of each different value: rows below it and rows of its group.

    The window runs over different values, after a partial aggregation, so a group with a third of all rows is as small
    as the number of its values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*by)
    before = F.sum("rows").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    return counts.select(*by, value, "rows", before.alias("before"), F.sum("rows").over(w).alias("total"))


def percentiles(df: DataFrame, value: str, by: list[str], points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Percentiles as the element at place min(n * p div 100, n - 1) of the sorted values, one column each."""
    counts = value_counts(df, value, by)

    def at(p: int) -> Column:
        place = F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1)
        return (F.col("before") <= place) & (place < F.col("before") + F.col("rows"))

    return counts.groupBy(*by).agg(*[F.max(F.when(at(p), F.col(value))).alias(f"p{p}") for p in points])


def percentile_ratios(df: DataFrame) -> DataFrame:
    return df.withColumn("p95_p50", F.col("p95") / F.col("p50")).withColumn("p99_p50", F.col("p99") / F.col("p50"))


def cdf(df: DataFrame, value: str, by: list[str], ties: list[str]) -> DataFrame:
    """Empirical distribution: each row's place among its group's values, in percent; ties get steps of their own."""
    placed = df.where(F.col(value).isNotNull()).join(value_counts(df, value, by), [*by, value])
    among = F.row_number().over(Window.partitionBy(*by, value).orderBy(*ties))
    return placed.select(*by, *ties, value, ((F.col("before") + among) / F.col("total") * 100).alias("cdf"))


def spread(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, population variance and coefficient of variation (0 where the mean isn't above 0)."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("_s"))
    return out.select(*by, "mean", "variance", F.when(F.col("mean") > 0, F.col("_s") / F.col("mean")).otherwise(0.0).alias("cv"))


def pivot(df: DataFrame, row: str, column: str, values: list, cell: Column) -> DataFrame:
    """One row per ``row``, one column per value, named c<value>."""
    out = df.groupBy(row).pivot(column, values).agg(cell)
    return out.select(row, *[F.col(f"`{v}`").alias(f"c{v}") for v in values])


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def box(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles (interpolated) and whiskers: the extreme values within 1.5 interquartile ranges."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, by).where((F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach))
    ends = inside.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return q.join(ends, by)


def edges(low: float, width: float, n: int) -> list[float]:
    return [low + i * width for i in range(n + 1)]


def bin_of(x: Column, low: float, width: float, n: int) -> Column:
    """Number of the right-closed bin ]low + i * width, low + (i + 1) * width] that holds a value; null outside."""
    bounds = edges(low, width, n)
    i = F.ceil((x - low) / width).cast("int") - 1
    # the quotient may round across an edge: compare with the edges themselves
    table = F.array(*[F.lit(b) for b in bounds])
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), i))
    at = F.when(x <= F.element_at(table, at + 1), at - 1).when(x > F.element_at(table, at + 2), at + 1).otherwise(at)
    return F.when((x > bounds[0]) & (x <= bounds[-1]), at)


def binned(df: DataFrame, value: str, low: float, width: float, n: int) -> DataFrame:
    """``df`` with bin and center (both null where the value lies outside)."""
    b = df.withColumn("bin", bin_of(F.col(value), low, width, n))
    return b.withColumn("center", F.round(F.lit(low) + (F.col("bin") + 0.5) * width, 6))


def bin_means(df: DataFrame, value: str, target: str, low: float, width: float, n: int) -> DataFrame:
    """Mean of ``target`` and row count of every bin, empty bins kept."""
    spark = df.sparkSession
    agg = binned(df, value, low, width, n).where("bin is not null").groupBy("bin").agg(X.exact_mean(F.col(target)).alias("mean"), F.count(F.lit(1)).alias("n"))
    return spark.range(n).select(F.col("id").cast("int").alias("bin")).join(agg, "bin", "left").select("bin", "mean", F.coalesce("n", F.lit(0)).alias("n"))


def center_means(df: DataFrame, value: str, target: str, by: list[str], low: float, width: float, n: int, least: int = 3) -> DataFrame:
    """Mean of ``target`` per group and bin center, for bins with ``least`` rows or more."""
    agg = binned(df, value, low, width, n).where("bin is not null").groupBy(*by, "center").agg(X.exact_mean(F.col(target)).alias("mean"), F.count(F.lit(1)).alias("n"))
    return agg.where(F.col("n") >= least)


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 20, density: bool = False) -> DataFrame:
    """Equal bins over each group's range, the last closed on both sides; count or density of each."""
    some = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*by) if by else None
    if w is None:
        lims = some.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
        rows = some.crossJoin(F.broadcast(lims))  # one row
    else:
        lims = some.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
        rows = some.join(lims, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    out = rows.select(*by, place.cast("int").alias("bin"), "_n", width.alias("_w"))
    out = out.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("_n").alias("_n"), F.first("_w").alias("_w"))
    if density:
        return out.select(*by, "bin", F.when(F.col("_w") > 0, F.col("n") / (F.col("_n") * F.col("_w"))).otherwise(0.0).alias("density"))
    return out.select(*by, "bin", "n")


def class_means(df: DataFrame, column: str, classes: list[str], means: dict[str, str]) -> DataFrame:
    """Count and means per class, every class present even if it has no row."""
    agg = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), *[X.exact_mean(F.col(v)).alias(k) for k, v in means.items()])
    frame = df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    return frame.join(agg, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"), *means)


def approximate(df: DataFrame, value: str, distinct: str, by: list[str], points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Rows, about how many different ``distinct`` (HyperLogLog++, 2 %) and about which percentiles, by mergeable sketches."""
    at = F.percentile_approx(value, list(points), 10_000)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(distinct, 0.02).alias("n_distinct"), at.alias("_p"))
    return out.select(*by, "n", "n_distinct", *[F.col("_p")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(points)])
