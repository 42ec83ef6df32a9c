"""Online z-score: every point is scaled by what came before it, itself included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


def _ahead(df: DataFrame, keys: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """Per key and slice, the sums over all slices before it: one row a slice."""
    by = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__slice").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    return totals.select(*keys, "__slice", *(F.coalesce(F.sum(n).over(by), F.lit(0)).alias(n) for n in sums))


def online_zscore(points: DataFrame, keys: tuple[str, ...] = ("label",), slice_seconds: int | None = None) -> DataFrame:
    """points with z.

    With running mean m of the first n values and running sum s of (x - m)^2, each taken with the mean of its time,
    the deviation is sqrt(s / n) and z = (x - m) / deviation; without deviation x - m where m > 0, else 0. One shuffle
    and one sort serve both running sums.

    slice_seconds: for keys too long for one task. Slices of time are summed first, and each slice runs by itself from
    the sums of those before it; the result is the same but for rounding.
    """
    at = ["__slice"] if slice_seconds else []
    run = Window.partitionBy(*keys, *at).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    p = points
    if slice_seconds:
        p = p.withColumn("__slice", F.floor(F.unix_micros("ts") / (slice_seconds * 1_000_000)))
        p = p.join(_ahead(p, keys, {"__n0": F.when(F.col("value").isNotNull(), 1).otherwise(0), "__s0": F.col("value")}), [*keys, "__slice"])
    else:
        p = p.withColumns({"__n0": F.lit(0), "__s0": F.lit(0.0)})
    p = p.withColumns({"__n": F.col("__n0") + F.count("value").over(run), "__s": F.col("__s0") + F.coalesce(F.sum("value").over(run), F.lit(0.0))})
    p = p.withColumn("__m", F.try_divide("__s", "__n"))
    p = p.withColumn("__d", F.pow(F.col("value") - F.col("__m"), 2))
    if slice_seconds:
        p = p.join(_ahead(p, keys, {"__q0": F.col("__d")}), [*keys, "__slice"])
    else:
        p = p.withColumn("__q0", F.lit(0.0))
    p = p.withColumn("__q", F.col("__q0") + F.sum("__d").over(run))
    sd = F.sqrt(F.try_divide("__q", "__n"))
    off = F.col("value") - F.col("__m")
    z = F.when(sd > 0, F.try_divide(off, sd)).when(F.col("__m") > 0, off).otherwise(F.lit(0.0))
    return p.withColumn("z", z).select(*points.columns, "z")


def zscore_band(points: DataFrame, width: float = 3.0, keys: tuple[str, ...] = ("label",), rewrite: bool = True, slice_seconds: int | None = None) -> DataFrame:
    """Points whose z lies strictly within the band; rewrite: the value becomes z."""
    kept = online_zscore(points, keys, slice_seconds).where((F.col("z") > -width) & (F.col("z") < width))
    return kept.withColumn("value", F.col("z")) if rewrite else kept
