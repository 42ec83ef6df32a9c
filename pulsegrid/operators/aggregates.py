"""Windowed aggregates of signal points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_stats(points: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Mean, population deviation, extrema and last time of each key and event-time window.

    NaN values take no part in the extrema; the window is half-open and aligned to the epoch.
    """
    number = F.when(~F.isnan("value"), F.col("value"))
    return points.groupBy(*keys, F.window("ts", size, slide).alias("w")).agg(
        F.avg("value").alias("mean_v"), F.stddev_pop("value").alias("stdev_v"), F.min(number).alias("min_v"), F.max(number).alias("max_v"), F.max("ts").alias("last_ts"), F.count("*").alias("n")
    ).select(*keys, F.col("w.start").alias("win_start"), "mean_v", "stdev_v", "min_v", "max_v", "last_ts", "n")


def last_of_window(points: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """The last point of each key and window, by (ts, seq)."""
    last = F.max_by(F.struct("ts", "seq", "value"), F.struct("ts", "seq")).alias("last")
    return points.groupBy(*keys, F.window("ts", size, slide).alias("w")).agg(last).select(*keys, F.col("w.start").alias("win_start"), "last.ts", "last.seq", "last.value")
