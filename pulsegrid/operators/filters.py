"""Predicates and projections over signal points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = -1.0


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def present(df: DataFrame, value: str = "value", sentinel: float = MISSING) -> DataFrame:
    """Drop points that hold the sentinel for a missing value."""
    return df.where(F.col(value) != sentinel)


def only(df: DataFrame, *labels: str) -> DataFrame:
    return df.where(F.col("label").isin(*labels))


def band(df: DataFrame, low: float, high: float, column: str = "value") -> DataFrame:
    """Keep what lies strictly between two bounds."""
    return df.where((F.col(column) > low) & (F.col(column) < high))


def defined(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(finite(F.col(value)))


def relabel(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("label", F.concat(F.lit(prefix), F.col("label")))


def unpivot(wide: DataFrame, ids: list[str], columns: list[str], label: str = "label", value: str = "value") -> DataFrame:
    """One row a column of a wide row."""
    return wide.select(*ids, *columns).unpivot(ids, columns, label, value)


def neighbour_outliers(points: DataFrame, size: str, slide: str, reach: float, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """The middle point of each window, kept where it is within `reach` of the mean of the others.

    A window's points are ordered by (ts, seq); the middle is number n / 2 from 0. A point alone has no others and goes.
    """
    w = points.select(*keys, "ts", "seq", "value", F.window("ts", size, slide).alias("w")).select(*keys, F.col("w.start").alias("win_start"), "ts", "seq", "value")
    by = Window.partitionBy(*keys, "win_start")
    w = w.withColumns({"rn": F.row_number().over(by.orderBy("ts", "seq")) - 1, "n": F.count("*").over(by), "s": F.sum("value").over(by)})
    middle = w.where((F.col("rn") == F.floor(F.col("n") / 2)) & (F.col("n") > 1))
    rest = (F.col("s") - F.col("value")) / (F.col("n") - 1)
    return middle.where(F.abs(rest - F.col("value")) < reach).select(*keys, "win_start", "ts", "value")
