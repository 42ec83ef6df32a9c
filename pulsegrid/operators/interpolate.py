"""Interpolation of one value a window at its expected time.

The expected time is the middle of the window, moved by how far the first point is off the grid: with r its distance
from the start and step the grid's width, by r mod step, or, if that is 0 and r isn't, by one step. A point exactly there
is taken as it is. Points are ordered by (ts, seq).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.windows import windowed


def expected_us(start: Column, end: Column, first: Column, steps: int) -> Column:
    """Expected time in microseconds, from three of them."""
    step = F.floor((end - start) / 1000 / steps) * 1000
    r = first - start
    d = r % step
    shift = F.when(d > 0, d).when(r == 0, F.lit(0)).otherwise(step)
    return (start + F.floor((end - start) / 2) + shift).cast("long")


def _at(points: DataFrame, size: str, slide: str, steps: int, keys: tuple[str, ...]) -> DataFrame:
    """Windowed points with us (their time) and expected (their window's)."""
    w = windowed(points, size, slide)
    us, start, end = F.unix_micros("ts"), F.unix_micros("win_start"), F.unix_micros("win_end")
    w = w.withColumn("us", us).withColumn("first", F.min("us").over(Window.partitionBy(*keys, "win_start")))
    return w.withColumn("expected", expected_us(start, end, F.col("first"), steps))


def interpolate(points: DataFrame, size: str, slide: str, steps: int, mode: str = "linear", keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """One point a window: keys, win_start, t, value. mode: linear, locf, nocb.

    linear: between the last point before and the first after; one alone is copied. locf, nocb: the one before, the one
    after. Without what a mode needs the value is 0. Window function and aggregation share one shuffle.
    """
    w = _at(points, size, slide, steps, keys)
    order = F.struct("us", "seq")
    before, here, after = (F.when(c, F.col("value")) for c in (F.col("us") < F.col("expected"), F.col("us") == F.col("expected"), F.col("us") > F.col("expected")))
    has = lambda c: F.when(c, order)
    agg = w.groupBy(*keys, "win_start", "expected").agg(
        F.min_by(here, has(F.col("us") == F.col("expected"))).alias("x"),
        F.max_by(before, has(F.col("us") < F.col("expected"))).alias("a"), F.max(F.when(F.col("us") < F.col("expected"), F.col("us"))).alias("at"),
        F.min_by(after, has(F.col("us") > F.col("expected"))).alias("b"), F.min(F.when(F.col("us") > F.col("expected"), F.col("us"))).alias("bt"),
    )
    a, b = F.col("a"), F.col("b")
    if mode == "linear":
        share = (F.col("expected") - F.col("at")) / (F.col("bt") - F.col("at"))
        value = F.coalesce(F.when(a.isNotNull() & b.isNotNull(), a + share * (b - a)), a, b, F.lit(0.0))
    else:
        value = F.coalesce({"locf": a, "nocb": b}[mode], F.lit(0.0))
    return agg.select(*keys, "win_start", F.timestamp_micros("expected").alias("t"), F.coalesce("x", value).alias("value"))


def weighted(points: DataFrame, size: str, slide: str, n: int, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """One point a window: keys, win_start, t, value, by neighbours weighted by 2 ^ (n - d), d their whole minutes away.

    The expected time is n / 2 minutes (a whole number) after the window's start, moved back by how far the first point is
    off a grid of tenths of the window. A point exactly there is taken as it is. A window of n points or more gives its
    point number n / 2 from 0. Without a neighbour on one side that side weighs nothing.
    """
    w = windowed(points, size, slide)
    by = Window.partitionBy(*keys, "win_start")
    start, step = F.unix_micros("win_start"), F.floor((F.unix_micros("win_end") - F.unix_micros("win_start")) / 1000 / 10) * 1000
    w = w.withColumns({"us": F.unix_micros("ts"), "start": start, "step": step, "rn": F.row_number().over(by.orderBy("ts", "seq")) - 1})
    r = F.min("us").over(by) - F.col("start")
    off = F.when(r == 0, 0).when(r % F.col("step") > 0, r % F.col("step")).otherwise(F.col("step"))
    w = w.withColumn("at", (F.col("start") - off + n // 2 * 60_000_000).cast("long"))
    point, order = F.struct("us", "value"), F.struct("us", "seq")
    when = lambda c, x: F.when(c, x)
    before, here, after = F.col("us") < F.col("at"), F.col("us") == F.col("at"), F.col("us") > F.col("at")
    agg = w.groupBy(*keys, "win_start", "at").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("rn") == n // 2, point)).alias("middle"), F.min_by(when(here, point), when(here, order)).alias("here"),
        F.max_by(when(before, point), when(before, order)).alias("a"), F.min_by(when(after, point), when(after, order)).alias("b"),
    )
    weight = lambda x: F.coalesce(F.pow(F.lit(2.0), n - F.floor(F.abs(F.col(f"{x}.us") - F.col("at")) / 60_000_000)), F.lit(0.0))
    mean = F.try_divide(weight("a") * F.coalesce("a.value", F.lit(0.0)) + weight("b") * F.coalesce("b.value", F.lit(0.0)), weight("a") + weight("b"))
    full = F.when(F.col("n") >= n, F.col("middle"))
    return agg.select(*keys, "win_start", F.timestamp_micros(F.coalesce(full["us"], F.col("at"))).alias("t"), F.coalesce(full["value"], F.col("here.value"), mean).alias("value"))


def natural_spline(x: np.ndarray, y: np.ndarray, at: float) -> float:
    """Natural cubic spline through (x, y) at a point; 0 under three knots or outside them. Equal x keep the first."""
    x, first = np.unique(x, return_index=True)
    y = y[first]
    if len(x) < 3 or not x[0] <= at <= x[-1]:
        return 0.0
    h = np.diff(x)
    slope = np.diff(y) / h
    diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope)
    upper = h[1:-1].copy()
    for i in range(1, len(diagonal)):
        f = upper[i - 1] / diagonal[i - 1]
        diagonal[i] -= f * upper[i - 1]
        right[i] -= f * right[i - 1]
    m = np.zeros(len(x))
    for i in range(len(diagonal) - 1, -1, -1):
        m[i + 1] = (right[i] - (upper[i] * m[i + 2] if i < len(upper) else 0)) / diagonal[i]
    k = min(int(np.searchsorted(x, at, "right")) - 1, len(h) - 1)
    a, b = x[k + 1] - at, at - x[k]
    return float((m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b)


def spline(points: DataFrame, size: str, slide: str, steps: int, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """As interpolate(), by a natural cubic spline through all the window's points."""
    w = _at(points, size, slide, steps, keys)
    rows = w.groupBy(*keys, "win_start", "expected").agg(F.array_sort(F.collect_list(F.struct("us", "seq", "value"))).alias("p"))
    rows = rows.select(*keys, "win_start", F.timestamp_micros("expected").alias("t"), F.transform("p", lambda p: ((p["us"] - F.col("expected")) / 60e6).cast("double")).alias("x"), F.transform("p", lambda p: p["value"]).alias("y"))

    @F.pandas_udf("double")
    def value(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in parts:
            yield pd.Series([natural_spline(np.asarray(x, float), np.asarray(y, float), 0.0) for x, y in zip(xs, ys, strict=True)])

    return rows.withColumn("value", value("x", "y")).drop("x", "y")
