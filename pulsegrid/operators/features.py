"""Window features: differences, correlation and entropy, and the assembly of feature rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.filters import finite
from pulsegrid.operators.windows import windowed


def delta(points: DataFrame, size: str, slide: str, keys: tuple[str, ...] = ("label",), prefix: str = "delta") -> DataFrame:
    """Second value minus first of each window, in order of (ts, seq); windows of one point give none.

    t is the second point's time; seq its seq, so that the result is again a table of points.
    """
    by = Window.partitionBy(*keys, "win_start").orderBy("ts", "seq")
    w = windowed(points, size, slide).withColumns({"rn": F.row_number().over(by), "before": F.lag("value").over(by)})
    out = w.where(F.col("rn") == 2)
    return out.select(*(F.concat(F.lit(prefix), F.col(k)).alias(k) if k == "label" else F.col(k) for k in keys), "win_start", "ts", "seq", (F.col("value") - F.col("before")).alias("value"))


def delta_delta(points: DataFrame, size: str, slide: str, then: str | None = None, keys: tuple[str, ...] = ("label",), prefix: str = "delta") -> DataFrame:
    """delta() of delta(): what a window gives has the window's last instant as its event time, and so falls in windows
    of `then` (or size) each slide. ts is the later difference's own time."""
    first = delta(points, size, slide, keys, prefix)
    at = F.col("first_start") + F.expr(f"INTERVAL {size}") - F.expr("INTERVAL '0.000001' SECOND")
    timed = first.withColumnsRenamed({"ts": "own", "win_start": "first_start"}).withColumns({"ts": at, "seq": F.unix_micros("first_start")})
    by = Window.partitionBy(*keys, "win_start").orderBy("ts", "seq")
    w = windowed(timed, then or size, slide).withColumns({"rn": F.row_number().over(by), "before": F.lag("value").over(by)})
    return w.where(F.col("rn") == 2).select(*(F.concat(F.lit(prefix), F.col(k)).alias(k) if k == "label" else F.col(k) for k in keys), "win_start", F.col("own").alias("ts"), "seq", (F.col("value") - F.col("before")).alias("value"))


def correlation(points: DataFrame, size: str, pairs: list[tuple[str, str]], slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation (population) of two signals per window: the k-th point of one goes with the k-th of the other.

    What is longer is cut, but the means divide by the first signal's number of points, so unequal numbers lower the
    result. Rows whose correlation isn't defined are left out. A signal may be paired with itself.

    Signals stand side by side once, a row a window and place, and one aggregate has the sums of all pairs.
    """
    labels = sorted({x for p in pairs for x in p})
    by = Window.partitionBy(*keys, "label", "win_start")
    w = windowed(points.where(F.col("label").isin(*labels)), size, slide).withColumns({"rn": F.row_number().over(by.orderBy("ts", "seq")), "n": F.count("*").over(by)})
    of = lambda i, c: F.max(F.when(F.col("label") == labels[i], F.col(c)))
    wide = w.groupBy(*keys, "win_start", "rn").agg(*(of(i, "value").alias(f"v{i}") for i in range(len(labels))), *(of(i, "n").alias(f"n{i}") for i in range(len(labels))))
    sums = []
    for j, (a, b) in enumerate(pairs):
        ia, ib = labels.index(a), labels.index(b)
        x, y = F.col(f"v{ia}"), F.col(f"v{ib}")
        both = x.isNotNull() & y.isNotNull()
        parts = {"n": F.max(F.when(both, F.col(f"n{ia}"))), **{k: F.sum(F.when(both, v)) for k, v in {"x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y}.items()}}
        sums.append(F.struct(F.lit(f"Corr{a}{b}").alias("label"), *(v.alias(k) for k, v in parts.items())).alias(f"p{j}"))
    s = wide.groupBy(*keys, "win_start").agg(*sums).select(*keys, "win_start", F.explode(F.array(*(F.col(f"p{j}") for j in range(len(pairs))))).alias("p")).select(*keys, "win_start", "p.*")
    n = F.col("n")
    cov = F.col("xy") / n - F.col("x") * F.col("y") / (n * n)
    var = (F.col("xx") / n - F.col("x") * F.col("x") / (n * n)) * (F.col("yy") / n - F.col("y") * F.col("y") / (n * n))
    value = F.try_divide(cov, F.sqrt(F.when(var > 1e-9, var)))
    return s.select(*keys, "label", "win_start", value.alias("value")).where(finite(F.col("value")))


def multiscale_entropy(series: np.ndarray, r: float, tau: int, m_max: int) -> list[tuple[int, int, float]]:
    """(scale, m, entropy), both from 0: sample entropies of the means of 1 ... tau points for lengths below m_max.

    The tolerance is r times the population deviation of the whole series; a last group that is short is divided by the
    full scale. Where matches are missing, the entropy of one match in all pairs stands.
    """
    out = []
    tolerance = r * float(np.std(series)) if len(series) else 0.0
    for scale in range(1, tau + 1):
        edge = np.arange(0, len(series), scale)
        x = np.add.reduceat(series, edge) / scale if len(series) else series
        n = len(x) - m_max
        matches = np.zeros(m_max + 1, np.int64)
        for i in range(n):
            rest = np.arange(i + 1, n)
            for k in range(m_max):
                rest = rest[np.abs(x[rest + k] - x[i + k]) <= tolerance]
                matches[k + 1] += len(rest)
        for m in range(1, m_max):
            if matches[m] and matches[m + 1]:
                value = -np.log(matches[m + 1] / matches[m])
            else:
                value = np.log(float(n * (n - 1))) if n > 1 else np.nan
            out.append((scale - 1, m - 1, float(value)))
    return out


def sample_entropy(series: np.ndarray, m: int, r: float) -> float:
    """Of distinct pairs of distinct templates: -ln(matches of m + 1 over matches of m), by whole division; 0 without any."""
    def pairs(k: int) -> int:
        templates = sorted({tuple(series[i : i + k]) for i in range(len(series) - k + 1)})
        return sum(max(abs(a - b) for a, b in zip(p, q, strict=True)) <= r for p, q in combinations(templates, 2))

    b = pairs(m)
    if not b:
        return 0.0
    a = pairs(m + 1) // b
    return float("inf") if not a else float(-np.log(a))


def entropy(points: DataFrame, size: str, slide: str | None = None, *, r: float = 0.01, tau: int = 1, m_max: int = 2, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Multiscale entropy of each window: keys, win_start, scale, m, value; values that aren't defined are left out."""
    rows = windowed(points, size, slide).groupBy(*keys, "win_start").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "value"))).alias("p"))
    rows = rows.select(*keys, "win_start", F.transform("p", lambda p: p["value"]).alias("x"))

    @F.pandas_udf("array<struct<scale:int,m:int,value:double>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in parts:
            yield pd.Series([[{"scale": s, "m": m, "value": v} for s, m, v in multiscale_entropy(np.asarray(x, float), r, tau, m_max)] for x in xs])

    out = rows.select(*keys, "win_start", F.explode(of("x")).alias("e"))
    return out.select(*keys, "win_start", "e.scale", "e.m", "e.value").where(finite(F.col("value")))


def feature_rows(features: DataFrame, labels: list[str], key: str = "t", complete: bool = True) -> DataFrame:
    """One row a time with a column a label, in the order given; of several values the last (by value) counts.

    complete: only rows that have every label, the rule of complete cases.
    """
    wide = features.groupBy(key).pivot("label", labels).agg(F.max("value"))
    return wide.dropna(subset=labels) if complete else wide
