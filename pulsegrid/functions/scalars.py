"""Scalar building blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extracted(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one (or if it is empty)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def logistic(constant: float, terms: dict[str, tuple[float, float]]) -> Column:
    """1 / (1 + exp(-(constant + sum of weight * column))), nulls replaced by each column's default."""
    total = F.lit(constant)
    for name, (weight, default) in terms.items():
        total = total + weight * F.coalesce(F.col(name), F.lit(default))
    return 1 / (1 + F.exp(-total))


def ladder(column: Column | str, steps: list[tuple[float, int]], below: bool = False) -> Column:
    """The first step whose bound is reached (or, below, undercut) gives the points; 0 past all, null for null."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for bound, points in steps:
        hit = c < bound if below else c >= bound
        out = F.when(hit, points) if out is None else out.when(hit, points)
    return out.when(c.isNull(), None).otherwise(0)


def within(c: Column, low: float, high: float) -> Column:
    """The value where it lies strictly between two bounds, else null."""
    return F.when((c > low) & (c < high), c)


def hours_between(a: Column, b: Column) -> Column:
    return F.round((F.unix_timestamp(b) - F.unix_timestamp(a)) / 3600)
