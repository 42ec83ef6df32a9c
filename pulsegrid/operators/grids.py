"""Dense grids, fills and the checks that go before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_grid(spans: DataFrame, step: str, start: str = "start", end: str = "end") -> DataFrame:
    """One row a step of each span, from one step after its start to its end."""
    width = F.expr(f"INTERVAL {step}")
    at = F.when(F.col(start) + width <= F.col(end), F.sequence(F.col(start) + width, F.col(end), width))
    return spans.withColumn("t", F.explode(at))


def overlay(grid: DataFrame, samples: DataFrame, key: str, t: str, value: str, order: str) -> DataFrame:
    """grid with the samples' values at equal times; of several the one of the highest order counts."""
    one = samples.groupBy(key, t).agg(F.max_by(value, order).alias(value))
    return grid.join(one, [key, t], "left")


def bounded_fill(df: DataFrame, key: str, value: str, rows: int, *order: str) -> DataFrame:
    """Carry values forward, up to so many rows past the last value there is."""
    by = Window.partitionBy(key)
    run = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__rn", F.row_number().over(by.orderBy(*order)))
    df = df.withColumn("__last", F.max(F.when(F.col(value).isNotNull(), F.col("__rn"))).over(by))
    carried = F.last(value, ignorenulls=True).over(run)
    return df.withColumn(f"{value}_filled", F.when(F.col("__rn") <= F.col("__last") + rows, carried)).drop("__rn", "__last")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(a_start, b_start) <= F.least(a_end, b_end)


def consistent_rate(df: DataFrame, key: str, rate: str, *order: str) -> DataFrame:
    """Rows whose rate is that of their key's first row."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("__first", F.first(rate).over(by)).where(F.col(rate) == F.col("__first")).drop("__first")


def missing_share(df: DataFrame, keys: list[str], length: Column, whole: Column) -> DataFrame:
    """100 minus the percentage of the whole that the lengths cover."""
    return df.groupBy(*keys).agg((100 - F.sum(length) * 100 / F.max(whole)).alias("missing_pct"))


def all_there(names: Column, required: list[str]) -> Column:
    """Whether an array of names has all that are required; names lose spaces and % and become upper case."""
    plain = F.transform(names, lambda n: F.regexp_replace(F.upper(n), r"[\s%]", ""))
    return F.size(F.array_except(F.array(*map(F.lit, required)), plain)) == 0


def reformat(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """The text form that streams read: HH:mm:ss dd/MM/yyyy first, -1.0 for what is missing."""
    return df.select(F.concat_ws(",", F.date_format(ts, "HH:mm:ss dd/MM/yyyy"), *(F.coalesce(F.col(c), F.lit(-1.0)).cast("string") for c in columns)).alias("line"))


def rmse(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, keys: list[str]) -> DataFrame:
    return a.join(b, on).groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(x) - F.col(y), 2))).alias("rmse"))


def rmse_table(truth: DataFrame, guesses: dict[str, DataFrame], on: list[str], value: str, share: str) -> DataFrame:
    """One row a share of missing values, a column a method: the error of each method's values against the truth.

    truth and every guess have the columns `on`, value; guesses have `share` too. What a method gives no value for doesn't
    count.
    """
    known = truth.select(*on, F.col(value).alias("__truth"))
    long = [g.select(*on, share, F.col(value).alias("__guess")).join(known, on).groupBy(share).agg(F.sqrt(F.avg(F.pow(F.col("__guess") - F.col("__truth"), 2))).alias("rmse")).withColumn("method", F.lit(name)) for name, g in guesses.items()]
    return reduce(DataFrame.unionByName, long).groupBy(share).pivot("method", list(guesses)).agg(F.first("rmse"))


def inject_missing(df: DataFrame, value: str, p: float, seed: int, *ids: str) -> DataFrame:
    """Set the value to the sentinel with probability p, by a hash of the row's ids and the seed."""
    u = F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1_000_000)) / 1e6
    return df.withColumn(value, F.when(u < p, F.lit(-1.0)).otherwise(F.col(value)))
