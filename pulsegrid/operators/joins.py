"""Joins over time and the sequences they rest on: always on an equal key first, never all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slice(df: DataFrame, ts: str, seconds: int | None) -> DataFrame:
    """df with __slice: the number of the slice of time that a row falls in, or one slice for all."""
    return df.withColumn("__slice", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) if seconds else F.lit(0).cast("long"))


def _with(df: DataFrame, slices: DataFrame, key: str) -> DataFrame:
    """df with the columns that slices has of each row's key and slice; null keys meet each other."""
    told = slices.withColumnsRenamed({key: "__key", "__slice": "__number"})
    return df.join(told, df[key].eqNullSafe(told["__key"]) & df["__slice"].eqNullSafe(told["__number"])).drop("__key", "__number")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, tolerance_seconds: int, value: str, order: str, slice_seconds: int | None = None) -> DataFrame:
    """left with the value of right's latest row of the same key at most the tolerance before; null without one.

    Both sides are merged in one sequence per key and the last value is carried on: one shuffle, rows stay linear in the
    input where a range join multiplies them. Ties in time go to the higher order.

    slice_seconds: for keys too long for one task. Slices of time run by themselves, from the last value of those before.
    """
    cols = left.columns
    a = left.select(F.struct(*cols).alias("__l"), F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast("timestamp").alias("__vt"), F.lit(None).cast("long").alias("__o"))
    b = right.select(F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.col(ts).cast("timestamp").alias("__vt"), F.col(order).cast("long").alias("__o"))
    both = _slice(a.unionByName(b), "__t", slice_seconds)
    found = F.when(F.col("__side") == 0, F.struct("__v", "__vt"))
    run = Window.partitionBy("__k", "__slice").orderBy("__t", "__side", F.col("__o").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(found, ignorenulls=True).over(run)
    if slice_seconds:
        at = F.when(F.col("__side") == 0, F.struct("__t", F.col("__o").isNull().alias("n"), "__o"))
        ends = both.groupBy("__k", "__slice").agg(F.max_by(found, at).alias("__end"))
        before = F.last("__end", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
        both = _with(both.withColumn("__own", last), ends.select("__k", "__slice", before.alias("__before")), "__k").withColumn("__last", F.coalesce("__own", "__before"))
    else:
        both = both.withColumn("__last", last)
    near = F.unix_micros(F.col("__t").cast("timestamp")) - F.unix_micros("__last.__vt") <= tolerance_seconds * 1_000_000
    return both.where("__side = 1").select("__l.*", F.when(near, F.col("__last.__v")).alias(f"{value}_as_of"), F.when(near, F.col("__last.__vt")).alias("matched_ts"))


def contained(points: DataFrame, spans: DataFrame, key: str, ts: str = "ts", start: str = "start", end: str = "end", how: str = "left") -> DataFrame:
    """points with the spans of the same key that contain them, bounds included."""
    held = spans.withColumnRenamed(key, "__key")
    on = (F.col(key) == F.col("__key")) & (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))
    return points.join(held, on, how).drop("__key")


def previous_within(df: DataFrame, key: str, value: str, hours: int, ts: str = "ts", order: str = "seq", slice_seconds: int | None = None) -> DataFrame:
    """df with the value of the row before, if it is less than so many hours ago. slice_seconds: as in as_of()."""
    row = F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))
    p = _slice(df, ts, slice_seconds)
    p = p.withColumn("__prev", F.lag(row).over(Window.partitionBy(key, "__slice").orderBy(ts, order)))
    if slice_seconds:
        ends = p.groupBy(key, "__slice").agg(F.max_by(row, F.struct(ts, order)).alias("__end"))
        before = F.lag("__end").over(Window.partitionBy(key).orderBy("__slice"))
        p = _with(p, ends.select(key, "__slice", before.alias("__before")), key).withColumn("__prev", F.coalesce("__prev", "__before"))
    near = F.unix_micros(F.col(ts)) - F.unix_micros("__prev.t") < hours * 3_600_000_000
    return p.select(*df.columns, F.when(near, F.col("__prev.v")).alias(f"prev_{value}"))


def sessions(df: DataFrame, key: str, gap_seconds: int, ts: str = "ts", breaks: Column | None = None, slice_seconds: int | None = None) -> DataFrame:
    """df with session: one more where the gap to the row before is over the limit, or `breaks` holds for that row.

    Rows of one time share the session, as a frame by range has it. slice_seconds: as in as_of().
    """
    p = _slice(df, ts, slice_seconds)
    by = Window.partitionBy(key, "__slice").orderBy(ts)
    row = F.struct(F.col(ts).alias("t"), F.coalesce(breaks, F.lit(False)).alias("b") if breaks is not None else F.lit(False).alias("b"))
    p = p.withColumn("__prev", F.lag(row).over(by))
    if slice_seconds:
        ends = p.groupBy(key, "__slice").agg(F.max_by(row, ts).alias("__end"))
        before = F.lag("__end").over(Window.partitionBy(key).orderBy("__slice"))
        p = _with(p, ends.select(key, "__slice", before.alias("__before")), key).withColumn("__prev", F.coalesce("__prev", "__before"))
    gap = F.unix_micros(F.col(ts)) - F.unix_micros("__prev.t") > gap_seconds * 1_000_000
    p = p.withColumn("__new", (F.col("__prev.t").isNull() | gap | F.col("__prev.b")).cast("int")).withColumn("session", F.sum("__new").over(by))
    if slice_seconds:
        sums = p.groupBy(key, "__slice").agg(F.sum("__new").alias("__sum"))
        ahead = F.coalesce(F.sum("__sum").over(Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        p = _with(p, sums.select(key, "__slice", ahead.alias("__ahead")), key).withColumn("session", F.col("session") + F.col("__ahead"))
    return p.select(*df.columns, "session")


def first_row(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key by an order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")
