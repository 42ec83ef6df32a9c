"""Window assignment, count triggers and trailing frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed(points: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Points with win_start and win_end, once for each window they fall in."""
    return points.withColumn("w", F.window("ts", size, slide)).withColumns({"win_start": F.col("w.start"), "win_end": F.col("w.end")}).drop("w")


def moving_average(points: DataFrame, size: str, slide: str | None = None, columns: tuple[str, ...] = ("value",), keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Averages per key and window, stamped with the window's end."""
    return points.groupBy(*keys, F.window("ts", size, slide).alias("w")).agg(*(F.avg(c).alias(f"avg_{c}") for c in columns)).select(*keys, F.col("w.end").alias("t"), *(f"avg_{c}" for c in columns))


def count_trigger(points: DataFrame, size: str, n: int, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """What a window has gathered each time another n of its points, in order of (ts, seq), have come.

    Windows that never reach n give nothing: the rule for complete cases.
    """
    by = Window.partitionBy(*keys, "win_start")
    run = by.orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    w = windowed(points, size).withColumns({"fired_at": F.row_number().over(by.orderBy("ts", "seq")), "sum_v": F.sum("value").over(run), "t": F.max("ts").over(run)})
    return w.where(F.col("fired_at") % n == 0).select(*keys, "win_start", "fired_at", "sum_v", "t")


def trailing(points: DataFrame, span_seconds: int, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each point's last span, (t - span, t]; without a time, of all such.

    Time is cut into slices as long as the span; a point goes to its own slice and, to be looked back on, to the next
    one. So a key of any length is dealt to many tasks, for twice the rows. A frame is the start of its own slice and
    the end of the one before: both run on from row to row, so the work doesn't grow with the rows of a frame. Sums and
    squares are put together, never taken away, so no digits cancel and what is not finite stays in its frames.
    """
    us, span = F.unix_micros("ts"), span_seconds * 1_000_000
    p = points.select(*keys, "seq", "ts", "value", us.alias("__us"), F.explode(F.array(F.lit(0), F.lit(1))).alias("__back"))
    p = p.where("__back = 0 or __us is not null").withColumns({"__slice": F.floor(F.col("__us") / span) + F.col("__back"), "__at": F.col("__us") + F.col("__back") * span})
    by = Window.partitionBy(*keys, "__slice")
    start = by.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    end = by.orderBy(F.desc("__at"), "__back").rowsBetween(Window.unboundedPreceding, 0)  # points at t - span come after t
    sides = {}
    for side, over in enumerate((start, end)):
        v = F.when(F.col("__back") == side, F.col("value"))
        sides |= {f"__{name}{side}": f(v).over(over) for name, f in (("n", F.count), ("s", F.sum), ("d", F.var_pop), ("a", F.min), ("b", F.max))}
    n0, n1, n = F.col("__n0"), F.col("__n1"), F.col("__n0") + F.col("__n1")
    none = F.lit(0.0)
    mean = F.try_divide(F.coalesce("__s0", none) + F.coalesce("__s1", none), n)
    apart = F.try_divide("__s1", n1) - F.try_divide("__s0", n0)  # null where a side has no values
    squares = F.coalesce(F.col("__d0") * n0, none) + F.coalesce(F.col("__d1") * n1, none) + F.coalesce(apart * apart * F.try_divide(n0 * n1, n), none)
    stats = {"mean_v": mean, "std_v": F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1))), "min_v": F.least("__a0", "__a1"), "max_v": F.greatest("__b0", "__b1")}
    return p.withColumns(sides).where("__back = 0").select(*keys, "seq", "ts", *(c.alias(name) for name, c in stats.items()))
