"""Hourly severity scores, set-based: a grid of hours per stay, events put in their hour, one aggregate a component.

Hour h of a stay holds events from one second after its start up to and including its end. Events find their hour by
arithmetic and an equi-join, where a range join would hold each event against every hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import ladder


def hour_grid(stays: DataFrame, key: str, start: str, hours: int | Column) -> DataFrame:
    """stays with one row an hour, hr from 0."""
    last = F.lit(hours - 1) if isinstance(hours, int) else hours.cast("int") - 1
    return stays.withColumn("hr", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))


def in_hours(events: DataFrame, stays: DataFrame, key: str, ts: str, start: str) -> DataFrame:
    """events with the hour of the stay that they fall in; within the first second of an hour they fall in none."""
    off = F.unix_micros(F.col(ts)) - F.unix_micros(F.col(start))
    hour = F.lit(3_600_000_000)
    e = events.join(stays.select(key, start), key).withColumn("__off", off)
    part = F.pmod(F.col("__off"), hour)
    hr = F.when(part == 0, F.floor(F.col("__off") / hour) - 1).when(part >= 1_000_000, F.floor(F.col("__off") / hour))
    return e.withColumn("hr", hr.cast("int")).where(F.col("hr").isNotNull()).drop("__off", start)


def total(df: DataFrame, components: list[str], name: str = "score") -> DataFrame:
    """The sum of the components, where what wasn't measured counts as 0 and stays null itself."""
    return df.withColumn(name, sum((F.coalesce(c, F.lit(0)) for c in components), F.lit(0)))


def onset(scores: DataFrame, key: str, hour: str, score: str, rise: int) -> DataFrame:
    """Each key's first hour whose score is at least `rise` over that of its first hour."""
    by = Window.partitionBy(key).orderBy(hour)
    up = scores.withColumn("__base", F.first(score).over(by)).where(F.col(score) - F.col("__base") >= rise)
    return up.groupBy(key).agg(F.min(hour).alias(hour))


def signal_scores(points: DataFrame, hours: int | None = 72) -> DataFrame:
    """The hourly score of each entity's signals, in the form of the clinical one: over its first hours, or (None) over
    all hours that it has points in, whole ones rounded as the clinical stays are."""
    stays = points.groupBy("entity").agg(F.min("ts").alias("start"), F.max("ts").alias("__end"))
    if hours is None:
        hours = F.col("hours")
        stays = stays.withColumn("hours", F.greatest(F.lit(1), F.round((F.unix_timestamp("__end") - F.unix_timestamp("start")) / 3600)).cast("int"))
    e = in_hours(points, stays, "entity", "ts", "start")
    pick = lambda k: F.when(F.col("label") == k, F.col("value"))
    agg = e.groupBy("entity", "hr").agg(F.max(pick("view")).alias("v"), F.min(pick("click")).alias("c"), F.sum(pick("error")).alias("e"))
    grid = hour_grid(stays, "entity", "start", hours).join(agg, ["entity", "hr"], "left")
    scored = grid.select("entity", "hr", ladder("v", [(120.0, 4), (80.0, 3), (40.0, 2), (20.0, 1)]).alias("s_view"), ladder("c", [(5.0, 4), (10.0, 3), (20.0, 2), (50.0, 1)], below=True).alias("s_click"), ladder("e", [(100.0, 4), (50.0, 3), (25.0, 2), (10.0, 1)]).alias("s_error"))
    return total(scored, ["s_view", "s_click", "s_error"])


def sofa_components(hourly: DataFrame) -> DataFrame:
    """The six organ scores and their total from hourly extrema.

    hourly: pao2fio2_vent, pao2fio2_novent (lowest), platelet (lowest), bilirubin (highest), meanbp (lowest), dopamine,
    epinephrine, norepinephrine, dobutamine (highest rates), gcs (lowest), creatinine (highest), urine (sum). Order of the
    rungs matters; what is null falls through. The rungs are the published ones of the score (fixed values); urine has
    the daily limits.
    """
    c = F.col
    any_ = lambda *names: F.coalesce(*map(F.col, names)).isNull()
    s = {
        "respiration": F.when(c("pao2fio2_vent") < 100, 4).when(c("pao2fio2_vent") < 200, 3).when(c("pao2fio2_novent") < 300, 2).when(c("pao2fio2_novent") < 400, 1).when(any_("pao2fio2_vent", "pao2fio2_novent"), None).otherwise(0),
        "coagulation": ladder("platelet", [(20.0, 4), (50.0, 3), (100.0, 2), (150.0, 1)], below=True),
        "liver": ladder("bilirubin", [(12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1)]),
        "cardiovascular": F.when((c("dopamine") > 15) | (c("epinephrine") > 0.1) | (c("norepinephrine") > 0.1), 4).when((c("dopamine") > 5) | (c("epinephrine") <= 0.1) | (c("norepinephrine") <= 0.1), 3).when((c("dopamine") > 0) | (c("dobutamine") > 0), 2).when(c("meanbp") < 70, 1).when(any_("meanbp", "dopamine", "dobutamine", "epinephrine", "norepinephrine"), None).otherwise(0),
        "cns": F.when(c("gcs").between(13, 14), 1).when(c("gcs").between(10, 12), 2).when(c("gcs").between(6, 9), 3).when(c("gcs") < 6, 4).when(c("gcs").isNull(), None).otherwise(0),
        "renal": F.when(c("creatinine") >= 5, 4).when(c("urine") < 200, 4).when(c("creatinine") >= 3.5, 3).when(c("urine") < 500, 3).when(c("creatinine") >= 2, 2).when(c("creatinine") >= 1.2, 1).when(any_("urine", "creatinine"), None).otherwise(0),
    }
    return total(hourly.withColumns(s), list(s), "sofa")


def hourly_sofa(stays: DataFrame, events: DataFrame, *, hours: int | Column = 72, start: str = "start") -> DataFrame:
    """Hourly scores of stays (icustay_id, start) from narrow events (icustay_id, charttime, label, value).

    Labels are the columns that sofa_components() asks for; each is brought to its lowest, highest or sum within the hour.
    """
    how = {"pao2fio2_vent": F.min, "pao2fio2_novent": F.min, "platelet": F.min, "bilirubin": F.max, "meanbp": F.min, "dopamine": F.max, "epinephrine": F.max, "norepinephrine": F.max, "dobutamine": F.max, "gcs": F.min, "creatinine": F.max, "urine": F.sum}
    e = in_hours(events, stays, "icustay_id", "charttime", start)
    agg = e.groupBy("icustay_id", "hr").agg(*(f(F.when(F.col("label") == k, F.col("value"))).alias(k) for k, f in how.items()))
    grid = hour_grid(stays, "icustay_id", start, hours).join(agg, ["icustay_id", "hr"], "left")
    return sofa_components(grid)


def gcs(scores: DataFrame, keys: tuple[str, ...] = ("icustay_id",)) -> DataFrame:
    """Coma scale per (icustay_id, charttime) from motor, verbal, eyes; verbal 0 stands for an intubated patient.

    Rows before are those of the same keys: with the hour among them, none of an earlier hour.

    Intubated: 15. Else what is missing comes from the row before, if that is less than 6 hours old; after an intubated
    row, and without any, from the defaults 6, 5 and 4.
    """
    by = Window.partitionBy(*keys).orderBy("charttime")
    near = F.unix_micros("charttime") - F.unix_micros(F.lag("charttime").over(by)) < 6 * 3_600_000_000
    prev = {k: F.when(near, F.lag(k).over(by)) for k in ("motor", "verbal", "eyes")}
    df = scores.withColumns({f"p_{k}": v for k, v in prev.items()})
    full = {"motor": 6, "verbal": 5, "eyes": 4}
    carried = sum((F.coalesce(F.col(k), F.col(f"p_{k}"), F.lit(d)) for k, d in full.items()), F.lit(0))
    fresh = sum((F.coalesce(F.col(k), F.lit(d)) for k, d in full.items()), F.lit(0))
    return df.withColumn("gcs", F.when(F.col("verbal") == 0, 15).when(F.col("verbal").isNull() & (F.col("p_verbal") == 0), 15).when(F.col("p_verbal") == 0, fresh).otherwise(carried)).drop(*(f"p_{k}" for k in full))
