"""Queries over the events table as signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.catalog import query, signals
from pulsegrid.operators import aggregates, features, filters, grids, interpolate, joins, normalize, windows

POINTS = "SELECT event_type AS label, ts, value, event_id AS seq, user_id AS entity FROM events"


def sliding(size_minutes: int, slide_minutes: int) -> str:
    """SQL: points p with win_start, once for each window they fall in."""
    n = size_minutes // slide_minutes
    return f"""p AS ({POINTS}), w AS (SELECT p.*, time_bucket(INTERVAL {slide_minutes} MINUTE, ts, TIMESTAMP '1970-01-01') - k.k * INTERVAL {slide_minutes} MINUTE AS win_start FROM p, (SELECT unnest(range({n})) AS k) k)"""


@query(
    "tumbling_stats",
    """SELECT event_type AS label, time_bucket(INTERVAL 1 HOUR, ts) AS win_start, round(avg(value), 6) AS mean_v,
       round(stddev_pop(value), 6) AS stdev_v, min(value) AS min_v, max(value) AS max_v, max(ts) AS last_ts, count(*) AS n
       FROM events GROUP BY 1, 2""",
)
def tumbling_stats(spark, sf_dir):
    return aggregates.window_stats(signals(spark, sf_dir), "1 hour").withColumns({"mean_v": F.round("mean_v", 6), "stdev_v": F.round("stdev_v", 6)})


@query("sliding_stats", f"""WITH {sliding(120, 30)} SELECT label, win_start, round(avg(value), 6) AS mean_v, round(stddev_pop(value), 6) AS stdev_v,
  min(value) AS min_v, max(value) AS max_v, max(ts) AS last_ts, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_stats(spark, sf_dir):
    return aggregates.window_stats(signals(spark, sf_dir), "120 minutes", "30 minutes").withColumns({"mean_v": F.round("mean_v", 6), "stdev_v": F.round("stdev_v", 6)})


@query("thousand_minute_stats", """SELECT event_type AS label, time_bucket(INTERVAL 1000 MINUTE, ts, TIMESTAMP '1970-01-01') AS win_start, round(avg(value), 6) AS mean_v,
  round(stddev_pop(value), 6) AS stdev_v, min(value) AS min_v, max(value) AS max_v, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1, 2""")
def thousand_minute_stats(spark, sf_dir):
    return aggregates.window_stats(signals(spark, sf_dir), "1000 minutes").withColumns({"mean_v": F.round("mean_v", 6), "stdev_v": F.round("stdev_v", 6)})


@query("moving_avg_end_ts", "SELECT event_type AS label, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS t, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
def moving_avg_end_ts(spark, sf_dir):
    return windows.moving_average(signals(spark, sf_dir), "6 hours").withColumns({"avg_value": F.round("avg_value", 6)})


@query("count_trigger", f"""WITH p AS ({POINTS}), r AS (SELECT label, time_bucket(INTERVAL 6 HOUR, ts) AS win_start, ts, seq, value,
  row_number() OVER w AS fired_at, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS sum_v, max(ts) OVER (w ROWS UNBOUNDED PRECEDING) AS t
  FROM p WINDOW w AS (PARTITION BY label, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, seq))
  SELECT label, win_start, fired_at::INTEGER AS fired_at, round(sum_v, 6) AS sum_v, t FROM r WHERE fired_at % 5 = 0""")
def count_trigger(spark, sf_dir):
    return windows.count_trigger(signals(spark, sf_dir), "6 hours", 5).withColumns({"sum_v": F.round("sum_v", 6)})


@query("rolling_trailing", f"""WITH p AS ({POINTS}) SELECT label, seq, ts, round(avg(value) OVER w, 6) AS mean_v, round(stddev_samp(value) OVER w, 6) AS std_v,
  min(value) OVER w AS min_v, max(value) OVER w AS max_v FROM p
  WINDOW w AS (PARTITION BY label ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)""")
def rolling_trailing(spark, sf_dir):
    return windows.trailing(signals(spark, sf_dir), 6 * 3600).withColumns({"mean_v": F.round("mean_v", 6), "std_v": F.round("std_v", 6)})


@query("missing_filter", "SELECT event_id AS seq, value FROM events WHERE value <> -1.0 AND event_type = 'view' AND value IS NOT NULL AND isfinite(value)")
def missing_filter(spark, sf_dir):
    return filters.defined(filters.only(filters.present(signals(spark, sf_dir)), "view")).select("seq", "value")


@query("band_filter", "SELECT event_id AS seq, event_type AS label, value FROM events WHERE value > 50 AND value < 150")
def band_filter(spark, sf_dir):
    return filters.band(signals(spark, sf_dir), 50, 150).select("seq", "label", "value")


@query("relabel", "SELECT 'delta' || event_type AS label, count(*) AS n FROM events GROUP BY 1")
def relabel(spark, sf_dir):
    return filters.relabel(signals(spark, sf_dir), "delta").groupBy("label").agg(F.count("*").alias("n"))


@query("neighbour_outlier", f"""WITH {sliding(360, 360)}, o AS (SELECT *, row_number() OVER (PARTITION BY label, win_start ORDER BY ts, seq) - 1 AS rn,
  count(*) OVER (PARTITION BY label, win_start) AS n, sum(value) OVER (PARTITION BY label, win_start) AS s FROM w)
  SELECT label, win_start, ts, value FROM o WHERE rn = n // 2 AND n > 1 AND abs((s - value) / (n - 1) - value) < 20""")
def neighbour_outlier(spark, sf_dir):
    return filters.neighbour_outliers(signals(spark, sf_dir), "360 minutes", "360 minutes", 20.0)


ZSCORE = f"""p AS ({POINTS}), a AS (SELECT *, sum(value) OVER w / count(value) OVER w AS m, count(value) OVER w AS n FROM p
  WINDOW w AS (PARTITION BY label ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, sqrt(sum(pow(value - m, 2)) OVER (PARTITION BY label ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / n) AS sd FROM a),
  z AS (SELECT *, CASE WHEN sd > 0 THEN (value - m) / sd WHEN m > 0 THEN value - m ELSE 0 END AS z FROM b)"""


@query("online_zscore", f"WITH {ZSCORE} SELECT label, seq, round(z, 6) + 0.0 AS z FROM z")
def online_zscore(spark, sf_dir):
    return normalize.online_zscore(signals(spark, sf_dir), slice_seconds=7 * 86_400).select("label", "seq", (F.round("z", 6) + 0.0).alias("z"))


@query("zscore_outlier_band", f"WITH {ZSCORE} SELECT label, seq, round(z, 6) + 0.0 AS value FROM z WHERE z > -2 AND z < 2")
def zscore_outlier_band(spark, sf_dir):
    return normalize.zscore_band(signals(spark, sf_dir), 2.0).select("label", "seq", (F.round("value", 6) + 0.0).alias("value"))


def interpolation_sql(mode: str) -> str:
    value = {"linear": "coalesce(a + (ex - at_) / (bt - at_) * (b - a), a, b, 0.0)", "locf": "coalesce(a, 0.0)", "nocb": "coalesce(b, 0.0)"}[mode]
    return f"""WITH {sliding(180, 60)}, f AS (SELECT *, epoch_us(ts) AS us, epoch_us(min(ts) OVER (PARTITION BY label, win_start)) - epoch_us(win_start) AS rel FROM w),
  e AS (SELECT *, epoch_us(win_start) + 5400000000 + CASE WHEN rel % 60000000 > 0 THEN rel % 60000000 WHEN rel = 0 THEN 0 ELSE 60000000 END AS ex FROM f),
  g AS (SELECT label, win_start, ex, arg_min(value, us) FILTER (us = ex) AS x, arg_max(value, us) FILTER (us < ex) AS a, (max(us) FILTER (us < ex))::DOUBLE AS at_,
  arg_min(value, us) FILTER (us > ex) AS b, (min(us) FILTER (us > ex))::DOUBLE AS bt FROM e GROUP BY ALL)
  SELECT label, win_start, make_timestamp(ex) AS t, round(coalesce(x, {value}), 6) AS value FROM g"""


def _interpolated(mode):
    def run(spark, sf_dir):
        return interpolate.interpolate(signals(spark, sf_dir), "180 minutes", "60 minutes", 180, mode).withColumn("value", F.round("value", 6))

    return run


for _mode in ("linear", "locf", "nocb"):
    query(f"interp_{_mode}", interpolation_sql(_mode))(_interpolated(_mode))


# Of 180 minutes a tenth is 18; of 12 points expected, the middle is 6 minutes after the start, less the offset.
@query("interp_weighted", f"""WITH {sliding(180, 180)}, f AS (SELECT *, epoch_us(ts) AS us, epoch_us(win_start) AS s, epoch_us(min(ts) OVER q) - epoch_us(win_start) AS r, row_number() OVER (q ORDER BY ts, seq) - 1 AS rn FROM w WINDOW q AS (PARTITION BY label, win_start)),
  o AS (SELECT *, s + 360000000 - CASE WHEN r = 0 THEN 0 ELSE r - 1080000000 * ((r + 1080000000 - 1) // 1080000000 - 1) END AS at_ FROM f),
  g AS (SELECT label, win_start, at_, count(*) AS n, max(value) FILTER (rn = 6) AS mv, max(us) FILTER (rn = 6) AS mt, arg_min(value, (us, seq)) FILTER (us = at_) AS hit,
    arg_max(value, (us, seq)) FILTER (us < at_) AS a, max(us) FILTER (us < at_) AS ta, arg_min(value, (us, seq)) FILTER (us > at_) AS b, min(us) FILTER (us > at_) AS tb FROM o GROUP BY ALL),
  h AS (SELECT *, CASE WHEN ta IS NULL THEN 0 ELSE pow(2.0, 12 - (at_ - ta) // 60000000) END AS wa, CASE WHEN tb IS NULL THEN 0 ELSE pow(2.0, 12 - (tb - at_) // 60000000) END AS wb FROM g)
  SELECT label, win_start, make_timestamp(CASE WHEN n >= 12 THEN mt ELSE at_ END) AS t, round(CASE WHEN n >= 12 THEN mv WHEN hit IS NOT NULL THEN hit ELSE (wa * coalesce(a, 0) + wb * coalesce(b, 0)) / (wa + wb) END, 6) AS value FROM h""")
def interp_weighted(spark, sf_dir):
    return interpolate.weighted(signals(spark, sf_dir), "180 minutes", "180 minutes", 12).withColumn("value", F.round("value", 6))


@query("interp_spline")
def interp_spline(spark, sf_dir):
    return interpolate.spline(signals(spark, sf_dir), "360 minutes", "60 minutes", 360).withColumn("value", F.round("value", 6))


DELTA = f"{sliding(360, 60)}, d AS (SELECT 'delta' || label AS label, win_start, ts, seq, value - lag(value) OVER o AS value, row_number() OVER o AS rn FROM w WINDOW o AS (PARTITION BY label, win_start ORDER BY ts, seq))"


@query("delta", f"WITH {DELTA} SELECT label, win_start, round(value, 6) + 0.0 AS value FROM d WHERE rn = 2")
def delta(spark, sf_dir):
    return features.delta(signals(spark, sf_dir), "360 minutes", "60 minutes").select("label", "win_start", (F.round("value", 6) + 0.0).alias("value"))


@query("delta_delta", f"""WITH {DELTA}, p2 AS (SELECT label, win_start + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND AS ts, epoch_us(win_start) AS seq, value FROM d WHERE rn = 2),
  w2 AS (SELECT p2.*, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') - k.k * INTERVAL 60 MINUTE AS w2s FROM p2, (SELECT unnest(range(2)) AS k) k),
  d2 AS (SELECT 'delta' || label AS label, w2s AS win_start, value - lag(value) OVER o AS value, row_number() OVER o AS rn FROM w2 WINDOW o AS (PARTITION BY label, w2s ORDER BY ts, seq))
  SELECT label, win_start, round(value, 6) + 0.0 AS value FROM d2 WHERE rn = 2""")
def delta_delta(spark, sf_dir):
    found = features.delta_delta(signals(spark, sf_dir), "360 minutes", "60 minutes", "120 minutes")
    return found.select("label", "win_start", (F.round("value", 6) + 0.0).alias("value"))


def correlation_sql(labels: list[tuple[str, str]], size: int = 1440, slide: int = 1440) -> str:
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in labels)
    return f"""WITH {sliding(size, slide)}, o AS (SELECT *, row_number() OVER (PARTITION BY label, win_start ORDER BY ts, seq) AS rn, count(*) OVER (PARTITION BY label, win_start) AS n FROM w),
  s AS (SELECT x.label AS la, y.label AS lb, x.win_start, max(x.n)::DOUBLE AS n, sum(x.value) AS x, sum(y.value) AS y, sum(x.value * y.value) AS xy, sum(x.value * x.value) AS xx, sum(y.value * y.value) AS yy
  FROM (VALUES {pairs}) v(a, b) JOIN o x ON x.label = a JOIN o y ON y.label = b AND y.win_start = x.win_start AND y.rn = x.rn GROUP BY ALL),
  r AS (SELECT *, (xx / n - x * x / (n * n)) * (yy / n - y * y / (n * n)) AS var FROM s)
  SELECT 'Corr' || la || lb AS label, win_start, round((xy / n - x * y / (n * n)) / sqrt(var), 5) AS value FROM r WHERE var > 1e-9"""


KINDS = ("click", "error", "purchase", "signup", "view")
PAIRS = [(a, b) for i, a in enumerate(KINDS) for b in KINDS[i + 1 :]]


@query("window_corr", correlation_sql([("click", "view")]))
def window_corr(spark, sf_dir):
    return features.correlation(signals(spark, sf_dir), "1440 minutes", [("click", "view")]).withColumn("value", F.round("value", 5))


@query("corr_all_pairs", correlation_sql(PAIRS))
def corr_all_pairs(spark, sf_dir):
    return features.correlation(signals(spark, sf_dir), "1440 minutes", PAIRS).withColumn("value", F.round("value", 5))


@query("corr_sliding", correlation_sql([("click", "view"), ("view", "error")], 720, 60))
def corr_sliding(spark, sf_dir):
    return features.correlation(signals(spark, sf_dir), "720 minutes", [("click", "view"), ("view", "error")], "60 minutes").withColumn("value", F.round("value", 5))


SELF = f"""SELECT c.label, c.win_start, c.value, s.stdev_v FROM ({correlation_sql([("view", "view")], 720, 120)}) c
  LEFT JOIN (WITH {{zscore}}, b2 AS (SELECT * FROM z WHERE z > -2 AND z < 2 AND label = 'view'),
  w AS (SELECT b2.*, time_bucket(INTERVAL 120 MINUTE, ts, TIMESTAMP '1970-01-01') - k.k * INTERVAL 120 MINUTE AS win_start FROM b2, (SELECT unnest(range(6)) AS k) k)
  SELECT win_start, round(stddev_pop(value), 6) AS stdev_v FROM w GROUP BY 1) s USING (win_start)""".replace("{zscore}", ZSCORE)


@query("self_correlation", SELF)
def self_correlation(spark, sf_dir):
    from pulsegrid.plans.pipeline import self_correlation as run

    corr, deviation = run(signals(spark, sf_dir), "view", "720 minutes", "120 minutes")
    return corr.withColumn("value", F.round("value", 5)).join(deviation.select("win_start", F.round("stdev_v", 6).alias("stdev_v")), "win_start", "left").select("label", "win_start", "value", "stdev_v")


@query("last_of_window", f"WITH p AS ({POINTS}) SELECT label, time_bucket(INTERVAL 6 HOUR, ts) AS win_start, max(ts) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(value, (ts, seq)) AS value FROM p GROUP BY 1, 2")
def last_of_window(spark, sf_dir):
    return aggregates.last_of_window(signals(spark, sf_dir), "6 hours")


@query("entropy_sliding", f"""WITH {sliding(1440, 360)}, o AS (SELECT label, win_start, value, row_number() OVER q AS rn, lead(value) OVER q AS nxt,
  count(*) OVER (PARTITION BY label, win_start) AS n, stddev_pop(value) OVER (PARTITION BY label, win_start) AS sd FROM w WINDOW q AS (PARTITION BY label, win_start ORDER BY ts, seq)),
  g AS (SELECT a.label, a.win_start, a.n - 2 AS k, count(*) FILTER (abs(a.value - b.value) <= 0.2 * a.sd) AS c1,
  count(*) FILTER (abs(a.value - b.value) <= 0.2 * a.sd AND abs(a.nxt - b.nxt) <= 0.2 * a.sd) AS c2
  FROM o a JOIN o b ON a.label = b.label AND a.win_start = b.win_start AND a.rn < b.rn AND b.rn <= b.n - 2 GROUP BY ALL)
  SELECT label, win_start, round(CASE WHEN c1 > 0 AND c2 > 0 THEN -ln(c2 / c1) ELSE ln(k * (k - 1)) END, 6) + 0.0 AS value FROM g WHERE k > 1""")
def entropy_sliding(spark, sf_dir):
    return features.entropy(signals(spark, sf_dir), "1440 minutes", "360 minutes", r=0.2).select("label", "win_start", (F.round("value", 6) + 0.0).alias("value"))


@query("mse_entropy", f"""WITH {sliding(1440, 1440)}, o AS (SELECT label, win_start, value, row_number() OVER q AS rn, lead(value) OVER q AS nxt,
  count(*) OVER (PARTITION BY label, win_start) AS n, stddev_pop(value) OVER (PARTITION BY label, win_start) AS sd FROM w WINDOW q AS (PARTITION BY label, win_start ORDER BY ts, seq)),
  g AS (SELECT a.label, a.win_start, a.n - 2 AS k, count(*) FILTER (abs(a.value - b.value) <= 0.2 * a.sd) AS c1,
  count(*) FILTER (abs(a.value - b.value) <= 0.2 * a.sd AND abs(a.nxt - b.nxt) <= 0.2 * a.sd) AS c2
  FROM o a JOIN o b ON a.label = b.label AND a.win_start = b.win_start AND a.rn < b.rn AND b.rn <= b.n - 2 GROUP BY ALL)
  SELECT label, win_start, 0 AS scale, 0 AS m, round(CASE WHEN c1 > 0 AND c2 > 0 THEN -ln(c2 / c1) ELSE ln(k * (k - 1)) END, 6) + 0.0 AS value FROM g WHERE k > 1""")
def mse_entropy(spark, sf_dir):
    return features.entropy(signals(spark, sf_dir), "1440 minutes", r=0.2).withColumn("value", F.round("value", 6) + 0.0)


@query("multiscale_entropy")
def multiscale_entropy(spark, sf_dir):
    return features.entropy(signals(spark, sf_dir), "2880 minutes", r=0.2, tau=3, m_max=4).withColumn("value", F.round("value", 6))


@query("process_signal", f"""WITH i AS ({interpolation_sql("linear")[0:0]}{interpolation_sql("linear").replace("round(coalesce", "(coalesce").replace(", 6) AS value", ") AS value")}),
  a AS (SELECT *, sum(value) OVER w / count(value) OVER w AS m, count(value) OVER w AS n FROM i WINDOW w AS (PARTITION BY label ORDER BY t, win_start ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, sqrt(sum(pow(value - m, 2)) OVER (PARTITION BY label ORDER BY t, win_start ROWS UNBOUNDED PRECEDING) / n) AS sd FROM a),
  z AS (SELECT *, CASE WHEN sd > 0 THEN (value - m) / sd WHEN m > 0 THEN value - m ELSE 0 END AS z FROM b)
  SELECT label, win_start, round(z, 5) + 0.0 AS value FROM z WHERE z > -3 AND z < 3""")
def process_signal(spark, sf_dir):
    from pulsegrid.plans.pipeline import process_signal as run

    return run(signals(spark, sf_dir), "180 minutes", "60 minutes", 180).select("label", "win_start", (F.round("value", 5) + 0.0).alias("value"))


@query("feature_rows", f"""WITH p AS ({POINTS}), s AS (SELECT label, time_bucket(INTERVAL 6 HOUR, ts) AS t, round(avg(value), 6) AS mean_v, max(value) AS max_v FROM p GROUP BY 1, 2),
  f AS (SELECT t, {', '.join(f"max(mean_v) FILTER (label = '{k}') AS mean{k}, max(max_v) FILTER (label = '{k}') AS max{k}" for k in KINDS)} FROM s GROUP BY t)
  SELECT * FROM f WHERE {' AND '.join(f'mean{k} IS NOT NULL' for k in KINDS)}""")
def feature_rows(spark, sf_dir):
    s = aggregates.window_stats(signals(spark, sf_dir), "6 hours").withColumns({"mean_v": F.round("mean_v", 6)})
    long = s.select(F.col("win_start").alias("t"), F.explode(F.array(F.struct(F.concat(F.lit("mean"), "label").alias("label"), F.col("mean_v").alias("value")), F.struct(F.concat(F.lit("max"), "label").alias("label"), F.col("max_v").alias("value")))).alias("f")).select("t", "f.*")
    return features.feature_rows(long, [f"{x}{k}" for k in KINDS for x in ("mean", "max")])


#: The events as the six signals and the score that the feature job takes.
NAMED = ("HR", "RESP", "ABPMean", "ABPSys", "ABPDias", "SpO2", "SOFA_SCORE")
POINTS7 = f"SELECT [{', '.join(repr(x) for x in NAMED)}][event_id % 7 + 1] AS label, ts, value, event_id AS seq, user_id AS entity FROM events"
SIX = NAMED[:6]
SIX_PAIRS = [(a, b) for i, a in enumerate(SIX) for b in SIX[i + 1 :]]


def named(spark, sf_dir):
    return signals(spark, sf_dir).withColumn("label", F.element_at(F.array(*map(F.lit, NAMED)), (F.col("seq") % 7 + 1).cast("int")))


def interpolated_sql(name: str, where: str) -> str:
    """SQL of CTE `name` (label, ts, seq, value): one interpolated point a window of six hours each hour."""
    return f"""{name}1 AS (SELECT *, epoch_us(ts) AS us, epoch_us(min(ts) OVER (PARTITION BY label, win_start)) - epoch_us(win_start) AS rel FROM w WHERE value <> -1.0 AND {where}),
  {name}2 AS (SELECT *, epoch_us(win_start) + 10800000000 + CASE WHEN rel % 60000000 > 0 THEN rel % 60000000 WHEN rel = 0 THEN 0 ELSE 60000000 END AS ex FROM {name}1),
  {name}3 AS (SELECT label, win_start, ex, arg_min(value, us) FILTER (us = ex) AS x, arg_max(value, us) FILTER (us < ex) AS a, (max(us) FILTER (us < ex))::DOUBLE AS at_,
  arg_min(value, us) FILTER (us > ex) AS b, (min(us) FILTER (us > ex))::DOUBLE AS bt FROM {name}2 GROUP BY ALL),
  {name} AS (SELECT label, make_timestamp(ex) AS ts, epoch_us(win_start) AS seq, coalesce(x, a + (ex - at_) / (bt - at_) * (b - a), a, b, 0.0) AS value FROM {name}3)"""


def clean_sql(normalization: bool = True, interpolation: bool = True, outliers: bool = True) -> str:
    """SQL of the cleaned signals k and the score so (label, ts, seq, value), as CTEs: six-hour windows each hour."""
    base = sliding(360, 60).replace(POINTS, POINTS7) + ", " + interpolated_sql("so", "label = 'SOFA_SCORE'") + ", "
    if interpolation:
        base += interpolated_sql("c0", "label <> 'SOFA_SCORE'")
    else:
        base += "c0 AS (SELECT label, ts, seq, value FROM p WHERE value <> -1.0 AND label <> 'SOFA_SCORE')"
    if not normalization:
        return f"{base}, k AS (SELECT * FROM c0)"
    return f"""{base}, z1 AS (SELECT *, sum(value) OVER r / count(value) OVER r AS m, count(value) OVER r AS n FROM c0 WINDOW r AS (PARTITION BY label ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
  z2 AS (SELECT *, sqrt(sum(pow(value - m, 2)) OVER (PARTITION BY label ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / n) AS sd FROM z1),
  z3 AS (SELECT label, ts, seq, CASE WHEN sd > 0 THEN (value - m) / sd WHEN m > 0 THEN value - m ELSE 0 END AS value FROM z2), k AS (SELECT * FROM z3{" WHERE value > -3 AND value < 3" if outliers else ""})"""


def features_sql(without: str) -> str:
    flags = {f: without != f for f in ("normalization", "interpolation", "outliers")}
    day = "time_bucket(INTERVAL 1 DAY, ts)"
    ctes = [clean_sql(**flags), f"o AS (SELECT label, {day} AS win_start, ts, seq, value, row_number() OVER q AS rn, lead(value) OVER q AS nxt, count(*) OVER (PARTITION BY label, {day}) AS n, stddev_pop(value) OVER (PARTITION BY label, {day}) AS sd FROM k WINDOW q AS (PARTITION BY label, {day} ORDER BY ts, seq))"]
    parts, names = [], []
    if without != "correlation":
        pairs = ", ".join(f"('{a}', '{b}')" for a, b in SIX_PAIRS)
        ctes.append(f"""s AS (SELECT x.label AS la, y.label AS lb, x.win_start, max(x.n)::DOUBLE AS n, sum(x.value) AS x, sum(y.value) AS y, sum(x.value * y.value) AS xy, sum(x.value * x.value) AS xx, sum(y.value * y.value) AS yy
  FROM (VALUES {pairs}) v(a, b) JOIN o x ON x.label = a JOIN o y ON y.label = b AND y.win_start = x.win_start AND y.rn = x.rn GROUP BY ALL), sv AS (SELECT *, (xx / n - x * x / (n * n)) * (yy / n - y * y / (n * n)) AS var FROM s)""")
        parts.append("SELECT win_start, 'Corr' || la || lb AS name, (xy / n - x * y / (n * n)) / sqrt(var) AS v FROM sv WHERE var > 1e-9")
        names += [f"Corr{a}{b}" for a, b in SIX_PAIRS]
    if without != "entropy":
        ctes.append("""e AS (SELECT a.label, a.win_start, a.n - 2 AS m, count(*) FILTER (abs(a.value - b.value) <= 0.2 * a.sd) AS c1, count(*) FILTER (abs(a.value - b.value) <= 0.2 * a.sd AND abs(a.nxt - b.nxt) <= 0.2 * a.sd) AS c2
  FROM o a JOIN o b ON a.label = b.label AND a.win_start = b.win_start AND a.rn < b.rn AND b.rn <= b.n - 2 GROUP BY ALL)""")
        parts.append("SELECT win_start, 'Entropy' || label, CASE WHEN c1 > 0 AND c2 > 0 THEN -ln(c2 / c1) ELSE ln(m * (m - 1)) END FROM e WHERE m > 1")
        names += [f"Entropy{x}" for x in SIX]
    if without != "other":
        ctes.append("t AS (SELECT label, win_start, stddev_pop(value) AS stdev, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM o GROUP BY 1, 2)")
        parts += [f"SELECT win_start, '{n}' || label, {c} FROM t" for n, c in (("stdev", "stdev"), ("mean", "mean"), ("min", "lo"), ("max", "hi"))]
        names += [f"{n}{x}" for x in SIX for n in ("stdev", "mean", "min", "max")]
    if without != "deltas":
        ctes.append("""dw AS (SELECT k.*, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') - j.j * INTERVAL 60 MINUTE AS ws FROM k, (SELECT unnest(range(6)) AS j) j),
  dd AS (SELECT label, ws, ts, seq, value - lag(value) OVER q AS d, row_number() OVER q AS rn FROM dw WINDOW q AS (PARTITION BY label, ws ORDER BY ts, seq)),
  d1 AS (SELECT label, ts AS own, ws + INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND AS ts, epoch_us(ws) AS seq, d FROM dd WHERE rn = 2),
  ew AS (SELECT d1.*, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '1970-01-01') - j.j * INTERVAL 60 MINUTE AS ws FROM d1, (SELECT unnest(range(6)) AS j) j),
  ee AS (SELECT label, own AS ts, seq, d - lag(d) OVER q AS d, row_number() OVER q AS rn FROM ew WINDOW q AS (PARTITION BY label, ws ORDER BY ts, seq))""")
        parts += [f"SELECT {day}, '{n}' || label, arg_max(d, (ts, seq)) FROM {t} WHERE rn = 2 GROUP BY 1, 2" for n, t in (("delta", "dd"), ("deltadelta", "ee"))]
        names += [f"{n}{x}" for x in SIX for n in ("delta", "deltadelta")]
    parts.append(f"SELECT {day}, 'SOFA_SCORE', arg_max(value, (ts, seq)) FROM so GROUP BY 1, 2")
    names.append("SOFA_SCORE")
    ctes.append("f(win_start, name, v) AS (" + " UNION ALL ".join(parts) + ")")
    wide = ", ".join(f"round(max(v) FILTER (name = '{n}'), 5) + 0.0 AS {n}" for n in names)
    return f"WITH {', '.join(ctes)}, g AS (SELECT win_start, {wide} FROM f GROUP BY 1) SELECT * FROM g WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)}"


def _ablation(name):
    def run(spark, sf_dir):
        from pulsegrid.plans.pipeline import generate_features

        rows = generate_features(named(spark, sf_dir), SIX, without=name)
        return rows.select("win_start", *((F.round(c, 5) + 0.0).alias(c) for c in rows.columns[1:]))

    return run


for _name in ("none", "deltas", "entropy", "other", "correlation", "normalization", "interpolation", "outliers"):
    query(f"features_wo_{_name}" if _name != "none" else "features_all", features_sql(_name))(_ablation(_name))


SCORE_ONLY = interpolated_sql("so", "label = 'SOFA_SCORE'")


@query("process_score", f"WITH {sliding(360, 60).replace(POINTS, POINTS7)}, {SCORE_ONLY} SELECT label, ts, round(value, 6) AS value FROM so")
def process_score(spark, sf_dir):
    from pulsegrid.plans.pipeline import process_score as run

    return run(named(spark, sf_dir), "360 minutes", "60 minutes", 360).select("label", "ts", F.round("value", 6).alias("value"))


@query("integrated_score")
def integrated_score(spark, sf_dir):
    """Feature rows, windows of three days each day, and the recurrent scorer (of seeded weights)."""
    from pulsegrid.operators import ml
    from pulsegrid.plans.pipeline import feature_names, generate_features, integrated

    names = feature_names(SIX)
    found = integrated(generate_features(named(spark, sf_dir), SIX), names, ml.BiLSTM.seeded(len(names) - 1, 8), "3 days", "1 day")
    return found.withColumns({p: F.round(p, 6) for p in ("p0", "p1")})


@query("asof_tolerance", """WITH l AS (SELECT event_id AS seq, user_id AS entity, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id AS entity, ts, value, event_id FROM events WHERE event_type = 'view')
  SELECT l.seq, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 172800000000 THEN r.value END AS value_as_of FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.ts >= r.ts""")
def asof_tolerance(spark, sf_dir):
    s = signals(spark, sf_dir)
    left = s.where("label = 'purchase'").select("seq", "entity", "ts")
    return joins.as_of(left, s.where("label = 'view'"), "entity", "ts", 172_800, "value", "seq", slice_seconds=5 * 86_400).select("seq", "value_as_of")


@query("interval_containment", """WITH s AS (SELECT user_id, min(ts) AS s, min(ts) + INTERVAL 5 DAY AS e FROM events WHERE event_type = 'signup' GROUP BY 1)
  SELECT event_id AS seq, s.s AS start FROM events v LEFT JOIN s ON s.user_id = v.user_id AND v.ts BETWEEN s.s AND s.e WHERE event_type = 'purchase'""")
def interval_containment(spark, sf_dir):
    s = signals(spark, sf_dir)
    spans = s.where("label = 'signup'").groupBy("entity").agg(F.min("ts").alias("start"), (F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("end"))
    return joins.contained(s.where("label = 'purchase'"), spans, "entity").select("seq", "start")


@query("prev_within_6h", f"""WITH p AS ({POINTS}) SELECT seq, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN lag(value) OVER w END AS prev_value FROM p WINDOW w AS (PARTITION BY entity ORDER BY ts, seq)""")
def prev_within_6h(spark, sf_dir):
    return joins.previous_within(signals(spark, sf_dir), "entity", "value", 6, slice_seconds=5 * 86_400).select("seq", "prev_value")


@query("sessionize_8h_gap", f"""WITH p AS ({POINTS}), n AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 28800000000 OR lag(label = 'error') OVER w THEN 1 ELSE 0 END AS nw FROM p WINDOW w AS (PARTITION BY entity ORDER BY ts))
  , s AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY ts) AS session FROM n)
  SELECT entity, session::BIGINT AS session, min(ts) AS start, max(ts) AS stop, count(*) AS n, max(CASE WHEN label = 'error' THEN 1 ELSE 0 END) AS has_error FROM s GROUP BY 1, 2 HAVING min(ts) <> max(ts)""")
def sessionize_8h_gap(spark, sf_dir):
    s = joins.sessions(signals(spark, sf_dir), "entity", 8 * 3600, breaks=F.col("label") == "error", slice_seconds=5 * 86_400)
    out = s.groupBy("entity", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"), F.max(F.when(F.col("label") == "error", 1).otherwise(0)).alias("has_error"))
    return out.where("start <> stop")


@query("argmin_row", f"WITH p AS ({POINTS}) SELECT entity, seq, value FROM p QUALIFY row_number() OVER (PARTITION BY entity ORDER BY value, ts, seq) = 1")
def argmin_row(spark, sf_dir):
    return joins.first_row(signals(spark, sf_dir), "entity", "value", "ts", "seq").select("entity", "seq", "value")


@query("windowed_equijoin", f"""WITH p AS ({POINTS}) SELECT a.seq AS a_seq, b.seq AS b_seq FROM p a JOIN p b ON a.entity = b.entity AND time_bucket(INTERVAL 1 HOUR, a.ts) = time_bucket(INTERVAL 1 HOUR, b.ts) WHERE a.label = 'click' AND b.label = 'view'""")
def windowed_equijoin(spark, sf_dir):
    s = windows.windowed(signals(spark, sf_dir), "1 hour")
    a, b = (s.where(F.col("label") == k).select("entity", "win_start", F.col("seq").alias(n)) for k, n in (("click", "a_seq"), ("view", "b_seq")))
    return a.join(b, ["entity", "win_start"]).select("a_seq", "b_seq")


@query("dense_grid_overlay", """WITH s AS (SELECT user_id AS entity, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events GROUP BY 1),
  g AS (SELECT entity, unnest(generate_series(a + INTERVAL 1 HOUR, b, INTERVAL 1 HOUR)) AS t FROM s),
  v AS (SELECT user_id AS entity, date_trunc('hour', ts) AS t, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
  SELECT entity, t, value FROM g LEFT JOIN v USING (entity, t)""")
def dense_grid_overlay(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("t", F.date_trunc("hour", "ts"))
    spans = s.groupBy("entity").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return grids.overlay(grids.dense_grid(spans, "1 HOUR").select("entity", "t"), s, "entity", "t", "value", "seq").select("entity", "t", "value")


@query("bounded_ffill", f"""WITH p AS ({POINTS}), v AS (SELECT entity, ts, seq, CASE WHEN label = 'view' THEN value END AS v, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) AS rn FROM p),
  l AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN rn END) OVER (PARTITION BY entity) AS last FROM v)
  SELECT seq, CASE WHEN rn <= last + 3 THEN last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) END AS v_filled FROM l""")
def bounded_ffill(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("v", F.when(F.col("label") == "view", F.col("value")))
    return grids.bounded_fill(s, "entity", "v", 3, "ts", "seq").select("seq", "v_filled")


@query("missing_pct", """WITH d AS (SELECT DISTINCT user_id AS entity, date_trunc('hour', ts) AS t FROM events) SELECT entity, round(100 - sum(1) * 100 / 720.0, 6) AS missing_pct FROM d GROUP BY 1""")
def missing_pct(spark, sf_dir):
    d = signals(spark, sf_dir).select("entity", F.date_trunc("hour", "ts").alias("t")).distinct()
    return grids.missing_share(d, ["entity"], F.lit(1), F.lit(720.0)).withColumns({"missing_pct": F.round("missing_pct", 6)})


@query("signals_available", "SELECT user_id AS entity, count(DISTINCT event_type) = 5 AS available FROM events GROUP BY 1")
def signals_available(spark, sf_dir):
    names = signals(spark, sf_dir).groupBy("entity").agg(F.collect_set("label").alias("names"))
    return names.select("entity", grids.all_there(F.col("names"), [k.upper() for k in KINDS]).alias("available"))


@query("reformat_signals", "SELECT strftime(ts, '%H:%M:%S %d/%m/%Y') || ',' || CASE WHEN event_type = 'view' THEN value ELSE -1.0 END::VARCHAR AS line FROM events")
def reformat_signals(spark, sf_dir):
    return grids.reformat(signals(spark, sf_dir).withColumn("v", F.when(F.col("label") == "view", F.col("value"))), "ts", ["v"])


@query("interpolation_rmse", f"""WITH l AS ({interpolation_sql("linear")}), c AS ({interpolation_sql("locf")}) SELECT l.label, round(sqrt(avg(pow(l.value - c.value, 2))), 4) AS rmse FROM l JOIN c USING (label, win_start) GROUP BY 1""")
def interpolation_rmse(spark, sf_dir):
    a, b = (_interpolated(m)(spark, sf_dir).select("label", "win_start", F.col("value").alias(m)) for m in ("linear", "locf"))
    return grids.rmse(a, b, ["label", "win_start"], "linear", "locf", ["label"]).withColumn("rmse", F.round("rmse", 4))


MISSING = ("0.1", "0.2", "0.4")


def rmse_sql() -> str:
    """Values of views go missing by the last digits of their number; what stays estimates the windows of all."""
    part = lambda name, keep, mode: f"""{name} AS ({interpolation_sql(mode).replace(POINTS, POINTS + f" WHERE event_type = 'view' AND {keep}")})"""
    keep = lambda m: f"event_id % 10 >= {int(float(m) * 10)}"
    parts = [part("truth", "true", "linear")] + [part(f"{mode}{i}", keep(m), mode) for i, m in enumerate(MISSING) for mode in ("linear", "locf", "nocb")]
    error = lambda x: f"(SELECT round(sqrt(avg(pow(g.value - t.value, 2))), 4) FROM {x} g JOIN truth t USING (label, win_start))"
    rows = " UNION ALL ".join(f"SELECT '{m}' AS missing, " + ", ".join(f"{error(f'{mode}{i}')} AS {mode}" for mode in ("linear", "locf", "nocb")) for i, m in enumerate(MISSING))
    return f"WITH {', '.join(parts)} {rows}"


@query("rmse_table", rmse_sql())
def rmse_table(spark, sf_dir):
    views = signals(spark, sf_dir).where("label = 'view'")
    at = lambda p, mode: interpolate.interpolate(p, "180 minutes", "60 minutes", 180, mode).select("label", "win_start", F.round("value", 6).alias("value"))
    guess = lambda mode: reduce(DataFrame.unionByName, [at(views.where(F.col("seq") % 10 >= int(float(m) * 10)), mode).withColumn("missing", F.lit(m)) for m in MISSING])
    found = grids.rmse_table(at(views, "linear"), {m: guess(m) for m in ("linear", "locf", "nocb")}, ["label", "win_start"], "value", "missing")
    return found.withColumns({m: F.round(m, 4) for m in ("linear", "locf", "nocb")})


@query("consistent_rate", f"""WITH p AS ({POINTS}), f AS (SELECT *, first_value(label) OVER (PARTITION BY entity ORDER BY ts, seq) AS f FROM p) SELECT seq FROM f WHERE label = f""")
def consistent_rate(spark, sf_dir):
    return grids.consistent_rate(signals(spark, sf_dir), "entity", "label", "ts", "seq").select("seq")


@query("point_lines", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ',' || event_type || ',' || value::VARCHAR AS line FROM events")
def point_lines(spark, sf_dir):
    return signals(spark, sf_dir).select(F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), "label", F.col("value").cast("string")).alias("line"))


@query("message_round_trip", "SELECT event_type AS key, (epoch_us(ts) // 1000)::BIGINT AS ms, value FROM events")
def message_round_trip(spark, sf_dir):
    from pulsegrid.sources import messages

    return messages.decode(messages.encode(signals(spark, sf_dir))).select("key", F.unix_millis("ts").alias("ms"), "value")
