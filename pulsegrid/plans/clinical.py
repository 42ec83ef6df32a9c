"""The clinical forms on the driver's tables: pivots, flags, ladders, hourly scores and their onset."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query, signals
from pulsegrid.functions import scalars
from pulsegrid.plans import severity


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query("cond_pivot", "SELECT o_custkey, " + ", ".join(f"max(CASE WHEN o_orderpriority = '{p}' AND o_totalprice <= 400000 THEN o_totalprice END) AS p{p[0]}_max, min(CASE WHEN o_orderpriority = '{p}' AND o_totalprice > 5000 THEN o_totalprice END) AS p{p[0]}_min" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def cond_pivot(spark, sf_dir):
    c = lambda p, ok: F.when((F.col("o_orderpriority") == p) & ok, F.col("o_totalprice"))
    x = F.col("o_totalprice")
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(e for p in PRIORITIES for e in (F.max(c(p, x <= 400000)).alias(f"p{p[0]}_max"), F.min(c(p, x > 5000)).alias(f"p{p[0]}_min"))))


@query("signed_sum", "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS net FROM lineitem GROUP BY 1")
def signed_sum(spark, sf_dir):
    v = F.col("l_extendedprice")
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", -v).otherwise(v)), 2).alias("net"))


@query("flag_agg", "SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_r, max(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS any_deep FROM lineitem GROUP BY 1 HAVING min(l_shipdate) <> max(l_shipdate) AND max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1")
def flag_agg(spark, sf_dir):
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    out = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flag(F.col("l_returnflag") == "R").alias("any_r"), flag(F.col("l_discount") > 0.08).alias("any_deep"), (F.min("l_shipdate") != F.max("l_shipdate")).alias("__span"), flag(F.col("l_linestatus") == "O").alias("__open"))
    return out.where("__span and __open = 1").drop("__span", "__open")


@query("regex_extract_fields", r"""SELECT event_id, nullif(regexp_extract(props, '"k": (\d+)', 1), '')::INTEGER AS k, nullif(regexp_extract(props, '"z": (\d+)', 1), '')::INTEGER AS z FROM events""")
def regex_extract_fields(spark, sf_dir):
    field = lambda name: scalars.extracted("props", rf'"{name}": (\d+)').cast("int")
    return _table(spark, sf_dir, "events").select("event_id", field("k").alias("k"), field("z").alias("z"))


@query("logistic_prob", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-0.5 + 0.04 * coalesce(l_quantity, 25) - 3.0 * coalesce(l_discount, 0.05) + 2.0 * l_tax))), 6) AS p FROM lineitem")
def logistic_prob(spark, sf_dir):
    p = scalars.logistic(-0.5, {"l_quantity": (0.04, 25.0), "l_discount": (-3.0, 0.05), "l_tax": (2.0, 0.0)})
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 6).alias("p"))


LADDER = [(300000.0, 4), (200000.0, 3), (100000.0, 2), (50000.0, 1)]


@query("score_ladder", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 4 WHEN o_totalprice >= 200000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 WHEN o_totalprice >= 50000 THEN 1 WHEN o_totalprice IS NULL THEN NULL ELSE 0 END AS score FROM orders")
def score_ladder(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalars.ladder("o_totalprice", LADDER).alias("score"))


@query("unit_conversion", "SELECT event_id, round(CASE WHEN event_type = 'view' THEN (value - 32) / 1.8 ELSE value END, 6) AS v, CASE WHEN value > 0 AND value < 300 THEN value END AS sane FROM events")
def unit_conversion(spark, sf_dir):
    v = F.col("value")
    return _table(spark, sf_dir, "events").select("event_id", F.round(F.when(F.col("event_type") == "view", (v - 32) / 1.8).otherwise(v), 6).alias("v"), scalars.within(v, 0, 300).alias("sane"))


HOURS = """WITH s AS (SELECT user_id AS entity, min(ts) AS start FROM events GROUP BY 1), g AS (SELECT entity, start, unnest(range(72)) AS hr FROM s),
  e AS (SELECT s.entity, event_type, value, CAST(ceil((epoch_us(ts) - epoch_us(start) - 1000000) / 3600000000.0) AS BIGINT) AS hr0, epoch_us(ts) - epoch_us(start) AS off FROM events JOIN s ON user_id = entity),
  h AS (SELECT entity, event_type, value, off // 3600000000 AS hr FROM e WHERE off % 3600000000 >= 1000000 UNION ALL SELECT entity, event_type, value, off // 3600000000 - 1 FROM e WHERE off % 3600000000 = 0),
  a AS (SELECT entity, hr, max(value) FILTER (event_type = 'view') AS v, min(value) FILTER (event_type = 'click') AS c, sum(value) FILTER (event_type = 'error') AS e FROM h GROUP BY 1, 2),
  q AS (SELECT g.entity, g.hr, CASE WHEN v >= 120 THEN 4 WHEN v >= 80 THEN 3 WHEN v >= 40 THEN 2 WHEN v >= 20 THEN 1 WHEN v IS NULL THEN NULL ELSE 0 END AS s_view,
  CASE WHEN c < 5 THEN 4 WHEN c < 10 THEN 3 WHEN c < 20 THEN 2 WHEN c < 50 THEN 1 WHEN c IS NULL THEN NULL ELSE 0 END AS s_click,
  CASE WHEN e >= 100 THEN 4 WHEN e >= 50 THEN 3 WHEN e >= 25 THEN 2 WHEN e >= 10 THEN 1 WHEN e IS NULL THEN NULL ELSE 0 END AS s_error FROM g LEFT JOIN a USING (entity, hr)),
  t AS (SELECT *, coalesce(s_view, 0) + coalesce(s_click, 0) + coalesce(s_error, 0) AS score FROM q)"""


@query("hourly_score_grid", f"{HOURS} SELECT entity, hr::INTEGER AS hr, s_view, s_click, s_error, score FROM t")
def hourly_score_grid(spark, sf_dir):
    return severity.signal_scores(signals(spark, sf_dir))


@query("onset_first_hour", f"{HOURS}, b AS (SELECT entity, hr, score, first_value(score) OVER (PARTITION BY entity ORDER BY hr) AS base FROM t) SELECT entity, min(hr)::INTEGER AS onset_hr FROM b WHERE score - base >= 2 GROUP BY 1")
def onset_first_hour(spark, sf_dir):
    return severity.onset(severity.signal_scores(signals(spark, sf_dir)), "entity", "hr", "score", 2).select("entity", F.col("hr").alias("onset_hr"))


#: As HOURS, over each entity's entire stay.
ENTIRE = HOURS.replace("min(ts) AS start FROM events", "min(ts) AS start, greatest(1, round((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 3600))::BIGINT AS hours FROM events").replace("unnest(range(72))", "unnest(range(hours))")


@query("hourly_score_entire", f"{ENTIRE} SELECT entity, hr::INTEGER AS hr, s_view, s_click, s_error, score FROM t")
def hourly_score_entire(spark, sf_dir):
    return severity.signal_scores(signals(spark, sf_dir), None)


@query("onset_entire", f"{ENTIRE}, b AS (SELECT entity, hr, score, first_value(score) OVER (PARTITION BY entity ORDER BY hr) AS base FROM t) SELECT entity, min(hr)::INTEGER AS onset_hr FROM b WHERE score - base >= 2 GROUP BY 1")
def onset_entire(spark, sf_dir):
    return severity.onset(severity.signal_scores(signals(spark, sf_dir), None), "entity", "hr", "score", 2).select("entity", F.col("hr").alias("onset_hr"))
