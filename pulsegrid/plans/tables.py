"""Queries over the relational tables: reshaping, set operations and wide averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query
from pulsegrid.operators import filters, windows

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("unpivot_wide", "UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME label VALUE value")
def unpivot_wide(spark, sf_dir):
    return filters.unpivot(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], MEASURES)


@query("array_moving_avg", f"SELECT l_suppkey, time_bucket(INTERVAL 30 DAY, l_shipdate, TIMESTAMP '1970-01-01') + INTERVAL 30 DAY AS t, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in MEASURES)} FROM lineitem GROUP BY 1, 2")
def array_moving_avg(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    return windows.moving_average(df, "30 days", None, tuple(MEASURES), ("l_suppkey",)).withColumns({f"avg_{c}": F.round(f"avg_{c}", 6) for c in MEASURES})


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(_table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("union_bag", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def union_bag(spark, sf_dir):
    both = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(_table(spark, sf_dir, "supplier").select("s_nationkey"))
    return both.groupBy("k").agg(F.count("*").alias("n"))


@query("matched_inner", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def matched_inner(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return o.where("o_totalprice > 200000").join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_mktsegment")


@query("left_with_predicate", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1")
def left_with_predicate(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    on = (o["o_custkey"] == c["c_custkey"]) & (o["o_orderstatus"] == "F") & (o["o_totalprice"] > 100000)
    return c.join(o, on, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("anti_unmatched", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def anti_unmatched(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000"), _table(spark, sf_dir, "customer")
    return c.join(o, o["o_custkey"] == c["c_custkey"], "left_anti").select("c_custkey")


@query("exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS flag FROM customer")
def exists_flag(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    hit = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return c.join(hit, "c_custkey", "left").select("c_custkey", F.col("hit").isNotNull().alias("flag"))


@query("predicates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IS NOT NULL AND l_linestatus <> 'X' AND l_quantity BETWEEN 10 AND 20 AND l_returnflag LIKE '%A%' AND l_linenumber IS DISTINCT FROM 1")
def predicates(spark, sf_dir):
    c = F.col
    return _table(spark, sf_dir, "lineitem").where(c("l_returnflag").isin("A", "R") & c("l_linestatus").isNotNull() & (c("l_linestatus") != "X") & c("l_quantity").between(10, 20) & c("l_returnflag").like("%A%") & ~c("l_linenumber").eqNullSafe(1)).select("l_orderkey", "l_linenumber")


@query("scalar_lookup", "SELECT o_orderkey, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS c_name FROM orders")
def scalar_lookup(spark, sf_dir):
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", "c_name")


@query("top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_rows(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("star_assembly", """SELECT c_custkey, n_name, r_name, coalesce(n_orders, 0) AS n_orders, round(spend, 2) AS spend FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def star_assembly(spark, sf_dir):
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    spent = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("spend"))
    out = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).join(spent, c["c_custkey"] == spent["o_custkey"], "left")
    return out.select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round("spend", 2).alias("spend"))
