"""Queries for sequences, scaling, folds, metrics and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog import query, signals
from pulsegrid.operators import ml
from pulsegrid.plans.series import POINTS


def _labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs, "doc_id").withColumn("guess", (F.col("n_chars") > 1000).cast("int"))


SEQ = f"WITH p AS ({POINTS}), s AS (SELECT entity, row_number() OVER w AS rn, list(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS v, value AS target FROM p WINDOW w AS (PARTITION BY entity ORDER BY ts, seq))"


@query("sequences", f"{SEQ} SELECT entity, rn::INTEGER AS rn, array_to_string(v, ';') AS seq_text, target FROM s WHERE len(v) = 3")
def sequences(spark, sf_dir):
    out = ml.sequences(signals(spark, sf_dir), "entity", "value", "value", 3, "ts", "seq")
    return out.select("entity", "rn", F.array_join(F.transform("seq_values", lambda v: v.cast("string")), ";").alias("seq_text"), "target")


@query("sequences_strided", f"{SEQ} SELECT entity, rn::INTEGER AS rn, array_to_string(v, ';') AS seq_text, target FROM s WHERE len(v) = 3 AND (rn - 1) % 3 = 0")
def sequences_strided(spark, sf_dir):
    out = ml.sequences(signals(spark, sf_dir), "entity", "value", "value", 3, "ts", "seq", stride=3)
    return out.select("entity", "rn", F.array_join(F.transform("seq_values", lambda v: v.cast("string")), ";").alias("seq_text"), "target")


@query("standard_scale", "WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_tax) AS c, stddev_pop(l_tax) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - a) / b, 5) + 0.0 AS l_quantity, round((l_tax - c) / d, 5) + 0.0 AS l_tax FROM lineitem, s")
def standard_scale(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return ml.standard_scale(df, ["l_quantity", "l_tax"]).withColumns({c: F.round(c, 5) + 0.0 for c in ("l_quantity", "l_tax")})


@query("kfold_split", f"WITH p AS ({POINTS}) SELECT entity, seq, (ntile(4) OVER (PARTITION BY entity ORDER BY ts, seq))::INTEGER AS fold FROM p")
def kfold_split(spark, sf_dir):
    return ml.kfold(signals(spark, sf_dir), 4, "entity", "ts", "seq").select("entity", "seq", "fold")


JOINED = "SELECT l.*, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS guess, n_chars FROM labels l JOIN documents USING (doc_id)"


@query("confusion_metrics", f"""WITH j AS ({JOINED}), c AS (SELECT count(*) FILTER (quality = 1 AND guess = 1) AS tp, count(*) FILTER (quality = 0 AND guess = 1) AS fp, count(*) FILTER (quality = 0 AND guess = 0) AS tn, count(*) FILTER (quality = 1 AND guess = 0) AS fn FROM j)
  SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c""")
def confusion_metrics(spark, sf_dir):
    return ml.confusion(_labels(spark, sf_dir), "quality", "guess").withColumns({c: F.round(c, 6) for c in ("accuracy", "balanced", "precision", "recall")})


@query("auroc", f"""WITH j AS ({JOINED}), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM j),
  t AS (SELECT sum(rk) FILTER (quality = 1) AS r, count(*) FILTER (quality = 1) AS p, count(*) AS n FROM r) SELECT round((r - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auroc FROM t""")
def auroc(spark, sf_dir):
    return ml.auroc(_labels(spark, sf_dir), "quality", "n_chars").withColumn("auroc", F.round("auroc", 6))


@query("class_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def class_counts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("one_hot", "SELECT doc_id, CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END AS shock, CASE WHEN n_chars > 4000 THEN 0 ELSE 1 END AS nonshock FROM documents")
def one_hot(spark, sf_dir):
    hit = F.col("n_chars") > 4000
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(hit, 1).otherwise(0).alias("shock"), F.when(hit, 0).otherwise(1).alias("nonshock"))


@query("labelled_rows", f"""WITH p AS ({POINTS}), h AS (SELECT *, value > 60 AS hit, min((value > 60)::INT) OVER w <> max((value > 60)::INT) OVER w AS two FROM p WINDOW w AS (PARTITION BY entity))
  SELECT seq, CASE WHEN hit THEN 'shock' ELSE 'Nonshock' END AS label, (hit AND two)::INTEGER AS shock, (NOT hit OR NOT two)::INTEGER AS nonshock FROM h""")
def labelled_rows(spark, sf_dir):
    return ml.labelled(signals(spark, sf_dir), "value", 60, "entity").select("seq", "label", "shock", F.col("Nonshock").alias("nonshock"))


@query("lstm_score")
def lstm_score(spark, sf_dir):
    seqs = ml.sequences(signals(spark, sf_dir), "entity", "value", "value", 3, "ts", "seq")
    model = ml.BiLSTM.seeded(1, 8)
    scored = ml.lstm_score(seqs.withColumn("x", F.transform("seq_values", lambda v: F.array(v / 100))), "x", model)
    return scored.select("entity", "rn", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"), F.col("lstm_label").alias("label"))
