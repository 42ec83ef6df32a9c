"""A stream over the same rows gives what the batch gives, for windows that are closed."""

import json
import os

from pyspark.sql import functions as F

from pulsegrid.catalog import signals
from pulsegrid.operators import aggregates, normalize, windows
from pulsegrid.sources import messages
from pulsegrid.streaming import jobs


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def streamed(spark, small, tmp_path):
    signals(spark, small).repartition(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def test_windows(spark, small, tmp_path):
    live = drained(jobs.stats(streamed(spark, small, tmp_path), "1 hour"), "w1")
    batch = aggregates.window_stats(signals(spark, small), "1 hour")
    last = batch.agg(F.max("last_ts")).first()[0]
    closed = batch.where(F.col("win_start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last))
    near = lambda df: sorted((tuple(r) for r in df.withColumns({c: F.round(c, 9) for c in ("mean_v", "stdev_v")}).collect()), key=str)
    assert near(live) == near(closed)


def test_zscore(spark, small, tmp_path):
    live = {r.seq: r.z for r in drained(jobs.zscore(streamed(spark, small, tmp_path)), "z1").collect()}
    batch = {r.seq: r.z for r in normalize.online_zscore(signals(spark, small)).collect()}
    assert live.keys() == batch.keys()
    assert max(abs(live[k] - batch[k]) for k in live) < 1e-9


def chained(spark, small):
    """Means of the means of hours, by the batch, for windows of six hours that the watermark has passed."""
    hours = signals(spark, small).groupBy("label", F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("v"))
    last = signals(spark, small).agg(F.max("ts")).first()[0]
    end = F.col("w.end") - F.expr("INTERVAL '0.000001' SECOND")
    six = hours.select("label", F.window(end, "6 hours").alias("w"), "v").groupBy("label", "w").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return [(r.label, r.start, round(r.m, 9), r.n) for r in six.where(F.col("w.end") <= F.lit(last)).select("label", "w.start", "m", "n").collect()]


def test_chained_and_triggered(spark, small, tmp_path):
    s = streamed(spark, small, tmp_path)
    assert sorted(map(tuple, chained(spark, small))) == sorted((r.label, r.win_start, round(r.mean_v, 9), r.n) for r in drained(jobs.chained_mean(s, "1 hour", "6 hours"), "c1").collect())
    assert drained(jobs.count_reached(s, "6 hours", 3), "t1").where("n < 3").count() == 0


def test_sinks(spark, small, tmp_path):
    s = streamed(spark, small, tmp_path)
    jobs.to_text(s.select("label", "value"), str(tmp_path / "text"), str(tmp_path / "c1")).awaitTermination(60)
    n = signals(spark, small).count()
    assert spark.read.text(str(tmp_path / "text")).count() == n
    outs = {"all": ("parquet", str(tmp_path / "o1"), lambda b: b), "view": ("parquet", str(tmp_path / "o2"), lambda b: b.where("label = 'view'"))}
    jobs.to_many(s, outs, str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o1")).count() == n > spark.read.parquet(str(tmp_path / "o2")).count() > 0


def test_firings_are_those_of_the_batch(spark, small, tmp_path):
    live = drained(jobs.count_firings(streamed(spark, small, tmp_path), "6 hours", 3), "f1").selectExpr("label", "win_start", "fired_at", "round(sum_v, 6) as sum_v", "t")
    batch = windows.count_trigger(signals(spark, small), "6 hours", 3).withColumn("sum_v", F.round("sum_v", 6))
    assert sorted(map(tuple, live.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_windowed_join(spark, small, tmp_path):
    s = streamed(spark, small, tmp_path)
    live = drained(jobs.windowed_join(s.where("label = 'click'"), s.where("label = 'view'"), "entity", "12 hours"), "j1")
    p = windows.windowed(signals(spark, small), "12 hours").select("entity", "win_start", "seq", "label")
    a, b = p.where("label = 'click'").withColumnRenamed("seq", "a_seq"), p.where("label = 'view'").withColumnRenamed("seq", "b_seq")
    batch = a.join(b, ["entity", "win_start"]).select("a_seq", "b_seq")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))


def in_turn(spark, tmp_path, batches):
    """A stream of files, one a micro-batch: rows are (label, minute of the day, value, seq)."""
    folder = tmp_path / "turns"
    folder.mkdir()
    for i, rows in enumerate(batches):
        lines = [json.dumps({"label": k, "ts": f"2020-01-01T{m // 60:02d}:{m % 60:02d}:00Z", "value": v, "seq": s}) for k, m, v, s in rows]
        (folder / f"{i}.json").write_text("\n".join(lines))
        os.utime(folder / f"{i}.json", (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.readStream.schema("label string, ts timestamp, value double, seq long").option("maxFilesPerTrigger", 1).json(str(folder))


LATE = [[("a", 605, 1.0, 1), ("a", 670, 2.0, 2)], [("a", 760, 4.0, 3)], [("a", 610, 8.0, 4), ("a", 770, 16.0, 5)], [("a", 1200, 0.0, 6)], [("a", 1439, 0.0, 7)]]


def test_late_points_and_delay(spark, tmp_path):
    """A point behind the watermark is dropped; with a delay that it keeps within, it counts."""
    for delay, want in (("0 seconds", 1.0), ("4 hours", 4.5)):
        (tmp_path / delay).mkdir()
        live = drained(jobs.stats(in_turn(spark, tmp_path / delay, LATE), "1 hour", delay=delay), "late" + delay[0])
        assert {r.win_start.hour: r.mean_v for r in live.collect()}[10] == want


def test_firings_of_late_points(spark, tmp_path):
    for delay, want in (("0 seconds", []), ("4 hours", [(2, 9.0)])):
        (tmp_path / delay).mkdir()
        live = drained(jobs.count_firings(in_turn(spark, tmp_path / delay, LATE), "1 hour", 2, delay), "fired" + delay[0])
        assert [(r.fired_at, r.sum_v) for r in live.collect() if r.win_start.hour == 10] == want


def test_nulls_in_a_stream_of_scores(spark, tmp_path):
    rows = [("a", 600 + i, v, i) for i, v in enumerate([None, 3.0, None, 5.0, 9.0, None, 1.0])]
    live = {r.seq: r.z for r in drained(jobs.zscore(in_turn(spark, tmp_path, [rows[:3], rows[3:]])), "zn").collect()}
    df = spark.createDataFrame([(k, f"2020-01-01 {m // 60:02d}:{m % 60:02d}:00", v, s) for k, m, v, s in rows], "label string, t string, value double, seq long").select("label", F.to_timestamp("t").alias("ts"), "value", "seq")
    batch = {r.seq: r.z for r in normalize.online_zscore(df).collect()}
    assert live.keys() == batch.keys()
    assert all((live[k] is None) == (batch[k] is None) and (batch[k] is None or abs(live[k] - batch[k]) < 1e-9) for k in batch)


def test_messages_that_come_again(spark):
    batch = spark.sql("select cast(null as binary) key, cast(v as binary) value from values ('a'), ('a'), ('b') as t(v)")
    sent = messages.numbered(batch, 1).unionByName(messages.numbered(batch, 1)).unionByName(messages.numbered(batch, 2))
    assert sorted(bytes(r.value).decode() for r in messages.once(sent).collect()) == ["a"] * 4 + ["b"] * 2


def test_console(spark, small, tmp_path):
    jobs.to_console(streamed(spark, small, tmp_path), str(tmp_path / "c")).awaitTermination(60)
