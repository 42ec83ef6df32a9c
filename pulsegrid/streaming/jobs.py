"""Streaming twins: windowed statistics, online z-score and count triggers on unbounded input, and the sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.aggregates import window_stats
from pulsegrid.sources.messages import numbered


def watermarked(points: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Late points, behind the highest time seen less the delay, are dropped by what keeps state."""
    return points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stats(points: DataFrame, size: str, slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """window_stats() of a stream; append mode gives a window once the watermark has passed its end."""
    return window_stats(watermarked(points, delay), size, slide)


def chained_mean(points: DataFrame, size: str, then: str, delay: str = "0 seconds") -> DataFrame:
    """The mean of windows' means: what a window gives carries the window's last instant as its time."""
    first = watermarked(points, delay).groupBy("label", F.window("ts", size).alias("w")).agg(F.avg("value").alias("value"))
    return first.groupBy("label", F.window(F.window_time("w"), then).alias("w2")).agg(F.avg("value").alias("mean_v"), F.count("*").alias("n")).select("label", F.col("w2.start").alias("win_start"), "mean_v", "n")


def zscore(points: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Online z-score by label: state is (n, sum, sum of squares about the running mean).

    Points of one micro-batch are put in order of (ts, seq); batches follow each other. A null value counts for nothing,
    as in online_zscore(); NaN counts as null here. ttl_ms: a label unheard of for so long loses its state.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n0, total, squares = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        x = rows["value"].to_numpy(dtype=float)
        there = ~np.isnan(x)
        n, s = n0 + np.cumsum(there), total + np.cumsum(np.where(there, x, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n
            q = squares + np.cumsum(np.where(there, (x - mean) ** 2, 0.0))
            deviation = np.sqrt(q / n)
            z = np.where(deviation > 0, (x - mean) / deviation, np.where(mean > 0, x - mean, 0.0))
        state.update((int(n[-1]), float(s[-1]), float(q[-1])))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield rows.assign(z=pd.Series(z, rows.index).astype("Float64"), value=rows["value"].astype("Float64"))[["label", "ts", "seq", "value", "z"]]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    narrow = points.select("label", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))
    return narrow.groupBy("label").applyInPandasWithState(run, "label string, ts timestamp, seq long, value double, z double", "n long, total double, squares double", "append", timeout)


def count_reached(points: DataFrame, size: str, n: int, delay: str = "0 seconds") -> DataFrame:
    """Windows that have reached n points when the watermark passes their end; count_firings() fires at the n-th point."""
    agg = watermarked(points, delay).groupBy("label", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("sum_v"))
    return agg.where(F.col("n") >= n).select("label", F.col("w.start").alias("win_start"), "n", "sum_v")


def to_text(df: DataFrame, path: str, checkpoint: str):
    """Rows as comma-separated text files; exactly once with the checkpoint."""
    line = df.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"))
    return line.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_many(df: DataFrame, outputs: dict[str, tuple], checkpoint: str):
    """One stream to several outputs: each is (format, path, function of the batch); a batch is kept while it is written.

    A batch's files go to a folder of its number, so a batch that runs again replaces what it wrote.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for form, path, part in outputs.values():
                part(batch).write.format(form).mode("overwrite").save(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_console(df: DataFrame, checkpoint: str | None = None, rows: int = 20):
    """Print each batch's first rows, for a look at a stream."""
    out = df.writeStream.format("console").option("numRows", rows).option("truncate", False).trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def to_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Messages (key, value) to a topic, at least once; needs Spark's Kafka package."""
    return messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def to_kafka_numbered(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """As to_kafka(), where each message names its batch in a header: sources.messages.once() drops what comes again."""
    def write(batch: DataFrame, number: int) -> None:
        numbered(batch, number).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def count_firings(points: DataFrame, size: str, n: int, delay: str = "0 seconds") -> DataFrame:
    """Windows fire each time another n of their points have come, with what they have gathered so far.

    State is (points, sum, last time) of each label and window; points of one micro-batch are put in order of (ts, seq).
    It goes when the watermark passes the window's end; points of such a window that come later count for nothing.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.getCurrentWatermarkMs() >= key[2]:
            return
        count, total, last = state.get if state.exists else (0, 0.0, pd.Timestamp(0))
        out = []
        for row in pd.concat(list(parts)).sort_values(["ts", "seq"]).itertuples():
            count, total, last = count + 1, total + (0.0 if pd.isna(row.value) else row.value), max(last, row.ts)
            if count % n == 0:
                out.append((key[0], key[1], count, total, last))
        state.update((count, total, last))
        state.setTimeoutTimestamp(int(key[2]))
        yield pd.DataFrame(out, columns=["label", "win_start", "fired_at", "sum_v", "t"])

    narrow = watermarked(points, delay).select("label", "ts", F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"))
    w = F.window("ts", size)
    keyed = narrow.withColumns({"win_start": w["start"], "win_end": F.unix_millis(w["end"])})
    return keyed.groupBy("label", "win_start", "win_end").applyInPandasWithState(run, "label string, win_start timestamp, fired_at int, sum_v double, t timestamp", "count int, total double, last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_join(a: DataFrame, b: DataFrame, key: str, size: str, delay: str = "0 seconds") -> DataFrame:
    """Pairs of two streams' points of one key within one window: a_seq, b_seq. State goes with the watermark."""
    def side(df: DataFrame, name: str) -> DataFrame:
        w = watermarked(df, delay).select(F.col(key).alias(f"{name}_key"), F.col("seq").alias(f"{name}_seq"), F.window("ts", size).alias(f"{name}_w"))
        return w

    on = F.expr("a_key = b_key AND a_w = b_w")
    return side(a, "a").join(side(b, "b"), on).select("a_seq", "b_seq")
