"""Points as messages: ts,key,value with the time in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode(points: DataFrame) -> DataFrame:
    """key null and value text, the shape that a Kafka sink takes."""
    return points.select(F.lit(None).cast("binary").alias("key"), F.concat_ws(",", F.unix_millis("ts").cast("string"), "label", F.col("value").cast("string")).cast("binary").alias("value"))


def decode(messages: DataFrame) -> DataFrame:
    """ts, key, value of messages; a message of another shape gives nulls."""
    p = F.split(F.col("value").cast("string"), ",")
    at = lambda i: F.get(p, F.lit(i))
    return messages.select(F.timestamp_millis(at(0).try_cast("long")).alias("ts"), at(1).alias("key"), at(2).try_cast("double").alias("value"))


def encode_keyed(points: DataFrame) -> DataFrame:
    """key null and value `key: label, time: milliseconds, value: value`, the form for reading by eye."""
    text = F.concat_ws(", ", F.concat(F.lit("key: "), F.coalesce("label", F.lit(""))), F.concat(F.lit("time: "), F.unix_millis("ts").cast("string")), F.concat(F.lit("value: "), F.coalesce(F.col("value").cast("string"), F.lit(""))))
    return points.select(F.lit(None).cast("binary").alias("key"), text.cast("binary").alias("value"))


def encode_row(rows: DataFrame) -> DataFrame:
    """key null and all columns as one line of comma-separated values."""
    return rows.select(F.lit(None).cast("binary").alias("key"), F.to_csv(F.struct(*(F.col(c).cast("string") for c in rows.columns))).cast("binary").alias("value"))


def numbered(batch: DataFrame, number: int) -> DataFrame:
    """Messages with headers: the batch, and the message's number among equal ones, which a repeated batch gives again."""
    same = F.row_number().over(Window.partitionBy("key", "value").orderBy(F.lit(0)))
    named = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value"))
    return batch.select("key", "value", F.array(named("batch", F.lit(number)), named("same", same)).alias("headers"))


def once(messages: DataFrame) -> DataFrame:
    """Messages (key, value, headers) without those that a repeated batch sent again; order isn't kept."""
    return messages.dropDuplicates(["key", "value", "headers"])
