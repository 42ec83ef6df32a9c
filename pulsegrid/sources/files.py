"""Signals from text files: wide rows, numerics files and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signals in the order of their columns.
SIGNALS = ("HR", "ABPSys", "ABPDias", "ABPMean", "RESP", "SpO2", "SOFA_SCORE")
#: Where a numerics file of the fixed layout has its signals.
NUMERICS = {"HR": 1, "ABPMean": 4, "PAPSys": 5, "CVP": 8, "PULSE": 9, "RESP": 10, "SpO2": 11, "NBPMean": 14}
STAMP = "HH:mm:ss dd/MM/yyyy"


def points_of(lines: DataFrame, labels: tuple[str, ...] = SIGNALS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """label, ts, value of lines (a column value) `time,v1,v2 ...`; lines with TIME are headers.

    Labels go with columns by place, and the shorter side ends the pairing; what can't be read is null and left out.
    """
    p = F.split("value", ",")
    rows = lines.where(~F.col("value").contains("TIME")).select(F.try_to_timestamp(F.get(p, F.lit(0)), F.lit(STAMP)).alias("ts"), F.slice(p, 2, len(labels)).alias("v"))
    named = F.arrays_zip(F.slice(F.array(*map(F.lit, labels)), F.lit(1), F.size("v")).alias("label"), F.col("v"))
    out = rows.select("ts", F.explode(named).alias("x")).select(F.col("x.label").alias("label"), "ts", F.trim("x.v").try_cast("double").alias("value"))
    out = out.where("ts is not null and value is not null")
    return out.where(F.col("label").isin(*keep)) if keep else out


def read_wide(spark: SparkSession, path: str, labels: tuple[str, ...] = SIGNALS, stream: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """A file, or a directory of files, of wide rows; as a stream if asked for."""
    return points_of((spark.readStream if stream else spark.read).text(path), labels, keep)


def read_numerics(spark: SparkSession, path: str) -> DataFrame:
    """A numerics file of the fixed layout: times in '[ ]', - for 0.0; label, ts, value."""
    p = F.split("value", ",")
    clean = lambda i: F.regexp_replace(F.trim(F.get(p, F.lit(i))), r"['\[\]]", "")
    v = lambda i: F.when(clean(i) == "-", 0.0).otherwise(clean(i).try_cast("double"))
    rows = spark.read.text(path).select(F.try_to_timestamp(clean(0), F.lit(STAMP)).alias("ts"), *(v(i).alias(k) for k, i in NUMERICS.items()))
    return rows.where("ts is not null").unpivot(["ts"], list(NUMERICS), "label", "value").select("label", "ts", "value")


def read_numerics_dir(spark: SparkSession, path: str, signals: tuple[str, ...]) -> DataFrame:
    """All .csv files under a directory, each with its own header: record, ts and a column a signal.

    A file's first line names its columns (in any case and order), its second line is a second header. Absent signals and
    - are 0.0. Headers are read as rows of their files and joined on the file's name: no file is opened on the driver.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.split(F.regexp_replace("value", r"['\[\]]", ""), ",").alias("p"))
    timed = F.try_to_timestamp(F.trim(F.get("p", F.lit(0))), F.lit(STAMP))
    names = lines.where(timed.isNull() & F.lower(F.get("p", F.lit(0))).contains("time")).groupBy("file").agg(F.first(F.transform("p", lambda n: F.lower(F.trim(n)))).alias("names"))
    rows = lines.withColumn("ts", timed).where("ts is not null").join(names, "file")
    at = lambda s: F.trim(F.get("p", (F.array_position("names", s.lower()) - 1).cast("int")))
    value = lambda s: F.when(F.array_contains("names", s.lower()) & (at(s) != "-"), at(s).try_cast("double"))
    record = F.regexp_extract("file", r"([^/]+)\.csv$", 1)
    return rows.select(record.alias("record"), "ts", *(F.coalesce(value(s), F.lit(0.0)).alias(s) for s in signals))


def read_features(spark: SparkSession, path: str, first: int, last: int, label: int, stamp: str = "yyyy-MM-dd HH:mm:ss", key: str = "patientId") -> DataFrame:
    """Feature rows of a text file: key, ts, label, features (columns first to last - 1); headers have no time."""
    p = F.split("value", ",")
    rows = spark.read.text(path).select(F.lit(key).alias("key"), F.try_to_timestamp(F.get(p, F.lit(1)), F.lit(stamp)).alias("ts"), F.get(p, F.lit(label)).alias("label"), F.transform(F.slice(p, first + 1, last - first), lambda x: x.try_cast("double")).alias("features"))
    return rows.where("ts is not null")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database; partitioning options pass through."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated text files, each with a header; null is empty."""
    df.write.mode(mode).option("header", True).csv(path)
