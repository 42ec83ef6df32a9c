"""Every named query of the engine with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that has the same rows where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as narrow signal points: label, ts, value, seq (the tie-break)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("seq"), F.col("user_id").alias("entity"))


def load() -> None:
    """Import the modules that register queries."""
    from pulsegrid.plans import clinical, learning, series, tables  # noqa: F401


load()
