"""A source of one's own: Spark's Python data source interface, with points that are computed and not read.

    spark.dataSource.register(SignalSource)
    spark.read.format("signals").option("labels", "HR,RESP").option("rows", 1000).load()

A source that reads from elsewhere has the same two parts: partitions(), which splits the work, and read(), which runs on an
executor and yields the rows, or Arrow batches, of one part. Rows depend on their number alone, so a part that is read
again gives the same ones.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Part(InputPartition):
    def __init__(self, label: str, first: int, last: int) -> None:
        self.label, self.first, self.last = label, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.labels = options.get("labels", "HR").split(",")
        self.rows, self.part = int(options.get("rows", 1000)), int(options.get("rowspersplit", 100_000))
        self.step = int(options.get("stepseconds", 60))
        self.start = datetime.datetime.fromisoformat(options.get("start", "2020-01-01T00:00:00+00:00"))

    def partitions(self) -> list[_Part]:
        return [_Part(k, i, min(i + self.part, self.rows)) for k in self.labels for i in range(0, self.rows, self.part)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        for lo in range(part.first, part.last, 10_000):
            n = np.arange(lo, min(lo + 10_000, part.last))
            us = int(self.start.timestamp()) * 1_000_000 + n * self.step * 1_000_000
            value = 80 + 10 * np.sin(n / 50) + (n * 7919 + len(part.label)) % 11
            yield pa.RecordBatch.from_arrays([pa.array([part.label] * len(n)), pa.array(us, pa.timestamp("us", "UTC")), pa.array(value), pa.array(n)], names=["label", "ts", "value", "seq"])


class SignalSource(DataSource):
    """Points (label, ts, value, seq): options labels, rows (a label), rowsPerSplit, stepSeconds, start."""

    @classmethod
    def name(cls) -> str:
        return "signals"

    def schema(self) -> str:
        return "label string, ts timestamp, value double, seq long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
