"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records by a seeded hash of the whole record into buckets that fit in memory: their number follows
from the bytes there are. Pass 2 puts each bucket in a fixed order, shuffles it by Fisher-Yates with the seed of its
number, and deals its rows out. Buckets follow each other in one sequence, of which the shards take every n-th row, so
the shards' row counts are at most one apart (law `rows`) and slots have no gap.

A partition holds a range of buckets, one after the other, and keeps one in memory at a time; there are at most PARTS
partitions, and all that is known beforehand of each is where it begins. A task that is lost and run again sorts the same
rows and draws the same order, whatever order the shuffle brought them in.

Rows that are equal in all columns would share a bucket. Where a bucket holds over OVER times its bytes, equal rows are
counted, so that a record travels once with its number of copies, and the copies are scattered by record and number.

Defined results: null text counts as no bytes (size 1). Rows are told apart by all their columns; rows that are equal in
all of them may change places among themselves, which can't be seen (-0.0 counts as 0.0 there). Columns of any other
names stay; shard, slot and size replace columns of these names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched, table
from pulsegrid.llm.textkit import grouped, runs

#: Bytes of text in a bucket, and buckets in a partition.
BUCKET, TOGETHER = 8 << 20, 4
#: Partitions at most; then more buckets go to each.
PARTS = 20_000
#: A bucket of so many times BUCKET has rows that repeat, or one text of that length.
OVER = 4
#: Copies of a record that one task makes at a time.
COPIES = 10_000


def fisher_yates(n: int, seed: tuple[int, int]) -> np.ndarray:
    """A permutation of range(n): from the end on, each place changes with a random one up to it."""
    out = np.arange(n)
    picks = (np.random.Generator(np.random.PCG64(seed)).random(n) * np.arange(1, n + 1)).astype(np.int64)
    out, picks = out.tolist(), picks.tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def _shuffle(batches: Iterator[pa.RecordBatch], seed: int, shards: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    first, at = None, 0
    for batch, _, _ in grouped(batches, "bucket", 1 << 40):
        keys, starts = batch["bucket"].to_numpy(), batch["before"].to_numpy()
        cut = runs(keys)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if starts[lo] != first:  # the first bucket of a partition
                first = at = int(starts[lo])
            order = fisher_yates(hi - lo, (seed, int(keys[lo]))) + lo
            place = np.arange(at, at + hi - lo)
            at += hi - lo
            moved = batch.select(["row", "size"]).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([*moved["row"].flatten(), moved["size"], pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names=[*names, "size", "shard", "slot"])


def _scattered(rows: DataFrame, buckets: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """rows (row, size, key) with bucket, equal rows scattered too; and (bucket, n): how many rows a bucket has."""
    placed = lambda x: x.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    hashed = placed(rows)
    counts = table(hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "buckets")
    over = counts.where(F.col("bytes") > OVER * bucket).select("bucket")
    if not over.take(1):
        return hashed, counts.drop("bytes")
    equal = table(hashed.join(over, "bucket", "left_semi").groupBy("row", "size", "key").agg(F.count("*").alias("copies")), "equal")
    # Copies are made some at a time, so that no task makes all those of a record.
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    one = F.explode(F.sequence("from", F.least(F.col("copies"), F.col("from") + COPIES) - 1))
    scattered = lambda x: placed(x.withColumn("from", some).repartition(F.xxhash64("key", "from")).withColumn("copy", one).withColumn("key", F.xxhash64("key", "copy"))).drop("from", "copy", "copies")
    more = scattered(equal.select("key", "copies")).groupBy("bucket").agg(F.count("*").alias("n"))
    rest = hashed.join(over, "bucket", "left_anti").select("row", "size", "key", "bucket")
    return rest.unionByName(scattered(equal)), counts.drop("bytes").join(over, "bucket", "left_anti").unionByName(more)


def shard(docs: DataFrame, *, shards: int = 8, seed: int = 11, bucket: int = BUCKET, together: int = TOGETHER) -> DataFrame:
    """All rows of docs (with a column text) with size, shard (0 to shards - 1) and slot (from 0 in each shard).

    A partition of the result holds one range of slots of each shard, and ranges follow each other as partitions do.
    """
    docs = docs.drop("shard", "slot", "size")
    cells = [F.col(f"`{n}`") for n in docs.columns]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // bucket))
    parts = min(PARTS, -(-buckets // together))
    part = F.floor(F.col("bucket") * parts / F.lit(buckets)).cast("int")
    # Packed, so that no column's name gets in the way.
    rows, counts = _scattered(docs.select(F.struct(*cells).alias("row"), size.alias("size"), F.xxhash64(F.lit(seed), *cells).alias("key")), buckets, bucket)
    # A row a partition: PARTS rows at most, in one task and then broadcast.
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).select("p", F.coalesce(before, F.lit(0)).alias("before"))
    dealt = rows.withColumn("part", part).join(F.broadcast(table(starts, "starts")), F.col("part") == F.col("p"))
    placed = dealt.repartitionById(parts, "part").sortWithinPartitions("bucket", "key", "row").select("row", "size", "bucket", "before")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return batched(placed, partial(_shuffle, seed=seed, shards=shards, names=docs.columns), f"{fields}, size long, shard int, slot long")


def write(docs: DataFrame, path: str, *, shards: int = 8, file: int = 64 << 20, bucket: int = BUCKET, **how) -> None:
    """Write the shuffled rows as one folder a shard: files of about `file` bytes of text, each a range of slots in order."""
    together = max(1, shards * file // bucket)
    found = shard(docs, shards=shards, bucket=bucket, together=together, **how)
    found.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
