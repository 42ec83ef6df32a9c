"""Storage and session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of tables that are still there, oldest first.
_written: list[tuple[SparkSession, str]] = []
#: The folder that a reader of table() reads.
_folders: weakref.WeakKeyDictionary[DataFrame, tuple[SparkSession, str]] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a temporary one of this machine, if Spark runs on this machine alone; else ValueError, as
    executors would write to disks of their own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Shuffle files go when their query ends. Otherwise they stay until the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that begin here leave no shuffle files."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a reader of it.

    The lineage ends there: a lost executor costs no upstream work, later readers prune columns, and the shuffle files
    of the way there go at once. The tables go when staged() is done with them, or when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/pulsegrid-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.parquet(f"{folder}/{name}")
    if not _written:
        atexit.register(_drop, _written)
    _written.append((spark, folder))
    out = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    _folders[out] = _written[-1]
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    done = [_folders.pop(t) for t in tables]
    _written[:] = [x for x in _written if x not in done]
    _drop(done)


def staged(stage: Callable, spark: SparkSession, docs: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """The rows of a stage as a table. What the stage wrote on its way goes, and docs, if it is a table of table()."""
    before = [x for x in _written if x != _folders.get(docs)]
    out = table(stage(spark, docs, sf_dir), name)
    done = [x for x in _written if x not in before and x != _folders[out]]
    _written[:] = [x for x in _written if x not in done]
    _drop(done)
    return out


def _drop(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone: the files are the cluster's to clean
            return


#: Bytes of a batch that goes to a Python worker, where the session doesn't say another number.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


class _Freed:
    """A function of batches that gives memory back to the system when its task ends: workers live on for other tasks."""

    def __init__(self, f: Callable) -> None:
        self.f = f

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from self.f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not with every C library
            ctypes.CDLL(None).malloc_trim(0)


def batched(df: DataFrame, f: Callable, shape: str) -> DataFrame:
    """df.mapInArrow(f, shape) in batches of bounded bytes, whatever the length of the texts."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH))
    return df.mapInArrow(_Freed(f), shape)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def beside(docs: DataFrame, needed: tuple[str, ...], own: tuple[str, ...], keep) -> DataFrame:
    """keep(docs), with the columns of docs as they were, also those that have the names in `own` that keep() gives.

    keep() takes rows with the needed columns at least, and gives some of them with other columns added.
    """
    if not set(own) & set(docs.columns):
        return keep(docs).select(*docs.columns)
    packed = docs.select(F.struct(*docs.columns).alias("__row"), *needed)
    return keep(packed).select("__row.*")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps until the edges stay as they are; every round is written to the
    shared folder. Only counts and a checksum reach the driver. A node of very high degree is met by a partial
    minimum before the shuffle and by a join that Spark can split.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, last = table(now, "edges"), None
    for _ in range(rounds):
        # Minima are tables of their own, so that the join with them is one that Spark can split where a node has many edges.
        both = now.union(now.select("v", "u"))
        low = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = table(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        lower = table(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", "m"))
        now, before = table(small.where("u <> v").distinct(), "edges"), now
        free(before, low, large, lower)
        with _cleaned(now.sparkSession):
            seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
