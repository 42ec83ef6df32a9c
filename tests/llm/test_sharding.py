import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pulsegrid.llm import queries, sharding


def test_fisher_yates_is_a_uniform_permutation():
    seen = Counter(tuple(sharding.fisher_yates(3, (1, i))) for i in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1200 and min(seen.values()) > 800
    assert np.array_equal(sharding.fisher_yates(50, (1, 2)), sharding.fisher_yates(50, (1, 2)))
    assert len(sharding.fisher_yates(0, (1, 2))) == 0


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_row_once_and_shards_even(awkward, nothing):
    for bucket in (50_000, 1 << 25):
        got = sharding.shard(awkward, shards=4, bucket=bucket)
        rows = got.collect()
        assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((r.doc_id, r.text)) for r in awkward.collect())
        counts = Counter(r.shard for r in rows)
        assert max(counts.values()) - min(counts.get(i, 0) for i in range(4)) <= 1
        for s, n in counts.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
        assert all(r.size == len((r.text or "").encode()) + 1 for r in rows)
    assert sharding.shard(nothing).count() == 0


def test_order_of_input_and_partitions_do_not_matter(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('t', id % 7) as text")
    a = sharding.shard(df.repartition(2), bucket=2000)
    b = sharding.shard(df.orderBy("text").coalesce(1), bucket=2000)
    assert rows_of(a) == rows_of(b)
    assert rows_of(a) != rows_of(sharding.shard(df, bucket=2000, seed=5))


def test_many_buckets_share_few_partitions(spark, monkeypatch):
    df = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    a = rows_of(sharding.shard(df, bucket=100, together=1))
    monkeypatch.setattr(sharding, "PARTS", 3)
    got = sharding.shard(df, bucket=100)
    assert rows_of(got) == a and got.rdd.getNumPartitions() == 3


def test_equal_rows_are_scattered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    df = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id) as doc_id", "if(id % 3 = 0, 'the same text of some length', concat('t', id)) as text", "if(id % 3 = 0, null, 'n') as copy", "'mine' as bucket", "1 as `a.b`", "2 as key")
    got = sharding.shard(df.repartition(3), bucket=1000)
    rows = got.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(375))
    held = got.where("doc_id = -1").groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 5 and max(r[1] for r in held) < 400
    assert rows_of(got) == rows_of(sharding.shard(df.orderBy("text").coalesce(2), bucket=1000))


def test_the_query_against_plain_code(spark, awkward, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op7_sharding"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = got.collect()
    plain = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == Counter(plain(r.doc_id, r.text) for r in awkward.collect())
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.get(i, 0) for i in range(8)) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())


def test_the_order_is_that_of_the_two_passes(spark):
    """Buckets by the seeded hash, rows in order of their hash, Fisher-Yates, every n-th row to a shard."""
    df = spark.range(400).selectExpr("id as doc_id", "concat('t', id) as text")
    total = sum(len(f"t{i}") + 1 for i in range(400))
    buckets = -(-total // 300)
    keyed = df.select("doc_id", "text", F.xxhash64(F.lit(11), "doc_id", "text").alias("k")).collect()
    line = []
    for b in range(buckets):
        mine = sorted((r.k, r.doc_id) for r in keyed if r.k % buckets == b)
        line += [mine[i][1] for i in sharding.fisher_yates(len(mine), (11, b))]
    got = sorted((r.slot, r.shard, r.doc_id) for r in sharding.shard(df, shards=8, bucket=300).collect())
    assert [x[2] for x in got] == line


def test_written_shards(spark, tmp_path):
    df = spark.range(100).selectExpr("id as doc_id", "cast(id as string) as text")
    sharding.write(df, str(tmp_path / "s"), shards=3)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == 100 and {r.shard for r in got.select("shard").distinct().collect()} == {0, 1, 2}
    sharding.write(df, str(tmp_path / "t"), shards=3, bucket=20, file=40)
    for s in range(3):
        files = sorted((tmp_path / "t" / f"shard={s}").glob("*.parquet"))
        slots = [x for f in files for x in pq.read_table(f)["slot"].to_pylist()]
        assert len(files) > 1 and slots == list(range(len(slots)))
