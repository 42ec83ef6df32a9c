import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import queries
from pulsegrid.llm import topk_search as T

LOW, HIGH = -(2**63), 2**63 - 1


def brute(rows, k, scale, every):
    fine = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(scale * x) for x in v):
            continue
        fine.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for at, (q, w) in enumerate(fine):
        if q % every == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(w, v)), LOW), HIGH), i) for n, (i, v) in enumerate(fine) if n != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=7, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score string").repartition(3)
    got = T.topk(df, F.col("vec_id") % every == 0, k=k, **how).collect()
    held = np.float32 if kind == "float" else np.float64
    plain = [(i, None if v is None else [None if x is None else float(held(x)) for x in v]) for i, v, _ in rows]
    assert sorted(tuple(r) for r in got) == brute(plain, k, 1024, every)


def test_random_and_clustered(spark, monkeypatch):
    monkeypatch.setattr(T, "VECTORS", 40)
    monkeypatch.setattr(T, "QUERIES", 3)
    r = np.random.default_rng(3)
    centres = r.normal(size=(5, 8))
    rows = [(i, (r.normal(size=8) if i % 2 else centres[i % 5] + 0.1 * r.normal(size=8)).tolist(), "x") for i in range(200)]
    for lists in (1, 2, 3):
        check(spark, rows, lists=lists)


def test_ties_nulls_repeats_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5], None) for i in range(15)] + [(3, [1.0, 0.5], "again"), (4, [0.0, 0.0], "other"), (20, None, None), (21, [nan, 1.0], None), (22, [inf, 1.0], None), (28, [None, 1.0], None), (None, [1.0, 1.0], None), (35, [], None), (42, [2.0], None), (49, [-1.0, 0.3, 5.0], None)]
    check(spark, rows)
    check(spark, rows[:3])


def test_rows_that_repeat_are_candidates_and_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "VECTORS", 7)
    rows = [(7, [1.0, 2.0], None), (7, [1.0, 2.0], None), (7, [3.0, -2.0], None), *((i % 4, [float(i), 1.0], None) for i in range(30)), *((14, [2.0, 2.0], None) for _ in range(20))]
    check(spark, rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_components(spark, monkeypatch, kind):
    monkeypatch.setattr(T, "VECTORS", 16)
    r = np.random.default_rng(8)
    large = [(7, [1e7, 1.0, 0.0]), (14, [1e7, -1.0, 3.0]), (21, [-1e7, 1.0, 2.0]), (3, [3e6, 1e7, -1e7]), (4, [3e9, 0.0, 1.0]), (28, [1e30, -1e30, 1.0]), (5, [1e30, 1e30, 0.0]), (7, [1e7, 1.0, 0.0]), (35, [2.0**21, 2.0**21, 2.0**21]), (6, [0.0, 0.0, 1e-30])]
    if kind == "double":
        large += [(42, [1e300, 1.0, 1.0]), (8, [1e306, 0.0, 0.0]), (49, [-1e200, 1e200, 5e-324])]
    rows = [(i, v, None) for i, v in large] + [(int(i), (r.normal(size=3) * 10.0 ** r.integers(-3, 9)).tolist(), None) for i in r.integers(0, 90, 60)]
    for lists in (1, 2, 3):
        check(spark, rows, lists=lists, kind=kind)


def test_products_do_not_wrap():
    q, v = np.array([[2.0**31 - 1, 2.0**29]]), np.array([[2.0**29, -(2.0**30)], [1.0, 1.0]])
    assert not T.wide_pairs(q, v).any()
    assert T.products(q, v).tolist() == [[int(2**31 - 1) * 2**29 - 2**59, 2**31 - 1 + 2**29]]
    assert T.wide_pairs(np.array([[2.0**31]]), np.array([[2.0**31], [2.0**29]])).tolist() == [[True, False]]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.topk(df, F.col("vec_id") % 2 == 0).count() == 0


def test_little_is_sent():
    """What reaches the last ranking is near k a query, not a share of all pairs."""
    r = np.random.default_rng(0)
    q, v = np.floor(1024 * r.normal(size=(20, 16))), np.floor(1024 * r.normal(size=(4000, 16)))

    def sent(floor, cutoff):
        cells = [np.arange(20), np.arange(20), q, floor, np.arange(20, 4020), np.arange(20, 4020), v]
        batch = pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in cells], names=["q_rows", "q_ids", "q_v", "q_floor", "rows", "ids", "v"])
        return next(T._score(iter([batch]), dim=16, lists=2, k=10, cutoff=cutoff)).to_pandas()

    floor = sent(np.zeros(20, np.int64), False).groupby("q_row")["score"].min().to_numpy()
    assert len(sent(floor, True)) == 200


def test_same_rows_as_sql_with_repeated_ids(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(int(i), r.integers(-3, 4, 4).astype(float).tolist()) for i in [*range(60), 0, 0, 100, 100, 5]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.queries()["op5_topk_search"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(queries.OP5_SQL).fetchall())
