"""Exact top-k search by inner product: the three-phase uniform threshold algorithm.

The components of the vectors are cut into `lists` ranges; each range is a list that scores every vector by its part
of the inner product. A query's score of a vector is the sum over the lists. Vectors and queries are packed into blocks
of fixed size, and each block of queries meets each block of vectors, as an equi-join on block numbers.

1. Gather: in each block, each list names the k highest partial scores of a query. The sums of the vectors named are
   complete, as a block has all lists of its vectors; the k-th highest sum of all is a floor that the final k-th can't
   be under.
2. Cutoff: the floor divided by the number of lists goes back with the queries. A vector under it in every list sums to
   less than the floor, so only vectors with an entry at the cutoff or over are looked at further.
3. Resolve: their missing parts are added in the block. What reaches the floor is sent, at most the k best of a block for
   a query (no other can be among its k best of all), and ranked.

So what is sent grows with queries times k, plus what lies between the floor and the final k-th score; the products
themselves grow with queries times vectors, as the question does. Nothing is broadcast and nothing comes to the driver
but two counts.

Defined results: vectors null, or with null, NaN or infinite components, or that scaling makes infinite, take no part as
query or candidate. Components are scaled to floor(scale * x) in double precision and multiplied as whole numbers of any
size: pairs whose products may leave 62 bits are computed one by one in unbounded integers. A score outside of 64 bits is
given, and ranked, as the nearest 64-bit number. Shorter vectors count as followed by zeros; an empty one scores 0. Rows
without vec_id take no part. Every row is a candidate for every query but for itself, and a query of its own if its
vec_id is asked for, also where a vec_id or a whole row repeats. Fewer than k candidates: all of them. Ties go to the
smaller vec_id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched, table

VECTORS, QUERIES = 4096, 256
#: Scores stay under this, and components too, where they are computed in machine numbers.
WIDE = 2.0**62
#: A floor for queries with fewer than k candidates: under every such score.
LOWEST = -(2**62)
_FOUND = pa.schema([("q_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled(df: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, v) of the rows that take part: v has whole numbers as doubles, row tells rows apart."""
    x = F.col("embedding")
    y = F.transform(x, lambda c: c.cast("double") * F.lit(float(scale)))
    fine = x.isNotNull() & F.col("vec_id").isNotNull()
    # From 2^53 on, doubles are whole.
    whole = F.transform("y", lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(c).cast("double")).otherwise(c))
    out = df.where(fine).select(F.col("vec_id").cast("long"), y.alias("y"))
    out = out.where(F.forall("y", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return out.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v"))


def _pack(batches: Iterator[pa.RecordBatch], rows: int, dim: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors as binary: rows, ids, components, and the floors where the column is there."""
    schema = pa.schema([(c, pa.binary()) for c in ("rows", "ids", "v", "floor")])
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            out = np.zeros((part.num_rows, dim))
            lists = part["v"]
            size = np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(len(size)), size)
            out[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
            floor = part["floor"].to_numpy(zero_copy_only=False).astype(np.int64) if "floor" in part.schema.names else np.zeros(part.num_rows, np.int64)
            cells = (part["row"].to_numpy(), part["vec_id"].to_numpy(), out, floor)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], schema=schema)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, all under 2^62; by floating point where that is exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def wide_pairs(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs are for unbounded integers: a component, or the sum of the products, may leave 62 bits."""
    a, b = np.abs(q).max(1, initial=0), np.abs(v).max(1, initial=0)
    with np.errstate(over="ignore"):
        return (a[:, None] >= WIDE) | (b[None, :] >= WIDE) | (a[:, None] * b[None, :] >= WIDE / max(1, q.shape[1]))


def unbounded(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one q with rows of v as 64-bit numbers, the nearest one where they leave these."""
    whole = [int(x) for x in q]
    low, high = -(2**63), 2**63 - 1
    return np.array([min(max(sum(a * int(b) for a, b in zip(whole, row, strict=True) if a and b), low), high) for row in v], np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best by score, then by smaller id."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= kth)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], ~score[near]))[:k]]


def _score(batches: Iterator[pa.RecordBatch], dim: int, lists: int, k: int, cutoff: bool) -> Iterator[pa.RecordBatch]:
    cuts = np.linspace(0, dim, lists + 1).astype(int)
    for batch in batches:
        for row in zip(*(batch[c] for c in ("q_rows", "q_ids", "q_v", "q_floor", "rows", "ids", "v")), strict=True):
            q_rows, q_ids, q, floor, rows, ids, v = (np.frombuffer(x.as_buffer(), np.float64 if i in (2, 6) else np.int64) for i, x in enumerate(row))
            q, v = q.reshape(len(q_ids), dim), v.reshape(len(ids), dim)
            # Every wide pair has a side that is left out of the products; pairs of what is left out go one by one.
            wide = wide_pairs(q, v)
            out_q, out_v = wide.any(1), wide.any(0)
            if out_q.sum() * len(ids) <= out_v.sum() * len(q_ids):
                out_v = np.zeros(len(ids), bool)
            else:
                out_q = np.zeros(len(q_ids), bool)
            qs, vs = (np.where(x[:, None], 0, y) if x.any() else y for x, y in ((out_q, q), (out_v, v)))
            own = q_rows[:, None] == rows[None, :]
            skip = own | out_q[:, None] | out_v[None, :]
            parts = [products(qs[:, a:b], vs[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            whole = sum(parts)
            if cutoff:
                cut = -(-floor // lists)[:, None]
                chosen = np.zeros(whole.shape, bool)
                for part in parts:
                    chosen |= part >= cut
                chosen &= (whole >= floor[:, None]) & ~skip
            else:
                chosen = np.zeros(whole.shape, bool)
                for part in parts:
                    part[skip] = np.iinfo(np.int64).min
                    n = min(k, part.shape[1])
                    np.put_along_axis(chosen, np.argpartition(part, part.shape[1] - n, axis=1)[:, -n:], True, axis=1)
                chosen &= ~skip
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in np.flatnonzero(chosen.any(1) | (skip & ~own).any(1)):
                at = np.flatnonzero(chosen[i])
                score = whole[i, at]
                rest = np.flatnonzero(skip[i] & ~own[i])
                if len(rest):
                    at, score = np.concatenate([at, rest]), np.concatenate([score, unbounded(q[i], v[rest])])
                top = _best(score, ids[at], k)
                found.append((np.full(len(top), i), at[top], score[top]))
            if found:
                i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[i]), pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score)], schema=_FOUND)


def topk(vectors: DataFrame, queries: Column | str, *, k: int = 10, scale: int = 1024, lists: int = 2) -> DataFrame:
    """The k highest integer inner products of each query among all other rows.

    vectors has vec_id and embedding; queries is a condition on vec_id. Returns query_id, rank (from 1), vec_id, score.
    """
    all_ = table(scaled(vectors, scale), "vectors")
    dim, n = all_.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    dim = max(int(dim), lists)
    n_blocks = max(1, -(-n // VECTORS))
    packed = "rows binary, ids binary, v binary, floor binary"
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks))
    blocks = batched(all_.withColumn("block", number("row")).repartition("block"), partial(_pack, rows=VECTORS, dim=dim), packed)
    # A block's number is its hash; blocks of equal number only share a task.
    blocks = table(blocks.withColumn("block", number("rows")).drop("floor"), "blocks")

    def best(q: DataFrame, cutoff: bool) -> DataFrame:
        packs = batched(q.repartition("row"), partial(_pack, rows=QUERIES, dim=dim), packed).toDF("q_rows", "q_ids", "q_v", "q_floor")
        packs = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
        met = blocks.join(packs.hint("shuffle_hash"), "block").drop("block")
        found = batched(met, partial(_score, dim=dim, lists=lists, k=k, cutoff=cutoff), "q_row long, query_id long, vec_id long, score long")
        order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = all_.where(queries)
    seen = best(asked, False)
    floors = seen.groupBy(F.col("q_row").alias("row")).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    # A floor over 62 bits comes from unbounded integers, which are sent in any case.
    low = F.when(F.col("n") >= k, F.least(F.col("low"), F.lit(2**62))).otherwise(F.lit(LOWEST))
    told = table(asked.join(floors, "row", "left").select("row", "vec_id", "v", F.greatest(F.coalesce(low, F.lit(LOWEST)), F.lit(LOWEST)).alias("floor")), "floors")
    return best(told, True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
