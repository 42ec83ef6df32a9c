"""Quality by random indexing: word vectors pooled per document, then a two-layer network in numpy whose probabilities
are calibrated by a temperature.

Words are hashed into a fixed number of buckets. Each bucket has a random index vector with one 1 and one -1. A bucket's
word vector is the sum of the index vectors of the words up to two places before and after its words, over the whole
corpus; each task adds up its texts in one small table and the tables are summed by parts. Word vectors are brought to
length 1. A document is the mean of its words' vectors. The network has one hidden layer (tanh) and one output; its
outputs are divided by the temperature that makes the probabilities of rows kept aside for it likeliest.

The table of word vectors has a fixed size (BUCKETS x WIDTH) whatever the corpus. The network is fitted on the driver on
at most `rows` labelled documents, those of the smallest hashes of doc_id. All else runs over all documents.

Defined results: null text is as empty; an empty text has the zero vector and so a score as well. Rows without label
train nothing; of rows that repeat a doc_id in labels, the largest counts, and of those that repeat one in documents the
smallest text trains. Without labelled rows of both kinds all
scores are the share of ones, or 0.5. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched
from pulsegrid.llm.textkit import U, words

BUCKETS, WIDTH = 1 << 13, 32
PARTS = 8
HIDDEN = 24


@cache
def _index() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector has its 1 and its -1."""
    r = np.random.Generator(np.random.PCG64(7))
    plus = r.integers(0, WIDTH, BUCKETS)
    return plus, (plus + 1 + r.integers(0, WIDTH - 1, BUCKETS)) % WIDTH


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - 13)).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * WIDTH, np.int64)  # of one task: each sum fits in 32 bits up to a billion words
    plus, minus = _index()
    for batch in batches:
        for w in words(batch["text"], lower=True, chunk=4 << 20):
            b, row = _bucket(w.hash), w.row
            for away in (1, 2):
                near = np.flatnonzero(row[away:] == row[:-away])
                one, two = b[near], b[near + away]
                for me, other in ((one, two), (two, one)):
                    total += np.bincount(me * WIDTH + plus[other], minlength=len(total))
                    total -= np.bincount(me * WIDTH + minus[other], minlength=len(total))
    for p, part in enumerate(total.reshape(PARTS, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([part.astype(np.int32).tobytes()], pa.binary())], names=["part", "sums"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, sums in zip(batch["part"].to_pylist(), batch["sums"], strict=True):
            x = np.frombuffer(sums.as_buffer(), np.int32).astype(np.int64)
            total[p] = total[p] + x if p in total else x
    for p, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, BUCKETS x WIDTH, of the whole corpus."""
    shape = "part int, sums binary"
    found = batched(batched(docs.select("text"), _contexts, shape).repartition(PARTS, "part"), _summed, shape)
    out = np.zeros((PARTS, BUCKETS * WIDTH // PARTS))
    for part, sums in found.collect():  # PARTS rows of a fixed size
        out[part] = np.frombuffer(sums, np.int64)
    out = out.reshape(BUCKETS, WIDTH)
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(column), vectors.shape[1]), np.float32)
    for w in words(column, lower=True, chunk=1 << 19):
        n = w.counts
        some = np.flatnonzero(n)
        if len(some):
            out[some + w.rows.start] = np.add.reduceat(vectors[_bucket(w.hash)], w.first[:-1][some], 0) / n[some, None]
    return out


def _pool(batches: Iterator[pa.RecordBatch], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pooled(batch["text"], vectors)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "label", "x"])


class Network:
    """tanh layer and one output over standardized input; probabilities by the logistic function at a temperature."""

    def __init__(self, width: int = WIDTH, share: float = 0.5) -> None:
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.w1, self.b1 = np.zeros((width, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = np.zeros(HIDDEN), float(np.log(share / (1 - share)))
        self.temperature = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Network:
    """Fit by Adam on four fifths of the rows, and the temperature on the rest. Rows come in a fixed order."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    net = Network(x.shape[1], share)
    if len(set(y.tolist())) < 2:
        return net
    aside = np.arange(len(x)) % 5 == 4
    tx, ty = x[~aside].astype(np.float64), y[~aside].astype(np.float64)
    net.mean, net.scale = tx.mean(0), tx.std(0) + 1e-6
    z = (tx - net.mean) / net.scale
    r = np.random.Generator(np.random.PCG64(3))
    params = [r.normal(0, 1 / np.sqrt(z.shape[1]), net.w1.shape), net.b1, r.normal(0, 0.1, HIDDEN), np.array(net.b2)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(z @ w1 + b1)
        e = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - ty) / len(ty)
        back = np.outer(e, w2) * (1 - h * h)
        for i, g in enumerate((z.T @ back + decay * w1, back.sum(0), h.T @ e + decay * w2, e.sum())):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3])
    raw, ay = net.raw(x[aside]), y[aside]
    if len(set(ay.tolist())) == 2:
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
        loss = [np.logaddexp(0, np.where(ay == 1, -raw, raw) / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out() -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, *, rows: int = 10_000) -> Network:
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("label"))
    known = known.groupBy("__id").agg(F.max("label").alias("label"))
    # The limit is the sample's documented bound; it also bounds what is broadcast.
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    docs = docs.select("doc_id", "text")
    texts = docs.join(F.broadcast(sample), docs["doc_id"].cast("long") == sample["__id"]).select(F.col("__id").alias("doc_id"), "text", "label")
    # One row a doc_id, so that the bound holds however often one repeats.
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = batched(texts, partial(_pool, vectors=vectors), "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1) if len(got) else np.zeros((0, WIDTH), np.float32)
    return fit(x.astype(np.float64), got["label"].to_numpy().astype(np.int64))


def _scores(batches: Iterator[pa.RecordBatch], vectors: np.ndarray, net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(net.predict(pooled(batch["text"], vectors)))], names=["doc_id", "score"])


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, rows: int = 10_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    vectors = word_vectors(docs)
    net = train(docs, labels, vectors, rows=rows)
    out = batched(docs.select(F.col("doc_id").cast("long"), "text"), partial(_scores, vectors=vectors, net=net), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
