"""Toxicity by a classifier chain: categories are predicted one after the other, each from the text and the
probabilities of the categories before it.

Texts are seen as sets of features: words, their first 4, 5 and 6 bytes, and the last 2 bytes of what stands between
spaces, hashed into a fixed number of buckets. The features that tell most about a category (chi squared) are chosen, a
fixed number for each. A category's model is linear (logistic, L2). What later models see of earlier categories are
out-of-fold probabilities: each row's come from models fitted without its fold, on features that were chosen without its
fold too, so that later models learn how far the earlier ones can be relied on. For new texts the models fitted on all
rows run in the same order.

Models are fitted on at most `rows` labelled documents, those of the smallest hashes of doc_id: a bounded sample, on
the driver, one row a doc_id. Counts for the choice of features are made on the executors, by fold. Everything else runs
over all documents.

Defined results: null text is as empty. A category's label is null where its column is null: such rows don't train it.
Without labelled rows of both kinds a category's probability is the share of ones (0 without any). Of rows that repeat
a doc_id in labels, ones win; of rows that repeat one in documents, the smallest text trains and all are scored. Columns of any other names stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched, beside, table
from pulsegrid.llm.textkit import U, byte_values, letters, spans, words

BUCKETS = 1 << 20
CHOSEN = 192
FOLDS = 4
SAMPLE_PARTS = 8
L2 = 0.5


def _features(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Some rows at a time: (rows, row, bucket) of every feature, with repeats."""
    for w in words(column, lower=True, space=letters()):
        source = byte_values(True)[w.data]
        size = w.end - w.start
        rows, found = [w.row], [w.hash]
        for n in (4, 5, 6):
            long = np.flatnonzero(size >= n)
            rows.append(w.row[long])
            found.append(spans(source, w.start[long], w.start[long] + n) + U(n))
        yield w.rows, np.concatenate(rows), (np.concatenate(found) >> U(40)) & U(BUCKETS - 1)
    for w in words(column, lower=True):
        long = np.flatnonzero(w.end - w.start >= 2)
        yield w.rows, w.row[long], (spans(byte_values(True)[w.data], w.end[long] - 2, w.end[long]) + U(2) >> U(40)) & U(BUCKETS - 1)


def _count(batches: Iterator[pa.RecordBatch], categories: int) -> Iterator[pa.RecordBatch]:
    """By fold, how many documents, and how many of each category, have each feature."""
    total = np.zeros((FOLDS, 1 + 2 * categories, BUCKETS), np.int32)
    names = ["fold", "feature", *(f"c{i}" for i in range(1 + 2 * categories))]
    for batch in batches:
        labels = [batch[f"l{i}"].fill_null(-1).to_numpy(zero_copy_only=False) for i in range(categories)]
        fold = batch["fold"].to_numpy()
        for at, row, bucket in _features(batch["text"]):
            pair = np.unique(row.astype(np.int64) * BUCKETS + bucket.astype(np.int64))
            row, bucket = pair // BUCKETS + at.start, pair % BUCKETS
            np.add.at(total, (fold[row], 0, bucket), 1)
            for i, y in enumerate(labels):
                for place, hit in ((1 + 2 * i, y[row] >= 0), (2 + 2 * i, y[row] == 1)):
                    np.add.at(total, (fold[row[hit]], place, bucket[hit]), 1)
    for f in range(FOLDS):
        used = np.flatnonzero(total[f, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), f, np.int32)), pa.array(used), *(pa.array(c[used].astype(np.int64)) for c in total[f])], names=names)


def _vectors(column: pa.Array, place: np.ndarray, width: int) -> np.ndarray:
    """Rows of zeros and ones for the chosen features; place has each bucket's column or -1."""
    out = np.zeros((len(column), width), np.float32)
    for at, row, bucket in _features(column):
        to = place[bucket]
        hit = to >= 0
        out[row[hit] + at.start, to[hit]] = 1
    return out


def _place(features: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, -1, np.int32)
    out[features] = np.arange(len(features))
    return out


def _sample(batches: Iterator[pa.RecordBatch], features: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    place = _place(features)
    for batch in batches:
        bits = np.packbits(_vectors(batch["text"], place, len(features)).astype(bool), axis=1)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array([b.tobytes() for b in bits], pa.binary())], names=[*names, "bits"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 8) -> np.ndarray:
    """Logistic regression with an L2 penalty on all but the last weight, the constant; Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    penalty = np.full(len(w), L2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        pull = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, pull)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Chain:
    """The fitted chain: chosen features and, in order, each category's weights."""

    def __init__(self, features: np.ndarray, weights: list[np.ndarray]) -> None:
        self.features, self.weights = features, weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        known = x.astype(np.float64)
        out = []
        for w in self.weights:
            p = sigmoid(known @ w[:-1] + w[-1])
            out.append(p)
            known = np.hstack([known, logit(p)[:, None]])
        return np.stack(out, 1) if out else np.zeros((len(x), 0))


def fit_chain(features: np.ndarray, x: np.ndarray, labels: np.ndarray, fold: np.ndarray | None = None, chosen: list[np.ndarray] | None = None) -> Chain:
    """labels: a column a category in the chain's order, -1 for unknown. Rows come in a fixed order.

    chosen: for each fold, the columns of x that were chosen without it, and last those chosen on all rows.
    """
    fold = np.arange(len(x)) % FOLDS if fold is None else fold
    chosen = [np.ones(len(features), bool)] * (FOLDS + 1) if chosen is None else chosen
    ahead, weights = np.zeros((len(x), 0)), []  # of the categories so far
    for y in labels.T:
        have = y >= 0
        share = float(y[have].mean()) if have.any() else 0.0
        found = np.full(len(x), share)
        seen = lambda columns: np.hstack([x[:, columns].astype(np.float64), ahead])  # noqa: B023, E731
        if len(set(y[have].tolist())) < 2:
            w = np.zeros(int(chosen[-1].sum()) + ahead.shape[1] + 1)
            w[-1] = 30 if share == 1 else -30
        else:
            w = fit_linear(seen(chosen[-1])[have], y[have])
            for f in range(FOLDS):
                train, test = have & (fold != f), fold == f
                if train.any() and test.any():
                    known = seen(chosen[f])
                    v = fit_linear(known[train], y[train])
                    found[test] = sigmoid(known[test] @ v[:-1] + v[-1])
        weights.append(w)
        ahead = np.hstack([ahead, logit(found)[:, None]])
    return Chain(features[chosen[-1]], weights)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, rows: int = 8000) -> Chain:
    """Fit the chain on at most `rows` labelled documents. categories: name and 0/1 expression over labels, in order."""
    names = [f"l{i}" for i in range(len(categories))]
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id"), *(c.cast("int").alias(n) for n, c in zip(names, categories.values(), strict=True)))
    known = known.groupBy("__id").agg(*(F.max(n).alias(n) for n in names))
    # The limit is the sample's documented bound; it also bounds what is broadcast.
    order = F.xxhash64("__id")
    sample = known.orderBy(order, "__id").limit(rows)
    docs = docs.select("doc_id", "text")
    texts = docs.join(F.broadcast(sample), docs["doc_id"].cast("long") == sample["__id"]).select(F.col("__id").alias("doc_id"), "text", *names)
    # One row a doc_id, so that the bound holds however often one repeats.
    texts = texts.groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    texts = texts.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    # A table of the sample: documents are read once, and a few tasks count the features.
    texts = table(texts.repartition(SAMPLE_PARTS), "sample").coalesce(SAMPLE_PARTS)
    count = len(categories)
    cols = [f"c{i}" for i in range(1 + 2 * count)]
    by_fold = batched(texts, partial(_count, categories=count), "fold int, feature long, " + ", ".join(f"{c} long" for c in cols))
    without = lambda c, f: F.sum(F.when(F.col("fold") != f, c).otherwise(0))  # noqa: E731  (FOLDS: all)
    counted = table(by_fold.groupBy("feature").agg(*(without(F.col(c), f).alias(f"{c}_{f}") for f in range(FOLDS + 1) for c in cols)).where(f"c0_{FOLDS} >= 4"), "counts")
    totals = texts.agg(*(without(F.when(F.col(n).isNotNull(), 1).otherwise(0), f).alias(f"n{i}_{f}") for f in range(FOLDS + 1) for i, n in enumerate(names)), *(without(F.coalesce(n, F.lit(0)), f).alias(f"p{i}_{f}") for f in range(FOLDS + 1) for i, n in enumerate(names))).first()
    best = []
    for f in range(FOLDS + 1):
        for i in range(count):
            n, p = float(totals[f"n{i}_{f}"] or 0), float(totals[f"p{i}_{f}"] or 0)
            if not 0 < p < n:
                continue
            with_, one = F.col(f"c{1 + 2 * i}_{f}"), F.col(f"c{2 + 2 * i}_{f}")
            cross = one * F.lit(n) - with_ * F.lit(p)
            chi = cross * cross / (with_ * (F.lit(n) - with_) * F.lit(p * (n - p)))
            best.append(counted.where((with_ >= 4) & (with_ < n)).orderBy(F.desc(chi), "feature").limit(CHOSEN).select(F.lit(f).alias("fold"), "feature"))
    picked: list[set[int]] = [set() for _ in range(FOLDS + 1)]
    if best:
        for f, feature in reduce(DataFrame.unionAll, best).collect():  # CHOSEN rows a fold and category
            picked[f].add(feature)
    features = np.array(sorted(set().union(*picked)), np.int64)
    chosen = [np.isin(features, sorted(x)) for x in picked]
    got = batched(texts, partial(_sample, features=features, names=["doc_id", "fold", *names]), "doc_id long, fold int, " + "".join(f"{n} int, " for n in names) + "bits binary").toPandas()
    got = got.sort_values(["doc_id"]).reset_index(drop=True)
    if not len(got):
        return fit_chain(features, np.zeros((0, len(features)), np.float32), np.zeros((0, count), np.int64))
    x = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1), axis=1)[:, : len(features)]
    return fit_chain(features, x.astype(np.float32), got[names].fillna(-1).to_numpy().astype(np.int64), got["fold"].to_numpy(), chosen)


def _scores(batches: Iterator[pa.RecordBatch], chain: Chain, names: list[str]) -> Iterator[pa.RecordBatch]:
    place = _place(chain.features)
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            p = chain.predict(_vectors(part["text"], place, len(chain.features)))
            rest = [i for i, n in enumerate(part.schema.names) if n not in names]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *(pa.array(c) for c in p.T)], names=[*(part.schema.names[i] for i in rest), *names])


def score(docs: DataFrame, chain: Chain, names: list[str]) -> DataFrame:
    """docs with a probability p_<category> a category (columns of these names are replaced)."""
    cols = [f"p_{n}" for n in names]
    docs = docs.drop(*cols)
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} double" for c in cols)])
    return batched(docs, partial(_scores, chain=chain, names=cols), shape)


def categories() -> dict[str, Column]:
    """What the labels table tells: unreadable text, and toxic text, which the chain predicts with that in mind."""
    return {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}


def screened(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, rows: int = 8000) -> DataFrame:
    """docs with p_junk, p_toxic and toxic, the decision at the threshold."""
    kinds = categories()
    chain = train(docs, labels, kinds, rows=rows)
    return score(docs.drop("toxic"), chain, list(kinds)).withColumn("toxic", F.col("p_toxic") >= threshold)


def clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that the chain doesn't reject, with the columns of docs."""
    own = (*(f"p_{k}" for k in categories()), "toxic")
    return beside(docs, ("doc_id", "text"), own, lambda x: screened(x, labels, **how).where(~F.col("toxic")))
