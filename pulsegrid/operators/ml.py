"""Sequences, scaling, folds, metrics and a recurrent scorer."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sequences(df: DataFrame, key: str, value: str, label: str, length: int, *order: str, stride: int = 1) -> DataFrame:
    """Each row's label with the `length` values before it; rows with fewer before are left out."""
    by = Window.partitionBy(key).orderBy(*order)
    out = df.withColumns({"rn": F.row_number().over(by), "seq_values": F.collect_list(value).over(by.rowsBetween(-length, -1))})
    return out.where((F.size("seq_values") == length) & ((F.col("rn") - 1) % stride == 0)).select(key, "rn", "seq_values", F.col(label).alias("target"))


def labelled(df: DataFrame, score: str, threshold: float, key: str, names: tuple[str, str] = ("shock", "Nonshock")) -> DataFrame:
    """df with label (the first name where the score is over the threshold, else the second) and a 0/1 column a name.

    A key whose rows all have one label counts as all of the second name in the 0/1 columns, whichever label it is.
    """
    yes, no = names
    hit = F.coalesce(F.col(score) > threshold, F.lit(False))
    by = Window.partitionBy(key)
    both = F.min(hit.cast("int")).over(by) != F.max(hit.cast("int")).over(by)
    return df.withColumns({"label": F.when(hit, yes).otherwise(no), yes: (hit & both).cast("int"), no: (~hit | ~both).cast("int")})


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as (x - mean) / population deviation over the table; a deviation of 0 counts as 1."""
    stats = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    # One row of statistics.
    return df.join(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


def kfold(df: DataFrame, folds: int, key: str, *order: str) -> DataFrame:
    """Contiguous folds within a key, larger ones first."""
    return df.withColumn("fold", F.ntile(folds).over(Window.partitionBy(key).orderBy(*order)))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts and the metrics made of them, as one row."""
    y, p = F.col(truth), F.col(guess)
    c = lambda a, b: F.count(F.when((y == a) & (p == b), 1))
    out = df.agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(0, 0).alias("tn"), c(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return out.select("tp", "fp", "tn", "fn", F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))


def auroc(df: DataFrame, truth: str, score: str, slices: int = 64) -> DataFrame:
    """Area under the ROC curve by ranks, ties at their mean.

    Counts per distinct score are summed first. Ranks are counted within slices of the scores, whose bounds are rough
    quantiles, and slices follow each other by their totals: no task sees more than about a slice.
    """
    by = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n"))
    cuts = df.agg(F.percentile_approx(F.col(score).cast("double"), [i / slices for i in range(1, slices)]).alias("cuts"))
    # One row of bounds and one of totals a slice.
    by = by.join(F.broadcast(cuts)).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    ahead = by.groupBy("slice").agg(F.sum("n").alias("all")).withColumn("ahead", F.coalesce(F.sum("all").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    within = Window.partitionBy("slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("below", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(ahead), "slice")
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("below") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return total.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auroc"))


class BiLSTM:
    """Forward pass of a bidirectional LSTM with a dense softmax layer, in numpy.

    weights: for each direction kernel (features x 4 units), recurrent (units x 4 units) and bias (4 units), gates in the
    order input, forget, cell, output; then dense (2 units x classes) and its bias.
    """

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = [np.asarray(w, np.float64) for w in weights]

    @classmethod
    def seeded(cls, features: int, units: int, classes: int = 2, seed: int = 0) -> BiLSTM:
        r = np.random.Generator(np.random.PCG64(seed))
        one = lambda: [r.normal(0, 0.3, (features, 4 * units)), r.normal(0, 0.3, (units, 4 * units)), np.zeros(4 * units)]
        return cls([*one(), *one(), r.normal(0, 0.3, (2 * units, classes)), np.zeros(classes)])

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BiLSTM:
        """A trained model from an .npz file in any store that Spark reads: arrays w0 to w7 in the order of `weights`."""
        content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        with np.load(io.BytesIO(content), allow_pickle=False) as f:
            return cls([f[f"w{i}"] for i in range(8)])

    def save(self, path: str) -> None:
        """The .npz file that load() reads, on the driver's disk."""
        np.savez(path, **{f"w{i}": w for i, w in enumerate(self.weights)})

    @staticmethod
    def _run(x: np.ndarray, kernel: np.ndarray, recurrent: np.ndarray, bias: np.ndarray) -> np.ndarray:
        units = recurrent.shape[0]
        h, c = np.zeros((len(x), units)), np.zeros((len(x), units))
        gate = lambda v: 1 / (1 + np.exp(-v))
        for t in range(x.shape[1]):
            z = x[:, t] @ kernel + h @ recurrent + bias
            i, f, g, o = (z[:, k * units : (k + 1) * units] for k in range(4))
            c = gate(f) * c + gate(i) * np.tanh(g)
            h = gate(o) * np.tanh(c)
        return h

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of a batch (rows x steps x features)."""
        w = self.weights
        h = np.hstack([self._run(x, *w[:3]), self._run(x[:, ::-1], *w[3:6])])
        z = h @ w[6] + w[7]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def lstm_score(df: DataFrame, sequence: str, model: BiLSTM, names: tuple[str, str] = ("shock", "Nonshock"), fix_label_order: bool = False) -> DataFrame:
    """df with p0, p1 and label. The first name stands for p0 > p1; fix_label_order puts it the other way round.

    Sequences of one batch that have equal lengths run together; the model goes to each worker once.
    """
    first, second = reversed(names) if fix_label_order else names

    @F.pandas_udf("struct<p0:double,p1:double>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xs in parts:
            rows = [np.stack([np.asarray(v, float).reshape(-1) for v in x]) for x in xs]
            out = np.full((len(rows), 2), np.nan)
            for n in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == n]
                out[at] = model.predict(np.stack([rows[i] for i in at]))
            yield pd.DataFrame({"p0": out[:, 0], "p1": out[:, 1]})

    return df.withColumn("__p", score(sequence)).withColumns({"p0": F.col("__p.p0"), "p1": F.col("__p.p1")}).withColumn("lstm_label", F.when(F.col("p0") > F.col("p1"), first).otherwise(second)).drop("__p")
