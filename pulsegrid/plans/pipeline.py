"""Compositions: the cleaning of one signal and the feature job with its ablations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import aggregates, features, filters, interpolate, ml, normalize

GROUPS = ("deltas", "entropy", "other", "correlation")
#: Signals in the order of their features, and the score that stands last in a row.
SIGNALS, SCORE = ("HR", "RESP", "ABPMean", "ABPSys", "ABPDias", "SpO2"), "SOFA_SCORE"
#: Seconds of a slice, so that a label's running sums are dealt to many tasks.
SLICE = 7 * 86_400


def process_signal(
    points: DataFrame, size: str, slide: str, steps: int, *, normalization: bool = True, interpolation: bool = True, outliers: bool = True, keys: tuple[str, ...] = ("label",), slice_seconds: int | None = SLICE
) -> DataFrame:
    """Missing values out, one interpolated point a window, online z-score, outlier band; the value becomes z.

    Each step can be left out; without normalization there is no band either. The result is again a table of points:
    label, ts (the interpolated time), seq, value, win_start.
    """
    out = filters.present(points)
    if interpolation:
        out = interpolate.interpolate(out, size, slide, steps, "linear", keys).withColumn("seq", F.unix_micros("win_start")).withColumnRenamed("t", "ts")
    else:
        out = out.withColumn("win_start", F.col("ts"))
    if normalization:
        out = normalize.zscore_band(out, 3.0, keys, slice_seconds=slice_seconds) if outliers else normalize.online_zscore(out, keys, slice_seconds).withColumn("value", F.col("z"))
    return out.select(*keys, "win_start", "ts", "seq", "value")


def process_score(points: DataFrame, size: str, slide: str, steps: int, label: str = SCORE) -> DataFrame:
    """The cleaned score signal: missing values out, one interpolated point a window, the value as it is."""
    return process_signal(filters.only(points, label), size, slide, steps, normalization=False)


def self_correlation(points: DataFrame, label: str, size: str, slide: str, width: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """A signal's correlation with itself (a check of the place-wise pairing), and the deviation of what lies in its band."""
    inside = normalize.zscore_band(filters.only(points, label), width, rewrite=False, slice_seconds=SLICE)
    return features.correlation(points, size, [(label, label)], slide), aggregates.window_stats(inside, size, slide).select("label", "win_start", "stdev_v")


def feature_names(labels: tuple[str, ...], without: str = "none", score: str | None = SCORE) -> list[str]:
    """The features of a row in their order: 58 of six signals and the score."""
    groups = {
        "correlation": [f"Corr{a}{b}" for i, a in enumerate(labels) for b in labels[i + 1 :]], "entropy": [f"Entropy{x}" for x in labels],
        "other": [f"{k}{x}" for x in labels for k in ("stdev", "mean", "min", "max")], "deltas": [f"{k}{x}" for x in labels for k in ("delta", "deltadelta")],
    }
    return [n for g, names in groups.items() if g != without for n in names] + ([score] if score else [])


def generate_features(
    points: DataFrame, labels: tuple[str, ...], without: str = "none", *, score: str | None = SCORE, size: str = "1440 minutes", window: str = "360 minutes", slide: str = "60 minutes", steps: int = 360, r: float = 0.2, tau: int = 1, m_max: int = 2
) -> DataFrame:
    """Feature rows per window of `size`: correlations, entropies, stdev/mean/min/max, differences and differences of
    these, and the score; only complete rows.

    without: one group of features, or one cleaning step (normalization, interpolation, outliers), left out. Signals are
    cleaned in windows of `window` each `slide`; r, tau and m_max steer the entropy (its finest scale and length count).
    """
    flags = {k: without != k for k in ("normalization", "interpolation", "outliers")}
    clean = process_signal(filters.only(points, *labels), window, slide, steps, **flags)
    at = F.window("ts", size)["start"]
    last = lambda d: d.groupBy("label", at.alias("win_start")).agg(F.max_by("value", F.struct("ts", "seq")).alias("value")).select("win_start", "label", "value")
    parts = []
    if without != "correlation":
        pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
        parts.append(features.correlation(clean, size, pairs).select("win_start", "label", "value"))
    if without != "entropy":
        e = features.entropy(clean, size, r=r, tau=tau, m_max=m_max).where("scale = 0 and m = 0")
        parts.append(e.select("win_start", F.concat(F.lit("Entropy"), "label").alias("label"), "value"))
    if without != "other":
        kinds = ("stdev", "mean", "min", "max")
        stats = aggregates.window_stats(clean, size)
        parts.append(stats.select("win_start", F.explode(F.array(*(F.struct(F.concat(F.lit(k), "label").alias("label"), F.col(f"{k}_v").alias("value")) for k in kinds))).alias("f")).select("win_start", "f.label", "f.value"))
    if without != "deltas":
        parts += [last(f(clean, window, slide)) for f in (features.delta, features.delta_delta)]
    if score:
        parts.append(last(process_score(points, window, slide, steps, score)))
    names = feature_names(labels, without, score)
    return features.feature_rows(filters.defined(reduce(DataFrame.unionByName, parts)), names, "win_start").select("win_start", *names)


def integrated(rows: DataFrame, names: list[str], model: ml.BiLSTM, size: str, slide: str, ts: str = "win_start", key: Column | None = None) -> DataFrame:
    """Scores of feature rows: windows of rows, in order of time, are the sequences of the recurrent model.

    Rows are those of generate_features(); the model takes all features but the first. Key is the row's year, as files
    without an id have it. Returns key, start, stop, n, p0, p1, label.
    """
    values = F.array(*(F.col(n).cast("double") for n in names[1:]))
    w = rows.select((F.year(ts) if key is None else key).alias("key"), F.col(ts).alias("ts"), values.alias("v"), F.window(ts, size, slide).alias("w"))
    seq = w.groupBy("key", "w").agg(F.array_sort(F.collect_list(F.struct("ts", "v"))).alias("s"))
    seq = seq.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), F.size("s").alias("n"), F.transform("s", lambda x: x["v"]).alias("x"))
    return ml.lstm_score(seq, "x", model).select("key", "start", "stop", "n", "p0", "p1", F.col("lstm_label").alias("label"))
