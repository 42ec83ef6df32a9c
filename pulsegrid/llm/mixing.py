"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are counted in words; the words of each cell (source, language, topic) are the start. Each round rakes the
cells to the source, the language and the topic marginal in turn. A cell can't give more words than it has: what is over
is cut off, and the next steps of raking put it on the other cells, until the marginals hold. A cell's fitted words over
its words are the probability of each of its documents, and a hash of doc_id and a seed decides.

The rate is the share of all words that is drawn at most. Where a marginal value has fewer words than its target asks for
at this rate, no choice of probabilities could reach the targets, so the rate is lowered to what the scarcest value has.
Cells can be so empty that the marginals can't be met together even so: LEVELS rates, down to a LEVELS-th, are raked side
by side, and the highest at which all marginals hold within TOLERANCE counts (without one, the lowest). residual() tells
how far the expected mixture is off.

The topic of a document is the seeded centroid that most of its distinct words are nearest to: words are hashed to
BUCKETS terms and each term belongs to the centroid that has it.

Cells are raked by window functions over each marginal, dealt to tasks by its values; documents meet their cell's
probability in a join, which Spark broadcasts where the cells are small and splits at the hot source where they aren't.

Defined results: null source, lang or text count as ''. A document without words has the topic 0 and weighs nothing; it
is drawn with its cell's probability (cells that weigh nothing have the rate). A marginal value without a target has an
even share; targets are rescaled to sum to 1 over the values that are there. Equal rows have equal fate, and so have
rows of one doc_id in one cell. mix() replaces columns of the names it gives; sampled() leaves all as they are. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import beside, free, table

WORD = r"[^\x20\x09-\x0D]+"
DIMS = ("m_source", "m_lang", "m_topic")
LEVELS, TOLERANCE = 10, 0.001
#: Hex digits that words are hashed to, and the centroid each belongs to: as many for each, and one for none.
BUCKETS, CENTROIDS, TOPICS = "0123456789abcdef", "012021102012102", 3


def celled(docs: DataFrame) -> DataFrame:
    """docs with m_words, m_source, m_lang, m_topic; needs text, lang, source. One scan of the text, in the JVM."""
    x = docs.withColumn("__w", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0))
    terms = F.transform(F.array_distinct("__w"), lambda w: F.substring(F.md5(w.cast("binary")), 1, 1))
    x = x.withColumns({"m_words": F.size("__w").cast("long"), "__t": F.translate(F.array_join(terms, ""), BUCKETS, CENTROIDS)})
    each = [F.length("__t") - F.length(F.replace("__t", F.lit(str(i)), F.lit(""))) for i in range(TOPICS)]
    topic = F.coalesce(*[F.when(c == F.greatest(*each), F.lit(str(i))) for i, c in enumerate(each)])
    return x.withColumns({"m_source": F.coalesce("source", F.lit("")), "m_lang": F.coalesce("lang", F.lit("")), "m_topic": topic}).drop("__w", "__t")


def _share(dim: str, targets: Mapping[str, Mapping[str, float]]) -> Column:
    stated = targets.get(dim.removeprefix("m_"), {})
    if not stated:
        return F.lit(1.0)
    listed = F.create_map(*[F.lit(v) for kv in stated.items() for v in (kv[0], float(kv[1]))])
    return F.coalesce(F.try_element_at(listed, F.col(dim)), F.lit(1.0 / len(stated)))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], rate: float, rounds: int) -> tuple[DataFrame, float]:
    """(cells (three dims, m_total) with m_fit, the words to draw of each; the rate that was possible)."""
    x = cells.where("m_total > 0")
    total = x.agg(F.sum("m_total")).first()[0]
    if not total:
        return x.withColumn("m_fit", F.lit(0.0)), rate
    for dim in DIMS:
        share = _share(dim, targets)
        whole, scarcest = x.groupBy(dim).agg(F.sum("m_total").alias("a"), F.any_value(share).alias("s")).agg(F.sum("s"), F.min(F.col("a") / F.col("s"))).first()
        x = x.withColumn(f"t_{dim}", share / F.lit(whole))
        rate = min(rate, whole * scarcest / total)
    x = x.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("rate", F.lit(rate) * (LEVELS - F.col("level")) / F.lit(LEVELS))
    x, held = x.withColumn("m_fit", F.col("m_total") * F.col("rate")), None
    for r in range(rounds):
        for dim in DIMS:
            goal = F.col(f"t_{dim}") * F.col("rate") * F.lit(total)
            x = x.withColumn("m_fit", F.least(F.col("m_total").cast("double"), F.col("m_fit") * goal / F.sum("m_fit").over(Window.partitionBy("level", dim))))
        if r % 3 == 2 or r == rounds - 1:
            x, last = table(x, "cells"), held
            if last is not None:
                free(last)
            held = x
    off = reduce(DataFrame.unionAll, [x.groupBy("level", dim).agg(F.sum("m_fit").alias("w"), F.any_value(f"t_{dim}").alias("t")).select("level", "w", "t") for dim in DIMS])
    off = off.join(x.groupBy("level").agg(F.sum("m_fit").alias("whole")), "level").groupBy("level").agg(F.max(F.abs(F.col("w") / F.col("whole") - F.col("t"))).alias("off"))
    found = sorted((r["level"], r["off"]) for r in off.collect())  # LEVELS rows
    level = next((n for n, d in found if d < TOLERANCE), LEVELS - 1)
    return x.where(F.col("level") == level).select(*DIMS, "m_total", "m_fit"), rate * (LEVELS - level) / LEVELS


def uniform(seed: int) -> Column:
    """A number in [0, 1) that doc_id and the seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, *, targets: Mapping[str, Mapping[str, float]], rate: float = 0.5, rounds: int = 15, seed: int = 17, keep: Sequence[str] | None = None) -> DataFrame:
    """docs, or its columns `keep` (doc_id among them), with m_words, m_source, m_lang, m_topic, m_p (probability), m_kept.

    docs is read once and what is kept of it written with its cells.
    """
    own = ("m_words", *DIMS, "m_p", "m_kept")
    docs = docs.drop(*own)
    names = [F.col(f"`{n}`") for n in (docs.columns if keep is None else keep)]
    found = table(celled(docs).select(*names, "m_words", *DIMS), "celled")
    cells = table(found.groupBy(*DIMS).agg(F.sum("m_words").alias("m_total")), "totals")
    fitted, rate = rake(cells, targets, rate, rounds)
    factor = table(fitted.select(*[F.col(d).alias(f"k_{d}") for d in DIMS], (F.col("m_fit") / F.col("m_total")).alias("m_p")), "factors")
    at = [F.col(d) == F.col(f"k_{d}") for d in DIMS]
    out = found.join(factor, at[0] & at[1] & at[2], "left").drop(*[f"k_{d}" for d in DIMS])
    return out.withColumn("m_p", F.coalesce("m_p", F.lit(float(min(1.0, rate))))).withColumn("m_kept", uniform(seed) < F.col("m_p"))


def residual(mixed: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """What mix() expects to draw against what is asked for: dim, name, target, share, off; a row a marginal value."""
    drawn = mixed.where("m_words > 0").groupBy(*DIMS).agg(F.sum(F.col("m_words") * F.col("m_p")).alias("w"))
    out = []
    for dim in DIMS:
        by = drawn.groupBy(F.col(dim)).agg(F.sum("w").alias("w")).withColumn("t", _share(dim, targets))
        whole = Window.partitionBy(F.lit(0))  # a row a marginal value
        by = by.select(F.lit(dim.removeprefix("m_")).alias("dim"), F.col(dim).alias("name"), (F.col("t") / F.sum("t").over(whole)).alias("target"), (F.col("w") / F.sum("w").over(whole)).alias("share"))
        out.append(by.withColumn("off", F.abs(F.col("share") - F.col("target"))))
    return out[0].unionByName(out[1]).unionByName(out[2])


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The documents that mix() keeps, with the columns of docs."""
    own = ("m_words", *DIMS, "m_p", "m_kept")
    return beside(docs, ("doc_id", "text", "lang", "source"), own, lambda x: mix(x, **how).where("m_kept"))
