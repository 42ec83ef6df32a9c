import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, queries

TARGETS = {"lang": {"en": 0.5, "de": 0.5}, "source": {"a": 0.25, "b": 0.75}}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "tiny words only " * (1 + i % 5) if i % 3 else "considerable extraordinary " * 3, "en" if i % 4 else "de", "a" if i % 10 else "b") for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_marginals(docs):
    cells = mixing.celled(docs).groupBy(*mixing.DIMS).agg(F.sum("m_words").alias("m_total"))
    fit, rate = mixing.rake(cells, TARGETS, 0.05, 40)
    assert rate == 0.05
    whole = fit.agg(F.sum("m_fit")).first()[0]
    for dim, want in (("m_lang", TARGETS["lang"]), ("m_source", TARGETS["source"])):
        got = {r[0]: r[1] / whole for r in fit.groupBy(dim).agg(F.sum("m_fit")).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-4 for k, v in want.items())
    assert abs(whole - 0.05 * cells.agg(F.sum("m_total")).first()[0]) < 1e-4 * whole


def test_the_sample_has_the_mixture(docs):
    kept = mixing.sampled(docs, targets=TARGETS, rate=0.15, rounds=20)
    assert kept.columns == docs.columns
    w = {r[0]: r[1] for r in mixing.celled(kept).groupBy("m_source").agg(F.sum("m_words")).collect()}
    full = mixing.mix(docs, targets=TARGETS, rate=0.15, rounds=20)
    want = {r[0]: r[1] for r in full.groupBy("m_source").agg(F.sum(F.col("m_words") * F.col("m_p"))).collect()}
    assert all(abs(w[k] - want[k]) < 0.15 * want[k] for k in want)


def test_topics_are_those_of_the_terms(docs):
    for r in mixing.celled(docs.union(docs.sparkSession.sql("select -1L, cast(null as string), 'en', 'a' union all select -2L, 'ein éin EIN ein', 'en', 'a'"))).dropDuplicates(["text"]).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        votes = Counter(int(mixing.CENTROIDS[d]) for w in set(words) if (d := int(hashlib.md5(w.encode()).hexdigest()[0], 16)) < 15)
        assert r.m_words == len(words) and int(r.m_topic) == max(range(3), key=lambda k: (votes[k], -k))


def test_what_a_cell_lacks_others_give(spark):
    """A cell that can't give its part is drawn whole, and the marginals hold all the same."""
    rows = [("a", "en", 1000), ("a", "de", 10), ("b", "en", 500), ("b", "de", 800)]
    cells = spark.createDataFrame([(s, la, "0", n) for s, la, n in rows], "m_source string, m_lang string, m_topic string, m_total long")
    fit, rate = mixing.rake(cells, {"lang": {"en": 0.5, "de": 0.5}}, 0.4, 200)
    got = {(r.m_source, r.m_lang): r.m_fit for r in fit.collect()}
    assert abs(rate - 0.4) < 1e-12 and abs(got["a", "de"] - 10) < 1e-6 and all(v <= n + 1e-9 for (v, n) in zip((got[s, la] for s, la, _ in rows), (n for *_, n in rows)))
    assert abs(sum(v for (s, _), v in got.items() if s == "a") - 462) < 0.5 and abs(sum(v for (_, la), v in got.items() if la == "en") - 462) < 0.5


def test_a_rate_that_no_mixture_has_is_lowered(spark):
    cells = spark.createDataFrame([("a", "en", "0", 900), ("a", "de", "0", 100)], "m_source string, m_lang string, m_topic string, m_total long")
    fit, rate = mixing.rake(cells, {"lang": {"en": 0.5, "de": 0.5}}, 0.5, 10)
    assert abs(rate - 0.2) < 1e-12 and sorted(round(r.m_fit, 6) for r in fit.collect()) == [100.0, 100.0]


def test_same_rows_as_sql(spark, awkward, tmp_path):
    awkward.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op10_mixing(spark, str(tmp_path))
    order = sorted(got.columns)
    theirs = c.execute(queries.mixing_sql())
    at = [[d[0] for d in theirs.description].index(n) for n in order]
    assert sorted(str(tuple(r[n] for n in order)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_columns_in_the_way(docs):
    odd = docs.withColumn("m_p", F.lit("mine")).withColumn("m_words", F.lit(-1))
    how = {"targets": TARGETS, "rate": 0.3}
    got = mixing.sampled(odd, **how)
    assert got.columns == odd.columns and {tuple(r) for r in got.select("m_p", "m_words").distinct().collect()} == {("mine", -1)}
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in mixing.sampled(docs, **how).collect())


def test_awkward(awkward, nothing):
    got = mixing.mix(awkward, targets={}, rate=0.5)
    assert got.count() == awkward.count() and got.where("m_p is null or m_kept is null").count() == 0
    assert mixing.mix(nothing, targets=TARGETS).count() == 0


def test_no_python_on_the_executors(docs):
    plan = mixing.mix(docs, targets=TARGETS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_targets_are_reached_on_the_tables(spark, medium):
    """With production parameters, the marginals that are expected are those that are asked for."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    mixed = mixing.mix(docs, targets=queries.TARGETS, rate=queries.RATE, rounds=queries.ROUNDS, seed=queries.SEED)
    assert mixed.where("m_p > 1").count() == 0
    assert mixing.residual(mixed, queries.TARGETS).agg(F.max("off")).first()[0] < mixing.TOLERANCE


def test_nothing_to_mix(nothing):
    assert mixing.mix(nothing, targets=TARGETS).count() == 0
    assert mixing.residual(mixing.mix(nothing, targets=TARGETS), TARGETS).count() == 0
