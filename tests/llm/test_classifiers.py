import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import quality, queries, toxicity


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(5)
    good, junk, rude = [f"word{i}" for i in range(80)], [f"zz{i}%%" for i in range(80)], ["scumbag", "wretch"]
    docs, labels = [], []
    for i in range(600):
        bad, toxic = r.random() < 0.3, r.random() < 0.25
        t = list(r.choice(junk if bad else good, 40))
        if toxic:
            t[int(r.integers(40))] = str(r.choice(rude))
        docs.append((i, " ".join(t), "k"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, label string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_texts_are_caught_and_clean_ones_kept(made):
    docs, labels = made
    got = toxicity.screened(docs, labels, rows=300).join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert sum((r.toxic) == (r.y == 1) for r in got) >= 0.99 * len(got)
    assert all(0 <= r.p_junk <= 1 for r in got) and sum((r.p_junk > 0.5) == (r.quality == 0) for r in got) > 0.95 * len(got)


def test_later_models_see_earlier_probabilities():
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (400, 3)).astype(np.float32)
    a = (x[:, 0] > 0).astype(int)
    b = (x[:, 0] > 0).astype(int)
    chain = toxicity.fit_chain(np.arange(3), x, np.stack([a, b], 1))
    assert len(chain.weights[0]) == 4 and len(chain.weights[1]) == 5 and chain.weights[1][3] > 0.1
    p = chain.predict(x)
    assert ((p > 0.5) == np.stack([a, b], 1)).all()


def test_out_of_fold():
    """With labels that are pure chance, what the second model sees of the first must not give the labels away."""
    r = np.random.default_rng(2)
    x = r.integers(0, 2, (200, 60)).astype(np.float32)
    y = r.integers(0, 2, 200)
    chain = toxicity.fit_chain(np.arange(60), x, np.stack([y, y], 1))
    assert abs(chain.weights[1][60]) < 2


def test_features_are_chosen_inside_of_each_fold(spark):
    """Labels that are pure chance, many rare words: out-of-fold probabilities must not know them."""
    r = np.random.default_rng(9)
    docs = [(i, " ".join(f"w{j}" for j in r.integers(0, 400, 40))) for i in range(300)]
    labels = [(i, int(y), int(y)) for i, y in enumerate(r.integers(0, 2, 300))]
    chain = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"a": F.col("quality"), "b": F.col("toxic")})
    assert len(chain.features) == len(chain.weights[0]) - 1 == len(chain.weights[1]) - 2
    assert chain.weights[1][len(chain.features)] < 0.3


def test_a_repeated_id_trains_once(spark):
    docs = [(i, "good words" if i % 2 else "scumbag words") for i in range(60)] * 1 + [(2, "scumbag words again")] * 500
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = toxicity.screened(df, labels, rows=50).collect()
    assert len(got) == len(docs) and all(r.toxic == (r.doc_id % 2 == 0) for r in got)
    assert quality.quality(df, labels, rows=50).count() == len(docs)


def test_chains_against_plain_code(spark):
    """What the executors give is the chain computed row by row from its weights and the texts' features."""
    docs = [(i, f"text number{i % 5} of all {'scumbag' if i % 3 == 0 else 'friend'}") for i in range(80)]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, labels, toxicity.categories())
    place = {int(f): j for j, f in enumerate(chain.features)}
    for row in toxicity.score(df, chain, ["junk", "toxic"]).collect():
        buckets = {int(b) for _, _, found in toxicity._features(pa.array([row.text])) for b in found}
        x = [1.0 if f in buckets else 0.0 for f in place]
        logits = []
        for w in chain.weights:
            z = sum(a * b for a, b in zip(w, [*x, *logits])) + w[-1]
            p = 1 / (1 + np.exp(-z))
            logits.append(float(toxicity.logit(np.array(p))))
            last = p
        assert abs(row.p_toxic - last) < 1e-9


def test_toxicity_awkward(awkward, nothing, labels, spark):
    for l in (labels, labels.where("false")):
        got = toxicity.screened(awkward, l).collect()
        assert len(got) == awkward.count() and all(r.toxic is not None for r in got)
    assert toxicity.screened(nothing, labels).count() == 0
    odd = awkward.withColumn("toxic", F.lit("mine"))
    assert toxicity.clean(odd, labels).columns == odd.columns


def test_quality_on_rows_held_out(made):
    docs, labels = made
    got = quality.quality(docs, labels).join(labels.withColumnRenamed("quality", "y"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.predicted == r.y for r in held) > 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_held_out_labels_are_not_learnt(made):
    docs, labels = made
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality(docs, l).collect()} for l in (labels, turned))
    assert a == b


def test_word_vectors_do_not_depend_on_partitions(made):
    docs, _ = made
    assert np.array_equal(quality.word_vectors(docs.repartition(5)), quality.word_vectors(docs.coalesce(1)))


def test_temperature_calibrates():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 4))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (r.random(4000) < p).astype(int)
    net = quality.fit(x, y)
    got = net.predict(x)
    for lo in (0.1, 0.4, 0.7):
        at = (got > lo) & (got < lo + 0.2)
        assert abs(y[at].mean() - got[at].mean()) < 0.1


def test_quality_awkward(awkward, nothing, labels):
    for l in (labels, labels.where("false")):
        got = quality.quality(awkward, l).collect()
        assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality(nothing, labels).count() == 0


def test_quality_against_plain_code(spark, made, tmp_path):
    """Word vectors, pooling and the network, word by word, through the query."""
    docs, labels = made
    docs = docs.limit(120).union(spark.sql("select 9001L, cast(null as string), 'k' union all select 9002L, '', 'k' union all select cast(null as bigint), 'word1', 'k'"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.queries()["op9_quality"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.collect()
    texts = {(r.doc_id): r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    assert sorted(map(str, texts)) == sorted(str(r.doc_id) for r in rows)
    plus, minus = quality._index()
    bucket = lambda w: int(quality._bucket(next(quality.words(pa.array([w]), lower=True)).hash)[0])
    known = {w: bucket(w) for t in texts.values() for w in (t or "").split()}
    table = np.zeros((quality.BUCKETS, quality.WIDTH))
    for t in texts.values():
        line = [known[w] for w in (t or "").split()]
        for i, b in enumerate(line):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(line):
                    table[b, plus[line[j]]] += 1
                    table[b, minus[line[j]]] -= 1
    table /= np.maximum(np.sqrt((table**2).sum(1, keepdims=True)), 1e-9)
    assert np.allclose(table, quality.word_vectors(spark.read.parquet(str(tmp_path / "documents.parquet"))), atol=1e-6)
    net = quality.train(spark.read.parquet(str(tmp_path / "documents.parquet")), labels, table.astype(np.float32))
    for r in rows:
        line = [known[w] for w in (texts[r.doc_id] or "").split()]
        x = table[line].mean(0) if line else np.zeros(quality.WIDTH)
        h = np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1)
        p = 1 / (1 + np.exp(-np.clip((h @ net.w2 + net.b2) / net.temperature, -30, 30)))
        assert abs(r.score - p) < 2e-3 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_through_the_query(spark, made, tmp_path):
    docs, labels = made
    docs.union(spark.sql("select 9001L, cast(null as string), 'k'")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.queries()["op1_toxicity"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "p_junk": "double", "p_toxic": "double", "toxic": "boolean"}
    rows = got.collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == 601 and all(r.toxic == (r.p_toxic >= 0.5) for r in rows)
    assert sum(r.toxic == (truth[r.doc_id] == 1) for r in rows if r.doc_id in truth) >= 0.99 * len(truth)
