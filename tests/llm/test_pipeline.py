import hashlib
import math
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from pulsegrid.llm import mixing, pii, queries, sentencepiece_codec, shared, toxicity
from pulsegrid.llm.shared import table

sys.path.insert(0, str(Path(__file__).parent))
from test_ngram_join import brute  # noqa: E402
from test_pii import brute as plain_spans  # noqa: E402


def test_entries():
    names = set(__spark_entry__.queries())
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = table(f(spark, docs, small), name)
        out.append((name, docs, after))
        docs = after
    return out


def plain_toxic(spark, a, small):
    """Ids that the chain rejects, its features looked up and its models run row by row."""
    chain = toxicity.train(a, spark.read.parquet(f"{small}/labels.parquet"), toxicity.categories())
    out = set()
    for r in a.collect():
        found = {int(b) for _, _, buckets in toxicity._features(pa.array([r.text], pa.string())) for b in buckets}
        known = [1.0 if int(f) in found else 0.0 for f in chain.features]
        for w in chain.weights:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(x * y for x, y in zip(w, known)) + w[-1]))))
            known.append(math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4))))
        if p >= 0.5:
            out.add(r.doc_id)
    return out


def plain_mix(rows):
    """Ids that are drawn: words, topics, cells, raking with what cells can give, and the hash, in plain Python."""
    cell, words = {}, {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        votes = [0, 0, 0]
        for x in set(w):
            digit = int(hashlib.md5(x.encode()).hexdigest()[0], 16)
            if digit < 15:
                votes[int(mixing.CENTROIDS[digit])] += 1
        cell[r.doc_id], words[r.doc_id] = (r.source or "", r.lang or "", str(votes.index(max(votes)))), len(w)
    total = {}
    for i, c in cell.items():
        total[c] = total.get(c, 0) + words[i]
    total = {c: n for c, n in total.items() if n}
    whole, rate, goal = sum(total.values()), queries.RATE, []
    for d, dim in enumerate(("source", "lang", "topic")):
        values = sorted({c[d] for c in total})
        stated = queries.TARGETS.get(dim, {})
        share = {v: stated.get(v, 1 / len(stated)) if stated else 1.0 for v in values}
        t = {v: share[v] / sum(share.values()) for v in values}
        rate = min([rate, *(sum(n for c, n in total.items() if c[d] == v) / t[v] / whole for v in values)])
        goal.append(t)
    for level in range(mixing.LEVELS):
        at = rate * (mixing.LEVELS - level) / mixing.LEVELS
        fit = {c: n * at for c, n in total.items()}
        for _ in range(queries.ROUNDS):
            for d in range(3):
                s = {}
                for c, f in fit.items():
                    s[c[d]] = s.get(c[d], 0) + f
                fit = {c: min(total[c], f * goal[d][c[d]] * at * whole / s[c[d]]) for c, f in fit.items()}
        off = max(abs(sum(f for c, f in fit.items() if c[d] == v) / sum(fit.values()) - g) for d in range(3) for v, g in goal[d].items())
        if off < mixing.TOLERANCE:
            break
    rate = at
    p = {i: fit[c] / total[c] if c in total else rate for i, c in cell.items()}
    return {i for i in p if int(hashlib.md5(f"{queries.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32 < p[i]}


def test_stages_against_plain_code(spark, small, stages):
    columns = spark.read.parquet(f"{small}/documents.parquet").columns
    for name, _, after in stages[:-1]:
        assert after.columns == columns, name
    by = {n: (a, b) for n, a, b in stages}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    a, b = by["toxicity"]
    gone = plain_toxic(spark, a, small)
    assert gone and ids(b) == ids(a) - gone
    a, b = by["near_duplicates"]
    assert ids(b) == {i for i, (_, c) in brute([(r.doc_id, r.text) for r in a.collect()], 5, 80, 100).items() if i == c}
    a, b = by["pii"]
    was = {r.doc_id: r.text for r in a.collect()}
    assert ids(a) == ids(b)
    for r in b.collect():
        base, added = pii.detect(was[r.doc_id])
        assert base == plain_spans(was[r.doc_id]) and r.text == pii.redacted(was[r.doc_id], base + added) and r.n_chars == len(r.text)
    a, b = by["mixing"]
    assert ids(b) == plain_mix(a.collect())
    a, b = by["sentencepiece"]
    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    was = {r.doc_id: r.text for r in a.collect()}
    rows = b.collect()
    assert ids(a) == ids(b) and len(rows) == a.count()
    for r in rows:
        assert r.round_trip and codec.decode(np.array(r.ids)) == was[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()


def test_run_is_the_stages(spark, small, stages):
    before = set(shared._written)
    got = corpus_pipeline.run(spark, small)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[-1][2].collect())
    assert len(set(shared._written) - before) == 1  # the last stage's rows; all else went


def test_awkward_rows_and_an_empty_table(spark, awkward, nothing, labels, tmp_path):
    for name, df, known in (("a", awkward, labels), ("b", nothing, labels), ("c", awkward, labels.where("false"))):
        folder = str(tmp_path / name)
        known.write.parquet(f"{folder}/labels.parquet")
        docs, kept = df, {}
        for stage, f in corpus_pipeline.STAGES:
            after = table(f(spark, docs, folder), stage)
            if stage != "sentencepiece":
                assert after.columns == df.columns, stage
            assert after.count() <= docs.count()
            docs = after
            kept[stage] = docs.count()
        assert (kept["pii"] > 0) == (name != "b")


@pytest.mark.parametrize("name", ["op2_ngram_join", "op3_substring_dedup", "op5_topk_search", "op10_mixing"])
def test_same_rows_as_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, small)
    order = sorted(got.columns)
    theirs = c.execute(__spark_entry__.oracle_sql()[name])
    at = [[d[0] for d in theirs.description].index(n) for n in order]
    assert sorted(str(tuple(r[n] for n in order)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())
