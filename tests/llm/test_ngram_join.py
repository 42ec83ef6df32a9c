import random
import re
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import ngram_join as J
from pulsegrid.llm import shared
from pulsegrid.llm.ngram_join import dedupe, ngram_join


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(rows, k, num, den):
    sets = sets_of(rows, k)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = now = [r.choice(words) for _ in range(r.choice([3, 12, 40, 120]))]
        for _ in range(r.choice([2, 6, 20])):
            t = list(now if r.random() < 0.5 else base)
            for _ in range(r.randint(0, max(1, len(t) // 30))):
                i = r.randrange(len(t))
                if r.random() < 0.6:
                    t[i] = r.choice(words)
                else:
                    t.insert(i, r.choice(words))
            now = t
            texts.append(" ".join(t).title() if r.random() < 0.2 else " ".join(t))
    line = " ".join(r.choice(words) for _ in range(20))
    texts += [f"{line} {' '.join(r.choice(words) for _ in range(r.choice([4, 15, 40])))}" for _ in range(40)]
    r.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_components_are_those_of_all_pairs(spark, seed, k, num):
    rows = corpus(seed)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=k, num=num, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k, num, 100)


def test_large_groups_are_dealt_to_blocks(spark, monkeypatch):
    """Members of a hub, and of an n-gram outside of it, in small blocks: the same components."""
    for name, n in (("MEET", 3), ("MEMBERS", 4), ("DEAL", 2)):
        monkeypatch.setattr(J, name, n)
    rows = corpus(4)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=2, num=70, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 70, 100)


def test_each_two_members_meet_once(spark, monkeypatch):
    monkeypatch.setattr(J, "MEET", 5)
    rows = [("s", i, i % 7, 1, 10, 5, 1) for i in range(40)] + [("t", i, 3, 1, 10, 5, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "sig string, node long, comp long, hub long, n_node long, common long, least long").withColumn("sig", F.xxhash64("sig"))
    met = J._meetings(df)
    assert met.groupBy("meet").count().agg(F.max("count")).first()[0] < 25
    pairs = J.batched(met.repartition("meet").sortWithinPartitions("meet", "comp"), partial(J._across, num=8, den=10), "via long, hub long, node long, asked long")
    got = sorted((r.hub, r.node) for r in pairs.collect())
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 7 != b % 7]


def test_repeated_rows_count_once(spark):
    """A pair a little under the threshold stays apart, however often its rows are repeated."""
    base = [f"w{i}" for i in range(60)]
    other = base[:40] + [f"x{i}" for i in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (2, " ".join(other)), (1, " ".join(base)), (2, " ".join(other))]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=1, num=6, den=10).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2)}


def test_awkward_rows(awkward, nothing):
    got = ngram_join(awkward, n=3, num=9, den=10).collect()
    assert len(got) == awkward.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got if r.doc_id is not None}
    assert by[(1, 0)] == 1 and by[(2, 0)] == 2 and by[(3, 0)] == 3
    assert {v for (i, _), v in by.items() if i in (4, 5)} == {4}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join(nothing).count() == 0


def test_dedupe_keeps_columns_and_first_ids(awkward, nothing):
    kept = dedupe(awkward, n=3, num=9, den=10)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and ids.count(4) == 2 and ids.count(None) == 2
    assert dedupe(nothing).count() == 0


def test_links_are_named_as_those_found(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(3)], "doc_id long, text string")
    got = ngram_join(docs, n=3, num=9, den=10)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links_found"]
    assert all(r.component_id == 0 and 1 <= r.n_links_found <= 2 for r in got.collect())


def test_what_is_done_with_leaves_the_disk(spark, tmp_path):
    """Shuffle files go with their query, signatures when they have met; a signature shuffle has a part of them."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.rsplit("/", 1)[-1] for x in disk.getAllFiles().mkString("\n").split("\n")}
    tables = lambda: {path for _, path in shared._written}
    before, held, seen = files(), tables(), []

    def noted(df, name):
        out = shared.table(df, name)
        until = time.time() + 5
        while (left := {x for x in files() - before if x.startswith("shuffle_")}) and time.time() < until:
            time.sleep(0.2)
        seen.append((name, len(left), out))
        return out

    rows = corpus(1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(J, "table", noted)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=9, den=10).collect()}
    assert got == brute(rows, 3, 9, 10)
    assert not [x for x in seen if x[1]]
    assert len([x for x in seen if x[0] == "buckets"]) == J.PASSES > 1
    left = [spark.read.option("recursiveFileLookup", "true").parquet(path) for path in tables() - held]
    assert left and not [c for df in left for c, kind in df.dtypes if "sig" in c or kind == "array<int>"]
