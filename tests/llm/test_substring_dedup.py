import hashlib
import random
import re
from collections import Counter

import pytest

from pulsegrid.llm import substring_dedup as S


def brute(rows, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passages = [[r.choice(words) for _ in range(r.choice([9, 10, 12, 30]))] for _ in range(6)]
    rows = []
    for i in range(60):
        t = []
        for _ in range(r.choice([0, 1, 3, 6])):
            t += r.choice(passages) if r.random() < 0.4 else [r.choice(words) for _ in range(r.choice([2, 8, 25]))]
        rows.append((i, " ".join(t)))
    rows += [(100 + i, rows[5][1]) for i in range(4)] + [(200, "x " * 80), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize(("seed", "length", "merge"), [(1, 10, 400_000), (2, 10, 50), (3, 7, 7), (4, 1, 400_000)])
def test_words_removed_are_those_of_all_windows(spark, seed, length, merge, monkeypatch):
    monkeypatch.setattr(S, "MERGE", merge)
    rows = corpus(seed)
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=length, texts=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, length)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = S.substring_dedup(awkward, length=35).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(rows, 35)
    assert S.substring_dedup(nothing).count() == 0
