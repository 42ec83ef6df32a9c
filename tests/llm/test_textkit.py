import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm.textkit import grouped, shingles, words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \t\n\x0b\x1f é日😀", max_size=30)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_runs_of_what_is_no_space(texts, chunk):
    column = pa.array(["zz", *texts], pa.string()).slice(1)
    seen, found = 0, {}
    for w in words(column, chunk=chunk):
        for i in range(w.rows.start, w.rows.stop):
            lo, hi = w.first[i - w.rows.start], w.first[i - w.rows.start + 1]
            mine = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[lo:hi], w.end[lo:hi], strict=True)]
            assert mine == re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
            for x, h in zip(mine, w.hash[lo:hi], strict=True):
                assert found.setdefault(x, h) == h
            seen += 1
    assert seen == len(texts) and len(set(found.values())) == len(found)


@settings(max_examples=50, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingle_counts(texts, k):
    for w in words(pa.array(texts, pa.string()), lower=True, chunk=1000):
        _, _, n = shingles(w, k)
        for i, c in enumerate(n):
            t = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in texts[w.rows.start + i] or "")
            x = re.findall(r"[^\x20\x09-\x0D]+", t)
            assert c == len({tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if len(x) >= k else {tuple(x)} if x else ())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 7), st.integers(1, 20))
def test_groups_stay_together(keys, size, hold):
    keys = sorted(keys)
    batches = [pa.record_batch({"k": pa.array(keys[i : i + size], pa.int64())}) for i in range(0, len(keys), size)]
    out, last = [], None
    for b, begins, ends in grouped(iter(batches), "k", hold):
        k = b["k"].to_pylist()
        assert begins == (last is None or k[0] != last)
        if not (begins and ends):
            assert len(set(k)) == 1
        out += k
        last = k[-1]
        if ends and begins:
            assert all(keys.count(x) == k.count(x) for x in set(k))
    assert out == keys
    assert np.all(np.diff(out) >= 0)
