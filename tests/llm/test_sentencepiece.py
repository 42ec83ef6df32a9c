import hashlib
import random

import numpy as np
import pytest

from pulsegrid.llm import queries
from pulsegrid.llm import sentencepiece_codec as S

TEXTS = ["Hello world", "  two  spaces ", "naïve café 日本語 😀", "line\nbreak\ttab", "▁mark", "a", " ", "éèê" * 40, "x" * 300, "the quick brown fox"]


@pytest.fixture(scope="module")
def codec():
    with open(S.MODEL, "rb") as f:
        return S.Codec(f.read())


def slow(codec, text):
    """Best sum of scores over all cuts, by dynamic programming over a dictionary of pieces."""
    pieces = {t: s for t, s, k in codec.pieces if k in (S.NORMAL, S.USER)}
    best = [0.0] + [-1e300] * len(text)
    for e in range(1, len(text) + 1):
        for b in range(max(0, e - 40), e):
            score = pieces.get(text[b:e], codec.miss if e - b == 1 else None)
            if score is not None:
                best[e] = max(best[e], best[b] + score)
    return best[-1]


def value(codec, ids, text):
    units, at, ids = 0.0, 0, list(ids)
    while ids:
        t, s, k = codec.pieces[ids[0]]
        if k == S.BYTE:
            n = len(text[at].encode())
            units, at, ids = units + codec.miss, at + 1, ids[n:]
        else:
            units, at, ids = units + s, at + len(t), ids[1:]
    return units


def test_best_segmentation(codec):
    r = random.Random(0)
    more = ["".join(r.choice("abcdeé ▁\nthing") for _ in range(60)) for _ in range(40)]
    for t in TEXTS + more:
        marked = S.MARK + t.replace(" ", S.MARK)
        ids = np.frombuffer(codec.encode_bytes(t), "<i4").tolist()
        assert abs(value(codec, ids, marked) - slow(codec, marked)) < 1e-6 * max(1, abs(slow(codec, marked)))


def test_library_finds_nothing_better(codec):
    """The public library on the same pieces, told to segment by score."""
    import sentencepiece

    with open(S.MODEL, "rb") as f:
        data = bytearray(f.read())
    raw = bytes(data)
    spec = next(body for number, body in S._fields(raw) if number == 2)
    at = raw.index(spec)
    pos = spec.index(b"\x18\x02")  # field 3, the kind of model: 2 stands for merges, 1 for scores
    data[at + pos + 1] = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=bytes(data))
    for t in TEXTS:
        if S.MARK in t:
            continue
        marked = S.MARK + t.replace(" ", S.MARK)
        mine = np.frombuffer(codec.encode_bytes(t), "<i4").tolist()
        assert value(codec, mine, marked) >= value(codec, lib.encode(t), marked) - 1e-6


def test_round_trip(codec):
    for t in TEXTS:
        if S.MARK not in t:
            assert codec.decode(np.frombuffer(codec.encode_bytes(t), "<i4")) == t


def test_cache_does_not_matter(codec, monkeypatch):
    monkeypatch.setattr(S, "CACHE", 2)
    assert [codec.encode_bytes(t) for t in TEXTS * 2] == [codec.encode_bytes(t) for t in TEXTS] * 2


def test_tables(awkward, nothing):
    got = S.encode(awkward)
    rows = got.collect()
    assert len(rows) == awkward.count() and all(r.round_trip for r in rows if r.ids is not None)
    assert sum(r.ids is None for r in rows) == 2 and all(r.n_tokens == len(r.ids) for r in rows if r.ids is not None)
    back = sorted(str((r.doc_id, r.text)) for r in S.decode(got).collect())
    assert back == sorted(str((r.doc_id, r.text)) for r in awkward.collect())
    assert S.encode(nothing).count() == 0 and S.decode(S.encode(nothing)).count() == 0


def test_the_query_against_plain_code(spark, codec, tmp_path):
    texts = [None, "", *(t for t in TEXTS if S.MARK not in t), "x\x00y", "e\u0301"]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op6_sentencepiece"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "n_bytes_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean", "ids": "array<int>"}
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        if t is None:
            assert r[1:] == (None,) * 6
            continue
        marked = S.MARK + t.replace(" ", S.MARK) if t else ""
        assert abs(value(codec, r.ids, marked) - slow(codec, marked)) < 1e-6 * max(1, abs(slow(codec, marked)))
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
        assert (r.n_tokens, r.n_bytes_tokens) == (len(r.ids), sum(codec.pieces[j][2] == S.BYTE for j in r.ids))
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
