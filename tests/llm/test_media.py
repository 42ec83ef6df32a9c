import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import media, queries


def filtered(rows, kinds):
    """Rows filtered sample by sample, after the definition of the five filters."""
    out = bytearray()
    for y, kind in enumerate(kinds):
        out.append(kind)
        for i, x in enumerate(rows[y]):
            a = rows[y][i - 3] if i >= 3 else 0
            b = rows[y - 1][i] if y else 0
            c = rows[y - 1][i - 3] if y and i >= 3 else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    return bytes(out)


def test_all_filters_are_undone():
    r = np.random.default_rng(0)
    for _ in range(20):
        n = int(r.integers(1, 12))
        rows = r.integers(0, 256, (n, 12)).tolist()
        kinds = r.integers(0, 5, n).tolist()
        lines = np.frombuffer(filtered(rows, kinds), np.uint8).reshape(n, 13)
        assert media.unfilter(lines, 3).tolist() == rows


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 192, b"y" * 193, bytes(range(256)) * 50])
def test_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(data)
    rows, samples = media.read(media.write(payload))
    assert rows.tobytes() == payload and samples == 3


def test_damage_is_found():
    png = media.write(media.padded(b"some text " * 100))
    for at in (0, 20, 45, len(png) - 6):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.read(bytes(bad))
    for cut in (7, 30, len(png) - 13):
        with pytest.raises(ValueError):
            media.read(png[:cut])


def test_feature_is_alike_for_alike_pictures():
    a = np.add.outer(np.arange(40) * 3, np.arange(192)) % 256
    bits = lambda x: int(media.feature(x.astype(np.uint8), 3), 16)
    noisy = np.clip(a + np.random.default_rng(1).integers(-2, 3, a.shape), 0, 255)
    assert bin(bits(a) ^ bits(noisy)).count("1") <= 8
    assert bin(bits(a) ^ bits(a[::-1])).count("1") > 8


def test_table(awkward, nothing):
    got = media.read_media(media.text_media(awkward)).collect()
    texts = sorted((r.text or "").encode() for r in awkward.collect())
    assert sorted(bytes(g.payload[: g.n_bytes]) for g in got) == texts
    for g in got:
        assert g.payload_bytes == len(g.payload) and g.payload_sha256 == hashlib.sha256(g.payload).hexdigest()
        assert g.tail_crc32 == zlib.crc32(g.payload[-16:]) and g.error is None
    assert media.read_media(media.text_media(nothing)).count() == 0


def test_bad_rows_say_why(spark):
    png = media.write(media.padded(b"z"))
    wide = png[:16] + struct.pack(">I", 65) + png[20:]
    rows = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(wide)), (3, None)], "doc_id long, png binary")
    got = {r.doc_id: r for r in media.read_media(rows).collect()}
    assert got[1].error is None and "checksum" in got[2].error and got[3].error == "null" and got[3].payload is None


def chunks(png):
    out, at = [], 8
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        out.append([png[at + 4 : at + 8], png[at + 8 : at + 8 + n]])
        at += 12 + n
    return out


def png_of(parts):
    """A PNG of chunks, with right checksums whatever they hold."""
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


GOOD = media.write(media.padded(b"some text " * 60))


@settings(max_examples=600, deadline=None)
@given(st.integers(0, 2), st.integers(0, 200), st.integers(1, 255), st.sampled_from(["flip", "cut", "grow", "drop", "twice", "kind"]))
def test_any_damage_under_right_checksums_is_a_value_error(which, at, by, how):
    parts = chunks(GOOD)
    kind, body = parts[which]
    if how == "flip" and body:
        at %= len(body)
        parts[which][1] = body[:at] + bytes([body[at] ^ by]) + body[at + 1 :]
    elif how == "cut":
        parts[which][1] = body[: at % (len(body) + 1)]
    elif how == "grow":
        parts[which][1] = body + bytes([by]) * (1 + at)
    elif how == "drop":
        del parts[which]
    elif how == "twice":
        parts.insert(which, parts[which])
    else:
        parts[which][0] = bytes([kind[0] ^ (by & 0x5F), *kind[1:]])
    try:
        rows, _ = media.read(png_of(parts))
        assert rows.size <= media.LIMIT
    except ValueError:
        pass


@settings(max_examples=300, deadline=None)
@given(st.integers(8, len(GOOD) - 1), st.integers(1, 255))
def test_any_flipped_byte_is_found(at, by):
    bad = GOOD[:at] + bytes([GOOD[at] ^ by]) + GOOD[at + 1 :]
    with pytest.raises(ValueError):
        media.read(bad)


def test_little_bytes_that_inflate_to_much():
    head = struct.pack(">IIBBBBB", 64, 1, 8, 2, 0, 0, 0)
    deflate = zlib.compressobj(9)
    bomb = b"".join([*(deflate.compress(bytes(1 << 20)) for _ in range(64)), deflate.flush()])
    with pytest.raises(ValueError, match="length of the rows"):
        media.read(png_of([(b"IHDR", head), (b"IDAT", bomb), (b"IEND", b"")]))
    huge = struct.pack(">IIBBBBB", 2**31 - 1, 2**31 - 1, 8, 2, 0, 0, 0)
    with pytest.raises(ValueError, match="size of the image"):
        media.read(png_of([(b"IHDR", huge), (b"IDAT", bomb), (b"IEND", b"")]))


def test_split_data_and_chunks_to_pass_over():
    (ihdr, head), (idat, body), end = chunks(GOOD)
    rows, _ = media.read(png_of([(ihdr, head), (b"tEXt", b"a"), (idat, body[:9]), (idat, body[9:]), end]))
    assert rows.tobytes() == media.read(GOOD)[0].tobytes()


def slow_feature(rows):
    """Mean grey of each of 32 x 32 fields, cosine sums one by one, bits over the median."""
    height, width = len(rows), len(rows[0]) // 3
    grey = [[sum(r[3 * x : 3 * x + 3]) for x in range(width)] for r in rows]
    edge = lambda n: [i * n // 32 for i in range(33)]
    ys, xs = edge(height), edge(width)
    field = lambda y, x: [grey[b][a] for b in range(ys[y], max(ys[y] + 1, ys[y + 1])) for a in range(xs[x], max(xs[x] + 1, xs[x + 1]))]
    small = [[sum(f := field(y, x)) / len(f) for x in range(32)] for y in range(32)]
    c = [[math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = [round(sum(small[y][x] * c[v][y] * c[u][x] for y in range(32) for x in range(32)), 3) for v in range(8) for u in range(8)][1:]
    middle = sorted(low)[31]
    return "%016x" % int("0" + "".join("1" if x > middle else "0" for x in low), 2)


def test_the_query_against_plain_code(spark, tmp_path):
    texts = [None, "", "a", "é" * 96, "word " * 50, "The quick brown fox jumps over the lazy dog. " * 200, "x" * 192 * 33, "word " * 50]
    spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, png string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op4_media"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        full = data + b" " * ((-len(data)) % 192 or (0 if data else 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        (_, head), (_, body), _ = chunks(media.write(full))
        lines = zlib.decompress(body)
        plain = [list(full[k : k + 192]) for k in range(0, len(full), 192)]
        assert struct.unpack(">IIBBBBB", head) == (64, len(plain), 8, 2, 0, 0, 0)
        kinds = [lines[193 * k] for k in range(len(plain))]
        assert lines == filtered(plain, kinds)  # the stored form is the payload, filtered by the definition
        again = png_of([(b"IHDR", head), (b"IDAT", body), (b"IEND", b"")])
        assert (r.media_bytes, r.media_sha256) == (len(again), hashlib.sha256(again).hexdigest())
        assert r.feature == slow_feature(plain), i
    assert rows[4][1:] == rows[7][1:]
