"""Media columns: PNG images in binary columns, written, read and hashed with numpy and zlib.

A payload of bytes is an image 64 pixels wide with three 8-bit samples a pixel: 192 bytes a row. Writing filters each
row by None, Sub or Up, whichever has the smallest sum of absolute differences, deflates the rows and puts them in
chunks with checksums. Reading walks the chunks, tests the signature, every checksum and the lengths, inflates and undoes
all five filters. The feature is a perceptual hash: the picture's grey values as 32 x 32, the lowest 8 x 8 cosine
coefficients, and one bit each for being above their median.

Defined results: null text counts as empty; an empty payload is padded to one row. Equal texts have equal bytes, hashes
and features. read() raises ValueError, and nothing else, on a damaged image: wrong lengths, checksums, order or kind of
chunks, and rows that inflate to more or less than the header states. It inflates no more than that, and no image of more
than LIMIT bytes (what a binary cell can hold). read_media() gives such an image, or null, the columns payload, feature
null and says why in error. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched

WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1
#: Bytes of rows in an image: no binary cell holds more.
LIMIT = 2**31 - 1


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(data: bytes) -> bytes:
    """data with bytes 32 appended up to a positive multiple of a row."""
    return data + b" " * (-len(data) % ROW if data else ROW)


def write(payload: bytes) -> bytes:
    """The PNG of a payload of whole rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    tried = np.empty((3, *rows.shape), np.uint8)
    tried[0] = rows
    tried[1, :, :SAMPLES] = rows[:, :SAMPLES]
    np.subtract(rows[:, SAMPLES:], rows[:, :-SAMPLES], out=tried[1, :, SAMPLES:])
    tried[2, 0] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=tried[2, 1:])
    best = np.minimum(tried, 0 - tried).sum(2, dtype=np.uint32).argmin(0)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = tried[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of samples from filtered rows, whose first byte names the filter (0 to 4)."""
    kind, x = lines[:, 0], lines[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise ValueError("unknown filter")
    side = np.flatnonzero(kind == 1)
    if len(side):
        x[side] = np.cumsum(x[side].reshape(len(side), -1, bpp), 1, dtype=np.uint8).reshape(len(side), -1)
    # Rows that refer to the row above, one after the other; runs of Up at once.
    ups = np.flatnonzero(kind > 1)
    at = 0
    while at < len(ups):
        i = int(ups[at])
        if kind[i] == 2:
            end = at
            while end + 1 < len(ups) and ups[end + 1] == ups[end] + 1 and kind[ups[end + 1]] == 2:
                end += 1
            lo, hi = max(i - 1, 0), int(ups[end]) + 1
            x[lo:hi] = np.cumsum(x[lo:hi], 0, dtype=np.uint8)
            at = end + 1
            continue
        above = x[i - 1].astype(np.int32) if i else np.zeros(x.shape[1], np.int32)
        line = x[i].astype(np.int32)
        for p in range(0, len(line), bpp):
            left = line[p - bpp : p] if p else np.zeros(bpp, np.int32)
            up = above[p : p + bpp]
            if kind[i] == 3:
                guess = (left + up) // 2
            else:
                corner = above[p - bpp : p] if p else np.zeros(bpp, np.int32)
                near = left + up - corner
                a, b, c = abs(near - left), abs(near - up), abs(near - corner)
                guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
            line[p : p + bpp] = (line[p : p + bpp] + guess) & 255
        x[i] = line
        at += 1
    return x


def read(png: bytes) -> tuple[np.ndarray, int]:
    """The rows of samples of an 8-bit PNG without interlacing, and samples a pixel; ValueError where it is damaged."""
    if png[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(png):
            raise ValueError("cut off in a chunk")
        (size,) = struct.unpack_from(">I", png, at)
        if at + 12 + size > len(png):
            raise ValueError("cut off in a chunk")
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("checksum of a chunk")
        if (kind == b"IHDR") != (at == 8):
            raise ValueError("header not first, or repeated")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("length of the header")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        elif kind not in (b"IEND", b"PLTE") and not kind[0] & 32:
            raise ValueError("unknown chunk that can't be passed over")
        at += 12 + size
    if at != len(png):
        raise ValueError("bytes after the end")
    width, height, depth, colour, *rest = head
    samples = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or samples is None or any(rest):
        raise ValueError("not an 8-bit image without interlacing")
    stated = height * (width * samples + 1)
    if not width or not height or stated > LIMIT:
        raise ValueError("size of the image")
    inflate = zlib.decompressobj()
    try:
        lines = inflate.decompress(b"".join(body), stated + 1)
    except zlib.error as e:
        raise ValueError("deflated data") from e
    if len(lines) != stated:
        raise ValueError("length of the rows")
    if not inflate.eof:
        try:  # the end of the stream and its checksum
            if inflate.decompress(inflate.unconsumed_tail, 1) or not inflate.eof:
                raise ValueError("length of the rows")
        except zlib.error as e:
            raise ValueError("deflated data") from e
    if inflate.unused_data:
        raise ValueError("bytes after the deflated data")
    return unfilter(np.frombuffer(lines, np.uint8).reshape(height, -1), samples), samples


SIDE, LOW = 32, 8
_COSINE = np.cos(np.pi * (2 * np.arange(SIDE) + 1)[None, :] * np.arange(LOW)[:, None] / (2 * SIDE))


def feature(rows: np.ndarray, samples: int) -> str:
    """64 bits as 16 hex digits; the constant coefficient counts as not above."""
    def fit(x: np.ndarray) -> np.ndarray:
        n = len(x)
        edge = np.arange(SIDE) * n // SIDE
        if n < SIDE:
            return x[edge]
        return np.add.reduceat(x, edge, 0) / np.diff(np.append(edge, n))[:, None]

    grey = rows.reshape(len(rows), -1, samples).sum(2, dtype=np.int64)
    small = fit(fit(grey).T).T
    low = (_COSINE @ small @ _COSINE.T).ravel()
    # Rounded, so that equal pictures have equal bits on any machine.
    low = np.round(low[1:], 3)
    bits = np.concatenate([[False], low > np.median(low)])
    return np.packbits(bits).tobytes().hex()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, png = [], []
        ids, texts, size = batch["doc_id"], batch["text"], 0
        begin = 0

        def out(begin, end):
            return pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array(n, pa.int64()), pa.array(png, pa.binary())], names=["doc_id", "n_bytes", "png"])

        for i, text in enumerate(texts.to_pylist()):
            data = (text or "").encode()
            n.append(len(data))
            png.append(write(padded(data)))
            size += len(png[-1])
            if size > 4 << 20:
                yield out(begin, i + 1)
                begin, n, png, size = i + 1, [], [], 0
        yield out(begin, len(texts))


def text_media(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes and the text as a binary column png."""
    return batched(docs.select(F.col("doc_id").cast("long"), "text"), _written, "doc_id long, n_bytes long, png binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [i for i, name in enumerate(batch.schema.names) if name != "png"]
        begin, cols, size = 0, [[] for _ in range(8)], 0

        def out(begin, end, cols):
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "payload", "error")
            part = batch.slice(begin, end - begin).select(rest)
            return pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*part.schema.names, *names])

        for i, png in enumerate(batch["png"].to_pylist()):
            row = [None] * 8
            try:
                if png is None:
                    raise ValueError("null")
                row[3:5] = [len(png), hashlib.sha256(png).hexdigest()]
                rows, samples = read(png)
                data = rows.tobytes()
                row[:3] = [len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])]
                row[5:7] = [feature(rows, samples), data]
                size += len(data)
            except ValueError as e:
                row[7] = str(e)
            for c, x in zip(cols, row, strict=True):
                c.append(x)
            if size > 4 << 20:
                yield out(begin, i + 1, cols)
                begin, cols, size = i + 1, [[] for _ in range(8)], 0
        yield out(begin, batch.num_rows, cols)


def read_media(media: DataFrame) -> DataFrame:
    """Read a binary column png: its other columns stay; payload and media lengths and digests, feature, payload, error."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.drop("png").schema)
    return batched(media, _read, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, payload binary, error string")
