"""Words and their hashes for whole batches of texts at once, as numpy arrays over the UTF-8 bytes.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Hashes have 64 bits and depend on nothing but the words,
so any task, retry or size of batch gives the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 19
_FACTOR = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def byte_values(lower: bool) -> np.ndarray:
    """A fixed random number for each byte; lower: A-Z have those of a-z."""
    out = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=U)
    if lower:
        out[65:91] = out[97:123]
    return out


@cache
def letters() -> np.ndarray:
    """Bytes that part words where only letters count: all of ASCII but letters."""
    out = np.ones(256, bool)
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return out


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse, n of each at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK + 1)
        up, down = np.full(n, _FACTOR, U), np.full(n, pow(_FACTOR, -1, 2**64), U)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair of bounds, from one running sum."""
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F))


class Words(NamedTuple):
    """Some rows' words. first[i]:first[i+1] are the words of row i; start and end are byte bounds in data."""

    rows: slice
    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def words(column: pa.Array, lower: bool = False, chunk: int = CHUNK, space: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a text column, some rows at a time: about chunk bytes, or one longer text."""
    data, offsets = raw(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        solid = ~space[part]
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(part))]
        start[edge] = solid[edge]
        end[edge - 1] = solid[edge - 1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        yield Words(slice(lo, hi), part, np.searchsorted(start, at), start, end, spans(byte_values(lower)[part], start, end))
        lo = hi


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every row's distinct k-word shingles: (row, hash) sorted by both, and each row's count.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    counts = w.counts
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), each)
    begin = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(w.first[:-1], each)
    value = spans(w.hash, begin, np.minimum(begin + k, w.first[1:][row]))
    order = np.argsort(value)
    order = order[np.argsort(row[order], kind="stable")]
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, np.bincount(row, minlength=len(counts))


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def runs(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys, and the length at the end."""
    n = len(keys[0])
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for k in keys:
        new[1:n] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def grouped(batches: Iterator[pa.RecordBatch], key: str, hold: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """Sorted batches, cut again so that equal keys stay together: (rows, begins, ends).

    A group of over `hold` rows comes in parts of its own, so memory stays bounded. begins: the first row is the first
    of its group; ends: no further row of the last group can come.
    """
    rest: pa.Table | None = None
    gone_on = None  # key of a group of which a part is out
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        keys = now[key].to_numpy()
        last = keys[-1]
        cut, lead = int(np.searchsorted(keys, last, "left")), 0
        if gone_on is not None and last != gone_on:
            lead = int(np.searchsorted(keys, gone_on, "right"))
            gone_on = None
            if lead:
                yield _one(now.slice(0, lead)), False, True
        if cut > lead:
            yield _one(now.slice(lead, cut - lead)), True, True
        rest = now.slice(cut)
        if rest.num_rows > hold:
            yield _one(rest), gone_on is None, False
            rest, gone_on = None, last
    if rest is not None:
        yield _one(rest), gone_on is None, True


def _one(rows: pa.Table) -> pa.RecordBatch:
    return rows.combine_chunks().to_batches()[0]
