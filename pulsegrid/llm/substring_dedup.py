"""Substring dedup by seed and extend.

A repeat is a window of `length` consecutive words whose sequence also starts anywhere else. Of the g-word grams of a
window (g about half the length) the one with the smallest hash is the window's anchor, so equal windows have equal
anchors in the same place (winnowing).

1. Seeds: texts meet on anchors. Each occurrence of an anchor stands for the run of windows that it is the anchor of
   and carries one hash of the stretch they cover, that is, of its whole extension to both sides.
2. Extension: where the stretch as a whole recurs, all its windows do. At the ends of maximal repeats, where a stretch
   agrees with others only in part, the extension goes on word by word: each window of the run is held against the
   windows of the same place around the anchor's other occurrences.
3. The windows that recur, merged, are the maximal repeats of at least the length; the words they cover go.

A passage that a third of all texts share doesn't gather in one task: tasks merge equal stretches (and equal windows)
before the shuffle and send one of them; what they have met twice is settled where it is. Equal keys come sorted and
are read as a stream, in bounded memory. Tasks read rows in an order that files or sort keys fix, so one that runs
again after a loss settles and sends the same.

Defined results: null or empty text has no words. A text of fewer words than the length keeps all. A window may overlap
the other place where its sequence starts, in the same text too. Rows are told apart by doc_id and text, so repeated
rows, null ids and ids with several texts are all right: of equal texts long enough, everything goes. Other columns
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched, table
from pulsegrid.llm.textkit import U, Words, grouped, longs, mix, runs, spans, words

#: What a row says of its windows: they recur; they are yet to be held against others; they are there for others only.
RECUR, OPEN, WITNESS = 0, 1, 2
#: Rows that a task merges at a time.
MERGE = 400_000
#: Position bits in the order of grams; the rest has the top bits of the hash.
_AT = 28

_SEEDS = pa.schema([("anchor", pa.int64()), ("stretch", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("sure", pa.bool_())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("what", pa.int8())])
_WINDOWS = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("sure", pa.bool_())])


def anchors(w: Words, length: int) -> tuple[np.ndarray, ...]:
    """The runs of windows with one anchor: row, first window (from the row's first word), windows, anchor, stretch."""
    g = length // 2 + 1
    span = length - g + 1
    total = len(w.hash)
    each = np.maximum(w.counts - length + 1, 0)
    if not each.sum():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    at = np.arange(total - g + 1)
    gram = spans(w.hash, at, at + g)
    key = (gram >> U(_AT)) << U(_AT) | at.astype(U)
    low, wide = key, 1
    while wide * 2 <= span:  # the least of 2, 4, 8 ... grams
        low, wide = np.minimum(low[:-wide], low[wide:]), wide * 2
    low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    row = np.repeat(np.arange(len(each)), each)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(w.first[:-1], each)
    chosen = (low[begin] & U((1 << _AT) - 1)).astype(np.int64)
    cut = runs(row, chosen)
    head, n = cut[:-1], np.diff(cut)
    b = begin[head]
    # Where the anchor is in the stretch is part of it, so windows at one offset are at the same place around it.
    whole = mix(spans(w.hash, b, b + n + length - 1) ^ (chosen[head] - b).astype(U) * U(0x9E3779B97F4A7C15))
    return row[head], b - w.first[row[head]], n, gram[chosen[head]], whole


def _taken(batch: pa.RecordBatch, names: tuple[str, ...], rows: np.ndarray) -> list[pa.Array]:
    return [batch[c].take(pa.array(rows)) for c in names]


def _joined(doc, th, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge neighbouring runs of windows: (row to keep, first, n). Rows are ordered by (doc, th, first)."""
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(first), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (first[1:] > first[:-1] + n[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(first)) - 1
    return head, first[head], first[last] + n[last] - first[head]


class _Merge:
    """Rows of one task, merged by a key: one stands for all that are equal, and says whether it has met its like."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.size += len(columns[0])
        return self.size >= MERGE

    def take(self):
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else []
        self.parts, self.size = [], 0
        return columns


def _settle(key: np.ndarray, anchor: np.ndarray, ids: np.ndarray, given: np.ndarray, th: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[list, list]:
    """Split rows into those to send on (one of each key) and those settled here, as runs of windows that recur."""
    order = np.argsort(key, kind="stable")
    cut = runs(key[order])
    each = np.repeat(np.diff(cut), np.diff(cut))
    head = order[cut[:-1]]
    sure = np.diff(cut) > 1
    send = [anchor[head], key[head], ids[head], given[head], th[head], first[head], n[head], sure]
    done = order[each > 1]
    done = done[np.lexsort((first[done], th[done], ids[done], given[done]))]
    keep, f, m = _joined(ids[done], th[done], first[done], n[done])
    keep = done[keep]
    return send, [ids[keep], given[keep], th[keep], f, m]


def _ids(ids: np.ndarray, given: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=~given)


def _seeds(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    merge = _Merge()

    def out():
        got = merge.take()
        if not got:
            return
        send, done = _settle(got[1], got[0], *got[2:])
        yield pa.RecordBatch.from_arrays([longs(send[0]), longs(send[1]), _ids(send[2], send[3]), pa.array(send[4]), pa.array(send[5].astype(np.int32)), pa.array(send[6].astype(np.int32)), pa.array(send[7])], schema=_SEEDS)
        if len(done[0]):
            ids, given, th, f, n = done
            # Settled rows pass through the same exchange: n is negative, and the key spreads them.
            spread = mix(th.astype(np.int64).view(U) + f.astype(U))
            yield pa.RecordBatch.from_arrays([longs(spread), longs(spread), _ids(ids, given), pa.array(th), pa.array(f.astype(np.int32)), pa.array((-n).astype(np.int32)), pa.array(np.ones(len(ids), bool))], schema=_SEEDS)

    for batch in batches:
        ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        given = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        th = batch["th"].to_numpy(zero_copy_only=False)
        for w in words(batch["text"]):
            row, first, n, anchor, stretch = anchors(w, length)
            at = row + w.rows.start
            if merge.add(anchor, stretch, ids[at], given[at], th[at], first, n):
                yield from out()
    yield from out()


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, stretch): what is said of each occurrence's windows."""
    for batch, begins, ends in grouped(batches, "anchor"):
        anchor, stretch = batch["anchor"].to_numpy(), batch["stretch"].to_numpy()
        n, sure = batch["n"].to_numpy(), batch["sure"].to_numpy(zero_copy_only=False)
        settled = n < 0
        inner = runs(anchor, stretch)
        size = np.diff(inner)
        # A stretch recurs if two rows have it, or one that has met its like before it was sent.
        known = np.logical_or.reduceat(sure & ~settled, inner[:-1])
        full = np.repeat((size > 1) | known, size) & ~settled
        outer = runs(anchor)
        wide = np.diff(outer)
        mixed = np.logical_or.reduceat(~full & ~settled, outer[:-1])
        alone = wide == 1
        if not (begins and ends):
            alone[0 if not begins else -1] = False
        each = lambda x: np.repeat(x, wide)
        open_ = ~full & ~settled & ~each(alone)
        lead = np.zeros(len(anchor), bool)
        lead[inner[:-1]] = True
        witness = full & lead & each(mixed if begins and ends else np.ones(len(mixed), bool))
        what = np.concatenate([np.full(int((full | settled).sum()), RECUR), np.full(int(open_.sum()), OPEN), np.full(int(witness.sum()), WITNESS)])
        rows = np.concatenate([np.flatnonzero(full | settled), np.flatnonzero(open_), np.flatnonzero(witness)])
        if len(rows):
            yield pa.RecordBatch.from_arrays([*_taken(batch, ("doc_id", "th", "first"), rows), pa.array(np.abs(n[rows])), pa.array(what.astype(np.int8))], schema=_FOUND)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The hash of every window that is yet to be held against others, or is there for others."""
    merge = _Merge()

    def out():
        got = merge.take()
        if not got:
            return
        key, ids, given, th, first, witness = got
        order = np.argsort(key, kind="stable")
        cut = runs(key[order])
        head, size = order[cut[:-1]], np.diff(cut)
        told = np.logical_or.reduceat(witness[order], cut[:-1])
        # One row a window goes on. Of those met before, the others are settled here.
        done = order[(np.repeat(size > 1, size)) & ~witness[order]]
        one = np.ones(len(head), np.int32)
        yield pa.RecordBatch.from_arrays([longs(key[head]), _ids(ids[head], given[head]), pa.array(th[head]), pa.array(first[head].astype(np.int32)), pa.array(np.where((size > 1) | told, 0, one).astype(np.int32)), pa.array((size > 1) | told)], schema=_WINDOWS)
        if len(done):
            done = done[np.lexsort((first[done], th[done], ids[done], given[done]))]
            keep, f, m = _joined(ids[done], th[done], first[done], np.ones(len(done), np.int64))
            keep = done[keep]
            spread = mix(th[keep].view(U) + f.astype(U))
            yield pa.RecordBatch.from_arrays([longs(spread), _ids(ids[keep], given[keep]), pa.array(th[keep]), pa.array(f.astype(np.int32)), pa.array((-m).astype(np.int32)), pa.array(np.ones(len(keep), bool))], schema=_WINDOWS)

    for batch in batches:
        ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        given = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        th, said = batch["th"].to_numpy(zero_copy_only=False), batch["said"]
        for w in words(batch["text"]):
            part = said[w.rows.start : w.rows.stop]
            row = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
            flat = part.flatten()
            first, n, what = (flat.field(i).to_numpy() for i in range(3))
            of = np.repeat(np.arange(len(row)), n)
            p = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
            b = p + w.first[row[of]]
            at = row[of] + w.rows.start
            if merge.add(spans(w.hash, b, b + length), ids[at], given[at], th[at], p, what[of] == WITNESS):
                yield from out()
    yield from out()


def _recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by window: those that recur. n is 1 for a window to be told, 0 for one told already or there for others only, less for settled ones."""
    for batch, begins, ends in grouped(batches, "window"):
        window, n, sure = batch["window"].to_numpy(), batch["n"].to_numpy(), batch["sure"].to_numpy(zero_copy_only=False)
        cut = runs(window)
        size = np.diff(cut)
        live = n >= 0
        many = np.add.reduceat(live.astype(np.int64), cut[:-1]) > 1
        if not (begins and ends):
            many[0 if not begins else -1] = True
        again = np.repeat(many | np.logical_or.reduceat(sure & live, cut[:-1]), size)
        rows = np.flatnonzero((again & (n == 1)) | ~live)
        if len(rows):
            yield pa.RecordBatch.from_arrays([*_taken(batch, ("doc_id", "th", "first"), rows), pa.array(np.abs(n[rows])), pa.array(np.zeros(len(rows), np.int8))], schema=_FOUND)


def _kept(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said, counts, removed, digests, kept = batch["said"], [], [], [], []
        for w in words(batch["text"]):
            part = said[w.rows.start : w.rows.stop].fill_null([])
            row = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
            flat = part.flatten()
            first, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            begin = w.first[row] + first
            cover = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + n + length - 1, -1)
            gone = np.cumsum(cover)[:-1] > 0
            lost = np.add.reduceat(np.append(gone, False), w.first[:-1]) * (w.counts > 0) if len(w.first) > 1 else np.zeros(0)
            view = w.data.tobytes()
            for i, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                stay = np.flatnonzero(~gone[lo:hi]) + lo if lost[i] else range(lo, hi)
                start, end = w.start, w.end
                text = b" ".join([view[a:b] for a, b in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]) if lost[i] else b" ".join(view[start[lo] : end[hi - 1]].split() if hi > lo else [])
                digests.append(hashlib.sha256(text).hexdigest())
                if texts:
                    kept.append(text.decode("utf-8"))
            counts.append(w.counts)
            removed.append(lost)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        r = np.concatenate(removed).astype(np.int64) if removed else np.zeros(0, np.int64)
        columns = [batch["doc_id"], pa.array(n), pa.array(r), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * texts, names=names + ["kept"] * texts)


def substring_dedup(docs: DataFrame, *, length: int = 35, texts: bool = False) -> DataFrame:
    """Remove every word that a repeated window of `length` words covers; windows are judged on the input.

    Returns one row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if texts, the kept
    words joined by one space.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    seeds = batched(docs, partial(_seeds, length=length), "anchor long, stretch long, doc_id long, th long, first int, n int, sure boolean")
    found = "doc_id long, th long, first int, n int, what tinyint"
    seeds = seeds.repartition("anchor").sortWithinPartitions("anchor", "stretch")
    said = table(batched(seeds, _extend, found), "seeds")

    def per_row(x: DataFrame) -> DataFrame:
        return x.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).agg(F.array_sort(F.collect_list(F.struct("first", "n", "what"))).alias("said"))

    def met(x: DataFrame, how: str) -> DataFrame:
        return docs.join(x, docs["th"].eqNullSafe(x["__t"]) & docs["doc_id"].eqNullSafe(x["__d"]), how).select("doc_id", "text", "th", "said")

    asked = said.where(f"what <> {RECUR}")
    windows = batched(met(per_row(asked), "inner"), partial(_windows, length=length), "window long, doc_id long, th long, first int, n int, sure boolean")
    more = batched(windows.repartition("window").sortWithinPartitions("window"), _recur, found)
    covered = said.where(f"what = {RECUR}").unionByName(more)
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return batched(met(per_row(covered), "left"), partial(_kept, length=length, texts=texts), shape)
