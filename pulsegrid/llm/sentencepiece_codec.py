"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position the automaton's state and its output links name all pieces that end there; each relaxes the best score
of the position. The model file (a public .model) has pieces, scores and kinds; it is read here without its library and
goes to the executors as bytes. The segmentation is the one with the highest sum of scores, ties to the longest last
piece. Characters that no piece has become byte pieces where the model has them, else the unknown piece.

Where no piece goes on behind a word into the next space mark, the best segmentation of a text is that of its words, so
words are segmented once and kept in a bounded cache; with other models whole texts go through the automaton.

Defined results: null text has null ids and null decoded text; empty text has no ids. decode() of encode() is the text
as it was, whatever its characters (with byte pieces), except for what the model's normaliser would change: only
identity normalisers are taken, and the mark U+2581 in a text comes back as a space (round_trip is false). Equal rows have equal results. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker keeps.
CACHE = 300_000
#: Cost of an unknown character below the lowest score.
PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialized message: number, and an integer or the bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Codec:
    """Encodes and decodes by one model."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.dummy = True
        for number, body in _fields(model):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for k, v in _fields(body):
                    if k == 1:
                        text = v.decode()
                    elif k == 2:
                        (score,) = struct.unpack("<f", v)
                    elif k == 3:
                        kind = v
                self.pieces.append((text, score, kind))
            elif number == 3:
                for k, v in _fields(body):
                    if k == 1 and v not in (b"identity", b""):
                        raise ValueError(f"normaliser {v!r}")
                    if k == 3:
                        self.dummy = bool(v)
                    if k == 4 and v:
                        raise ValueError("a model that removes spaces")
        self.automaton = ahocorasick.Automaton()
        low = min((s for _, s, k in self.pieces if k == NORMAL), default=0.0)
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.miss = low - PENALTY
        self.bytes: dict[int, int] = {}
        chars: set[str] = set()
        self.by_word = True
        for i, (text, score, kind) in enumerate(self.pieces):
            if kind in (NORMAL, USER) and text:
                self.automaton.add_word(text, (len(text), score, i))
                chars.update(text)
                self.by_word &= not re.search(f"[^{MARK}]{MARK}", text)
            elif kind == BYTE:
                self.bytes[int(text[1:-1], 16)] = i
        self.automaton.make_automaton()
        # Characters that no piece has stand alone in any segmentation.
        self.words = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if "\n" not in chars else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache: dict[str, bytes] = {}
        self.surface = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.encode() for t, _, k in self.pieces]

    def segment(self, text: str) -> list[int]:
        """Viterbi over one stretch of text."""
        n = len(text)
        best, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        matches = self.automaton.iter(text)
        upcoming = next(matches, None)
        for end in range(1, n + 1):
            top, link = -1e300, (0, -1)
            while upcoming is not None and upcoming[0] == end - 1:
                size, score, i = upcoming[1]
                score += best[end - size]
                if score > top or score == top and size > link[0]:
                    top, link = score, (size, i)
                upcoming = next(matches, None)
            alone = best[end - 1] + self.miss
            if alone > top:  # no piece ends here with this character alone
                top, link = alone, (1, -1)
            best[end], back[end] = top, link
        out: list[int] = []
        at = n
        while at:
            size, i = back[at]
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(self.unknown)
            at -= size
        return out[::-1]

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit little-endian integers."""
        if not text:
            return b""
        text = (MARK if self.dummy else "") + text.replace(" ", MARK)
        if not self.by_word:
            return np.array(self.segment(text), "<i4").tobytes()
        cache, out = self.cache, []
        for word in self.words.findall(text):
            ids = cache.get(word)
            if ids is None:
                ids = np.array(self.segment(word), "<i4").tobytes()
                if len(word) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec a worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def _encode(batches: Iterator[pa.RecordBatch], model: bytes, ids: bool) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    is_byte = np.zeros(len(c.pieces), bool)
    is_byte[list(c.bytes.values())] = True
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        size, begin = 0, 0
        texts = batch["text"].to_pylist()

        def out(end, cols, begin):
            lists = []
            if ids:
                flat = np.frombuffer(b"".join(x or b"" for x in cols[5]), "<i4")
                at = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in cols[5]])]).astype(np.int32)
                gone = np.array([x is None for x in cols[5]] + [False])
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=gone), pa.array(flat, pa.int32()))]
            head = [batch["doc_id"].slice(begin, end - begin), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.bool_())]
            return pa.RecordBatch.from_arrays(head + lists, names=["doc_id", "n_tokens", "n_bytes_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * ids)

        for i, text in enumerate(texts):
            if text is None:
                row = [None] * 6
            else:
                coded = c.encode_bytes(text)
                numbers = np.frombuffer(coded, "<i4")
                back = c.decode(numbers)
                row = [len(numbers), int(is_byte[numbers].sum()), hashlib.sha256(coded).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text, coded if ids else b""]
                size += len(coded)
            for column, x in zip(cols, row, strict=True):
                column.append(x)
            if size > 4 << 20:
                yield out(i + 1, cols, begin)
                begin, cols, size = i + 1, [[] for _ in range(6)], 0
        yield out(len(texts), cols, begin)


def encode(docs: DataFrame, *, model: str = MODEL, ids: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, n_bytes_tokens, digests of ids and decoded text, round_trip, ids."""
    with open(model, "rb") as f:
        data = f.read()
    shape = "doc_id long, n_tokens long, n_bytes_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    return batched(docs.select(F.col("doc_id").cast("long"), "text"), partial(_encode, model=data, ids=ids), shape)


def _decode(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for batch in batches:
        texts = [None if x is None else c.decode(np.array(x, np.int32)) for x in batch["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(coded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """Per row of coded (doc_id, ids): the text."""
    with open(model, "rb") as f:
        data = f.read()
    return batched(coded.select(F.col("doc_id").cast("long"), "ids"), partial(_decode, model=data), "doc_id long, text string")
