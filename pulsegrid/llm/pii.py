"""Personal data, also in disguise: offset-preserving deobfuscation.

Identifiers (email, ip, card, phone) are found in the text as it is; these are the base spans. Then transducers rewrite
the text step by step: homoglyphs and full-width forms to ASCII, spelled digits to digits, at/dot disguises to @ and
dots. Every character of the rewritten text keeps the bounds of its source, so identifiers found there map back to
source characters. They are added where no span of their kind covers them wholly; base spans always stay, so a longer
added span can lie over a base one.

Texts that no transducer changes, nearly all, are searched once. Each transducer reads the text once, token by token, and
no pattern goes over a run of tokens, so time is linear in the text. Digits are known as spelled in English, German,
French and Spanish. An address in bare words needs a known last label and a host that is no article or pronoun; prose
that meets both ("ask at example dot com") is an address to it.

Defined results: null text is as empty, without spans; redact() leaves null as null. Offsets are code points, end
exclusive. Equal rows have equal results. Columns of any other names stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
# Of a chain of digits with single separators, all or nothing: 14 to 19 of them.
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![0-9])(?![ -][0-9])")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """The base spans of a text, by start and then kind."""
    out: list[Span] = []
    last = 0
    if "@" in text:
        for m in _HOST.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                last = m.end()
                out.append((start, 0, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if m.end() - m.start() < 16 and max(map(int, m[0].split("."))) <= 255 or all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if luhn(m[0].replace(" ", "").replace("-", "")):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# Letters of other scripts and forms that look like an ASCII character.
_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ſ": "s", "ı": "i", "İ": "I",
    "．": ".", "。": ".", "․": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_LIKE |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_LIKE |= {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_NOTHING = "​‌‍⁠﻿­"  # zero width: between characters of an identifier
_GLYPHS = re.compile("[" + re.escape("".join(_LIKE)) + _NOTHING + "]")
_GLYPH_SET, _NOT_ASCII = frozenset((*_LIKE, *_NOTHING)), re.compile(r"[^\x00-\x7f]")
# Spelled digits, in the four languages of the documents.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words for +, . and @.
_PLUS, _POINT, _AROUND = ("plus", "más", "mas"), ("dot", "punkt", "point", "punto"), ("at", "arroba", "arobase")
# Last labels that bare words may end in, and words that are no name of a host.
_TOP = frozenset("com org net edu gov mil int info biz io co uk us de fr es it nl eu ch at be ca au br in jp cn ru pl se no dk fi me tv app dev ai xyz online site".split())
_NO_HOST = frozenset("the this that these those a an my your our his her its their".split())

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKETED = re.compile(rf"{_OPEN}[ ]*(?:(?P<at>@|{'|'.join(_AROUND)})|\.|{'|'.join(_POINT)})[ ]*{_CLOSE}", re.I)
_TOKEN = re.compile(r"\w+|\W+")
_PIECE = re.compile(r"[A-Za-z0-9._%+-]+|@|[ ]+|[^A-Za-z0-9._%+ @-]+")
_HOST_NAME = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\Z")


class Rewritten:
    """A text and the source bounds of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def put(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace text[a:b], in order; what is put in has the bounds of all it stands for."""
        if not edits:
            return
        a, b, new = zip(*edits, strict=True)
        begin, stop = np.array([0, *b]), np.array([*a, len(self.text)])  # what stays, around the edits
        size = np.empty(2 * len(edits) + 1, np.int64)
        size[::2], size[1::2] = stop - begin, [len(x) for x in new]
        first, last = np.empty_like(size), np.empty_like(size)
        first[::2], first[1::2] = begin, a
        last[::2], last[1::2] = begin, b
        last[1::2] -= 1
        stays = np.repeat(np.arange(len(size)) % 2 == 0, size)
        off = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) * stays
        self.start, self.end = self.start[np.repeat(first, size) + off], self.end[np.repeat(last, size) + off]
        kept = [self.text[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
        self.text = "".join(x for pair in zip(kept, (*new, ""), strict=True) for x in pair)


def _glyphs(t: Rewritten) -> None:
    t.put([(m.start(), m.end(), _LIKE.get(m[0], "")) for m in _GLYPHS.finditer(t.text)])


class _Run:
    """Numbers that follow each other, with what stands between them, as far as the scan has come."""

    def __init__(self) -> None:
        self.parts: list[tuple[str, int, int, str]] = []  # kind (plus, word, figures, gap, dot), bounds, what it becomes
        self.numbers = 0
        self.after: list[tuple[str, int, int, str]] = []  # seen after the last number, not yet part of the run

    def edits(self) -> list[tuple[int, int, str]]:
        """Of four numbers or more: spelled digits and dots; where one is spelled, gaps after spelled ones close.

        Gaps after leading numbers of several digits stay as they are: such a number need not belong to what follows.
        """
        if self.numbers < 4:
            return []
        out, led, spelled = [], False, False
        said = any(kind == "word" for kind, *_ in self.parts)
        for kind, a, b, new in self.parts:
            if kind == "figures":
                led |= b - a == 1
            elif kind == "dot":
                spelled = False
                if b - a > 1:
                    out.append((a, b, "."))
            elif not said:
                continue
            elif kind == "gap":
                if led:
                    out.append((a, b, "" if spelled else new))
            else:
                led, spelled = True, kind == "word"
                out.append((a, b, new))
        return out


def _said(t: Rewritten) -> None:
    """Spelled digits to digits, in one scan: every token is read once and joins the run at hand or ends it.

    Between two numbers stand spaces, commas and hyphens, or one dot, plain or as a word, with spaces around it.
    """
    edits: list[tuple[int, int, str]] = []
    run = _Run()

    def ended() -> None:
        nonlocal run
        edits.extend(run.edits())
        run = _Run()

    for m in _TOKEN.finditer(t.text):
        a, b, x = m.start(), m.end(), m[0]
        if x[0].isalnum() or x[0] == "_":
            low = x.lower()
            digit = _SPELLED.get(low)
            if digit is not None or (x.isascii() and x.isdigit()):
                after = run.after
                if not run.numbers:
                    joined = not after  # after plus and its gap, or first of all
                elif len(after) == 1:
                    joined = True
                    run.parts.append(after[0])
                else:  # one dot in all, with nothing but spaces
                    joined = sum(p[0] == "dot" for p in after) == 1 and not any(t.text[p:q].strip(" ") for k, p, q, _ in after if k == "gap")
                    if joined:
                        run.parts.append(("dot", after[0][1], after[-1][2], "."))
                if not joined:
                    ended()
                run.after = []
                run.parts.append(("word", a, b, digit) if digit is not None else ("figures", a, b, ""))
                run.numbers += 1
            elif low in _POINT and run.numbers and len(run.after) == 1 and not t.text[run.after[0][1] : a].strip(" "):
                run.after.append(("dot", a, b, "."))
            else:
                ended()
                if low in _PLUS:
                    run.parts.append(("plus", a, b, "+"))
        elif not run.parts:
            continue
        elif run.after and run.after[-1][0] == "dot":
            if x.strip(" "):
                ended()
            else:
                run.after.append(("gap", a, b, ""))
        elif not x.strip(" ,-"):
            run.after.append(("gap", a, b, x[:1].replace(",", " ")))
        elif run.numbers and x.strip(" ") == ".":
            run.after.append(("dot", a, b, "."))
        else:
            ended()
        if run.parts and not run.numbers and run.after and run.parts[0][0] == "plus":
            run.parts, run.after = [*run.parts, ("gap", run.after[0][1], run.after[0][2], "")], []  # the gap after plus
    ended()
    t.put(edits)


def _spaced(text: str, m: re.Match, low: int) -> tuple[int, int]:
    """A match with the spaces around it, not before `low`: a run of spaces lies beside two matches at most."""
    a, b = m.start(), m.end()
    while a > low and text[a - 1] == " ":
        a -= 1
    while b < len(text) and text[b] == " ":
        b += 1
    return a, b


def _at_dot(t: Rewritten) -> None:
    """Bracketed signs first, then bare words, as a whole only: local at host dot name.

    Bare words are read in one scan of pieces. From each @ or at, host names and dots follow each other as far as they
    go; a host that goes on past another at ends there for that one, so each piece is read twice at most.
    """
    edits, low = [], 0
    for m in _BRACKETED.finditer(t.text):
        a, b = _spaced(t.text, m, low)
        low = b
        edits.append((a, b, "@" if m["at"] else "."))
    t.put(edits)
    pieces = [(m[0], m.start(), m.end()) for m in _PIECE.finditer(t.text)]
    edits, i = [], 1
    gap = lambda k: k < len(pieces) and pieces[k][0][0] == " "
    word = lambda k: pieces[k][0].lower() if k < len(pieces) else ""
    name = lambda k: k < len(pieces) and _HOST_NAME.match(pieces[k][0].rstrip(".")) is not None
    local = lambda k: k >= 0 and pieces[k][0][0] in _LOCAL
    while i < len(pieces):
        if pieces[i][0] == "@" and local(i - 1):
            at, host = (pieces[i][1], pieces[i][2]), i + 1
        elif word(i) in _AROUND and gap(i - 1) and gap(i + 1) and local(i - 2):
            at, host = (pieces[i - 1][1], pieces[i + 1][2]), i + 2
        else:
            i += 1
            continue
        found, dots, k = None, [], host
        while name(k) and (dots or word(k) not in _NO_HOST):
            if dots and word(k).rstrip(".").rsplit(".")[-1] in _TOP:
                found = (k, len(dots))
            if not (gap(k + 1) and word(k + 2) in _POINT and gap(k + 3)) or pieces[k][0][-1] == ".":
                break
            dots.append((pieces[k + 1][1], pieces[k + 3][2]))
            k += 4
        if found:
            edits.append((*at, "@"))
            edits += [(a, b, ".") for a, b in dots[: found[1]]]
            i = found[0] + 1
        else:
            i += 1
    t.put(edits)


# What any transducer changes has a match in the text in lower case: of a run with a spelled digit, that digit and the
# number before or after it.
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_GAP = rf"(?:[ ,-]++|[ ]*+(?:\.|(?:{'|'.join(_POINT)})[ ])[ ]*+)"
_LETTERS = re.compile(r"[^\W\d_]+")
_MAY_BRACKET = re.compile(rf"{_OPEN}[ ]*+(?:@|\.|{'|'.join((*_AROUND, *_POINT))})[ ]*+{_CLOSE}")
_MAY_POINT = re.compile(rf"[ ](?:{'|'.join(_POINT)})[ ]")
_MAY_SAID = re.compile(rf"\b{_WORD}{_GAP}(?:{_WORD}|[0-9])|[0-9]{_GAP}{_WORD}\b")
_DIGIT_WORDS = frozenset(_SPELLED)
_SPACED = tuple(f" {x} " for x in _POINT)


def _may(text: str) -> bool:
    if not text.isascii() and not _GLYPH_SET.isdisjoint(_NOT_ASCII.findall(text)):
        return True
    low = text.lower()
    if any(c in low for c in "[({<") and _MAY_BRACKET.search(low) or any(c in low for c in _SPACED) and _MAY_POINT.search(low):
        return True
    return not _DIGIT_WORDS.isdisjoint(_LETTERS.findall(low)) and _MAY_SAID.search(low) is not None


def _beside(base: list[Span], found: list[Span]) -> list[Span]:
    """Of the spans found, by start and then kind, those that no other of their kind covers wholly, base ones included."""
    out, reach, known = [], [-1 for _ in KINDS], set(base)
    for span in sorted(known | set(found), key=lambda x: (x[0], -x[2])):
        if span[2] > reach[span[1]]:
            reach[span[1]] = span[2]
            if span not in known:
                out.append(span)
    return sorted(out)


def detect(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text."""
    base = find(text)
    if not _may(text):
        return base, []
    t = Rewritten(text)
    found: list[Span] = []
    for step in (_glyphs, _said, _at_dot):
        before = t.text
        step(t)
        if t.text != before:  # what one step joins to its surroundings may have stood alone after the step before
            found += [(int(t.start[a]), k, int(t.end[b - 1])) for a, k, b in find(t.text)]
    return base, _beside(base, found) if found else []


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that overlap, replaced by its (first) kind."""
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda x: (x[0], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, all_, more = [[] for _ in KINDS], [], [], []
        for text in batch["text"].to_pylist():
            base, added = detect(text or "")
            for k, column in enumerate(n):
                column.append(sum(x[1] == k for x in base))
            digest.append(hashlib.sha256(told(base).encode()).hexdigest())
            all_.append(told(sorted(base + added)))
            more.append(len(added))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in n), pa.array(digest, pa.string()), pa.array(all_, pa.string()), pa.array(more, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def spans(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts of the base spans, their digest, all spans as kind:start:end, n_added."""
    return batched(docs.select(F.col("doc_id").cast("long"), "text"), _found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _redact(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else redacted(x, sum(detect(x), [])) for x in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every identifier in text replaced by [KIND], and n_chars, if there is one, counted anew."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = batched(docs, partial(_redact, at=docs.columns.index("text")), shape)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
