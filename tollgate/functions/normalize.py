"""Undoing evasions, with an exact map back to the text as it was sent.

Six passes in order: JSON values, character references, percent escapes,
invisible characters, readable base64, NFKC. Every byte of the result knows the
run of original bytes it came from, as two arrays; a pass only says where its
own output comes from, and composing passes is indexing these arrays.
"""

from __future__ import annotations

import base64
import binascii
import html
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.patterns import BASE64_TOKEN, INVISIBLE_CLASS

NORMALISED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("ns", "ne", "os", "oe")]))),
        T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))),
    ]
)

_ENTITY = re.compile(rb"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_PERCENT = re.compile(rb"(?:%[0-9a-fA-F]{2})+")
_TOKEN = re.compile(BASE64_TOKEN.encode())
_HIDDEN = re.compile(INVISIBLE_CLASS + "+")
_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|(-?[0-9][0-9.eE+-]*)|(true|false|null))')


class Piece:
    """Output of a pass under construction: bytes, and their runs in the pass's input."""

    def __init__(self, source: bytes):
        self.source, self.out, self.start, self.end = source, [], [], []
        self.length = 0

    def keep(self, a: int, b: int) -> None:
        if a < b:
            self.out.append(self.source[a:b])
            self.start.append(np.arange(a, b))
            self.end.append(np.arange(a + 1, b + 1))
            self.length += b - a

    def put(self, text: bytes, a: int, b: int) -> None:
        """``text`` stands for input bytes a to b; byte by byte if it is as long."""
        if len(text) == b - a:
            self.start.append(np.arange(a, b))
            self.end.append(np.arange(a + 1, b + 1))
        else:
            self.start.append(np.full(len(text), a))
            self.end.append(np.full(len(text), b))
        self.out.append(text)
        self.length += len(text)

    def result(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return b"".join(self.out), np.concatenate([none, *self.start]), np.concatenate([none, *self.end])


def _strict_json(text: str):
    def refuse(name: str):
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def _json_values(raw: bytes) -> Piece | None:
    """String and number values of a whole JSON object or array, one per line."""
    head = raw.strip()[:1]
    if head not in (b"{", b"["):
        return None
    text = raw.decode(errors="surrogateescape")
    try:
        _strict_json(text)
    except (ValueError, RecursionError):
        return None
    width = None if raw.isascii() else np.concatenate([[0], np.cumsum([len(c.encode(errors="surrogateescape")) for c in text])])

    def byte(i: int) -> int:
        return i if width is None else int(width[i])

    piece, at, keys = Piece(raw), 0, []
    key_next = False
    while m := _JSON_TOKEN.match(text, at):
        at = m.end()
        mark, string, number, _ = m.groups()
        if mark:
            if mark in "{[":
                keys.append(mark == "{")
                key_next = mark == "{"
            elif mark in "}]":
                keys.pop()
                key_next = False
            elif mark == ",":
                key_next = bool(keys) and keys[-1]
            else:
                key_next = False
            continue
        if key_next or not (string or number):
            continue
        a, b = byte(m.start(2 if string else 3)), byte(m.end())
        if piece.length:
            piece.put(b"\n", a, a)
        if number:
            piece.keep(a, b)
        else:
            value = json.loads(string).encode("utf-8", errors="replace")
            if value == raw[a + 1 : b - 1]:
                piece.keep(a + 1, b - 1)
            else:
                piece.put(value, a, b)
    return piece


def _substituted(raw: bytes, pattern: re.Pattern, change) -> Piece | None:
    piece, at = Piece(raw), 0
    changed = False
    for m in pattern.finditer(raw):
        new = change(m[0])
        if new is None:
            continue
        changed = True
        piece.keep(at, m.start())
        piece.put(new, m.start(), m.end())
        at = m.end()
    piece.keep(at, len(raw))
    return piece if changed else None


def _entity(match: bytes) -> bytes | None:
    new = html.unescape(match.decode()).encode(errors="replace")
    return new if new != match else None


def _percent(match: bytes) -> bytes | None:
    new = bytes.fromhex(match.replace(b"%", b"").decode())
    try:
        new.decode()
    except UnicodeDecodeError:
        return None
    return new


def decode_readable(token: bytes) -> bytes | None:
    """The trimmed text of a base64 token, if it is text a person could read."""
    body = token.rstrip(b"=")
    padding, need = len(token) - len(body), -len(body) % 4
    if need == 3 or padding not in (0, need) or (set(body) & set(b"+/") and set(body) & set(b"-_")):
        return None
    try:
        raw = base64.b64decode(body.replace(b"-", b"+").replace(b"_", b"/") + b"=" * need, validate=True)
        text = raw.decode()
    except (binascii.Error, UnicodeDecodeError):
        return None
    if len(raw) < 8 or 10 * sum(c.isprintable() or c in "\n\t" for c in text) < 9 * len(text):
        return None
    return text.strip().encode()


def _nfkc(raw: bytes) -> Piece | None:
    text = raw.decode(errors="replace")
    if text.isascii() or unicodedata.is_normalized("NFKC", text):
        return None
    piece, at, a = Piece(raw), 0, 0
    while at < len(text):
        # A segment: a starter and what combines with it.
        to = at + 1
        while to < len(text) and (unicodedata.combining(text[to]) or _joins(text[at:to], text[to])):
            to += 1
        chunk = text[at:to]
        b = a + len(chunk.encode())
        new = unicodedata.normalize("NFKC", chunk)
        if new == chunk:
            piece.keep(a, b)
        else:
            piece.put(new.encode(), a, b)
        at, a = to, b
    return piece


def _joins(before: str, c: str) -> bool:
    """Whether a starter composes with what stands before it (Hangul and a few others)."""
    if ord(c) < 0x300:
        return False
    return unicodedata.normalize("NFKC", before + c) != unicodedata.normalize("NFKC", before) + unicodedata.normalize("NFKC", c)


def normalise(text: str) -> tuple[str, list[tuple[int, int, int, int]] | None, list[tuple[str, int, int, float]]]:
    """(normalised text, segments or None if nothing moved, evidence in original bytes)."""
    raw = text.encode(errors="replace")
    size = len(raw)
    start, end = np.arange(size), np.arange(1, size + 1)
    evidence: list[tuple[str, int, int, float]] = []
    touched = False

    def take(piece: Piece | None) -> None:
        nonlocal raw, start, end, touched
        if piece is None:
            return
        new, s, e = piece.result()
        if new == raw and len(s) == len(raw):
            return
        touched = True
        if len(new) == 0:
            raw, start, end = new, s, e
            return
        n = len(raw)
        # The original run of input bytes s to e; an empty run maps to where it stands.
        first = start[np.minimum(s, n - 1)] if n else s
        first = np.where(s >= n, end[-1] if n else 0, first)
        last = np.where(e > 0, end[np.maximum(e, 1) - 1], first)
        raw, start, end = new, first, np.where(e > s, last, first)

    def where(a: int, b: int) -> tuple[int, int]:
        return (int(start[a]), max(int(start[a]), int(end[b - 1]))) if b > a else (0, 0)

    take(_json_values(raw))
    if b"&" in raw:
        take(_substituted(raw, _ENTITY, _entity))
    if b"%" in raw:
        take(_substituted(raw, _PERCENT, _percent))
    if not raw.isascii():
        plain = raw.decode(errors="replace")
        piece, at, n, changed = Piece(raw), 0, 0, False
        for m in _HIDDEN.finditer(plain):
            a = n + len(plain[at : m.start()].encode())
            b = a + len(m[0].encode())
            piece.keep(n, a)
            evidence.append(("hidden_text", *where(a, b), 1.0))
            at, n, changed = m.end(), b, True
        piece.keep(n, len(raw))
        take(piece if changed else None)
    payloads = [(m.start(), m.end(), d) for m in _TOKEN.finditer(raw) if (d := decode_readable(m[0])) is not None]
    if payloads:
        piece = Piece(raw)
        piece.keep(0, len(raw))
        for a, b, decoded in payloads:
            piece.put(b"\n" + decoded, a, b)
            evidence.append(("encoded_payload", *where(a, b), 0.5))
        take(piece)
    if not raw.isascii():
        take(_nfkc(raw))
    if not touched:
        return text, None, evidence
    return raw.decode(errors="replace"), _segments(start, end), evidence


def _segments(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Runs of bytes: byte by byte (equal lengths), or all from one original run."""
    out: list[list[int]] = []
    single = (end - start == 1).tolist()
    for i, (s, e, one) in enumerate(zip(start.tolist(), end.tolist(), single, strict=True)):
        if out:
            last = out[-1]
            if one and last[4] and last[3] == s:
                last[1], last[3] = i + 1, e
                continue
            if not one and not last[4] and last[2] == s and last[3] == e:
                last[1] = i + 1
                continue
        out.append([i, i + 1, s, e, one])
    fixed = []
    for ns, ne, os, oe, one in out:
        if not one and ne - ns == oe - os and ne - ns > 1:
            # As long as its run by chance: kept whole by splitting it, so that no byte is taken for exact.
            fixed += [(k, k + 1, os, oe) for k in range(ns, ne)]
        else:
            fixed.append((ns, ne, os, oe))
    return fixed


@F.pandas_udf(NORMALISED)
def _normalise_series(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        if t is None:
            rows.append((None, None, None))
            continue
        text, segments, evidence = normalise(t)
        rows.append((text, segments and [dict(zip(("ns", "ne", "os", "oe"), s, strict=True)) for s in segments], [dict(zip(("type", "start", "end", "score"), e, strict=True)) for e in evidence]))
    return pd.DataFrame(rows, columns=["text", "segments", "evidence"])


#: Marked so that the optimiser neither repeats it nor moves it into other expressions.
normalise_udf = _normalise_series.asNondeterministic()


def may_change(text: Column) -> Column:
    """Whether any pass could do something: other rows need not leave the JVM."""
    return text.contains("&") | text.contains("%") | text.rlike(r"^\s*[{\[]") | text.rlike(BASE64_TOKEN) | text.rlike(r"[^\x00-\x7F]")


def strip_invisible(text: Column) -> Column:
    """Pass four alone, as a built-in expression."""
    return F.regexp_replace(text, INVISIBLE_CLASS, "")


