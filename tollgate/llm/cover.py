"""Repeated windows of whole corpora by difference covers.

A *difference cover* modulo v is a set D of residues such that for any two
positions i and j some shift d < v puts both i + d and j + d on the cover. Two
equal windows of W symbols therefore share an equal gram of L = W - v + 1
symbols that starts at a cover position in both. The engine does this:

1. ``sieve``: only the grams at cover positions (|D| of v) are fingerprinted
   and dealt by fingerprint; those that occur once anywhere prove that no
   window which needs them repeats.
2. ``regions``: repeated grams are widened to all windows that hold them; only
   these stretches of text go on, as a written table.
3. ``windows``: every window of the stretches gets an 80-bit fingerprint plus
   its bucket; one bucket at a time is sorted in memory, and the positions of
   windows that no earlier document has go back to their documents.

Before anything is dealt, equal keys of a chunk are reduced to one row, so a
key that a third of all documents share sends one row per chunk. No pairs of
documents are formed, and nothing goes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import BLOCK, BLOCK_SCHEMA, binary_column, block_batch, block_table, bucket_count, bucket_of, deal, decode, encode, materialize, packed_texts, ranges, read_text, text_columns

#: Kinds of blocks.
KEYS, HITS, REGIONS, UNIQUE = 0, 1, 2, 3


@lru_cache(maxsize=8)
def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """A perfect difference set for a prime q: q + 1 residues modulo q^2 + q + 1.

    Rule (Singer): the zeros of a linear recurrence of order three modulo q.
    The recurrences are tried in order until the zeros' differences cover every
    residue.
    """
    v = q * q + q + 1
    for c in range(1, q):
        for b in range(q):
            for a in range(q):
                s, zeros = (0, 0, 1), []
                for i in range(v):
                    if s[0] == 0:
                        zeros.append(i)
                    s = (s[1], s[2], (a * s[2] + b * s[1] + c * s[0]) % q)
                if len(zeros) == q + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
                    return v, np.array(zeros, np.int64)
    raise ValueError(f"{q} is not a prime")


@dataclass(frozen=True)
class Rule:
    """What repeats: windows of ``width`` symbols that also start in a document
    with a smaller id. ``q``: the prime that sets the cover."""

    alphabet: object
    width: int
    q: int
    chunk: int = 1 << 19
    period: int = field(init=False)
    gram: int = field(init=False)

    def __post_init__(self):
        v = self.q * self.q + self.q + 1
        if v >= self.width:
            raise ValueError("the cover's period must be below the width")
        object.__setattr__(self, "period", v)
        object.__setattr__(self, "gram", self.width - v + 1)

    def cover_positions(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document index, position) of every gram at a cover position of documents that have a window."""
        v, cover = difference_cover(self.q)
        top = int(sizes.max(initial=0))
        at = (np.arange(0, top + v, v)[:, None] + cover[None, :]).ravel()
        count = np.where(sizes >= self.width, np.searchsorted(at, sizes - self.gram + 1), 0)
        doc = np.repeat(np.arange(len(sizes)), count)
        return doc, at[np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)]


def _key_bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def _six(h: np.ndarray) -> np.ndarray:
    """The low six bytes of each key; the bucket holds what the high ones say."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6])


def _from_six(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and the number of each row's group in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _deal_positions(doc: np.ndarray, pos: np.ndarray, n: int, kind: int, out: list[tuple]) -> None:
    deal(bucket_of(doc, n), kind, [doc, pos.astype(np.uint32)], out)


def _sieve(docs: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Repeated grams at cover positions, dealt to their documents' buckets."""

    def emit(batches):
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            for lo, hi in ranges(offsets, rule.chunk * rule.alphabet.bytes_each):
                yield from chunk(ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])

    def chunk(ids, data, offsets):
        from tollgate.llm.symbols import Windows

        symbols, first, _ = rule.alphabet.symbols(data, offsets)
        doc, pos = rule.cover_positions(np.diff(first))
        if not len(doc):
            return
        key = Windows(symbols)(first[doc] + pos, rule.gram)
        order, group = _groups(key)
        size = np.bincount(group)
        many = np.empty(len(doc), bool)
        many[order] = size[group] > 1
        head = np.zeros(len(doc), bool)
        head[order[np.flatnonzero(np.diff(group, prepend=-1))]] = True
        out: list[tuple] = []
        _deal_positions(ids[doc[many]], pos[many], n, HITS, out)
        key, many, doc, pos = key[head], many[head], doc[head], pos[head]
        deal(_key_bucket(key, n), KEYS, [_six(key), many, ids[doc], pos.astype(np.uint32)], out)
        yield block_batch(out)

    def settle(table: pa.Table) -> pa.Table:
        kinds, blocks, out = table.column("kind").to_pylist(), binary_column(table, "block"), []
        parts = [decode(b, np.uint8, np.bool_, np.int64, np.uint32) for k, b in zip(kinds, blocks, strict=True) if k == KEYS]
        bucket = table.column("bucket")[0].as_py()
        out += [(bucket, HITS, b) for k, b in zip(kinds, blocks, strict=True) if k == HITS]
        if parts:
            key, many, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, group = _groups(_from_six(key))
            hit = order[(np.bincount(group)[group] > 1) & ~many[order]]
            _deal_positions(doc[hit], pos[hit], n, HITS, out)
        return block_table(out)

    return docs.mapInArrow(emit, BLOCK).groupBy("bucket").applyInArrow(settle, BLOCK)


def _positions(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Document ids and positions of all blocks of a kind, in that order."""
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [decode(b, np.int64, np.uint32) for k, b in zip(table.column("kind").to_pylist(), binary_column(table, "block"), strict=True) if k == kind]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    pos = pos.astype(np.int64)
    order = np.lexsort((pos, doc))
    return doc[order], pos[order]


def _rows_of(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document its range in the sorted array ``doc``."""
    return np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")


def _stretches(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching intervals, given by ascending start."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    cut = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[cut], reach[np.append(np.flatnonzero(cut)[1:] - 1, len(start) - 1)]


def _regions(packed: DataFrame, hits: DataFrame, rule: Rule, n: int) -> DataFrame:
    """The stretches of text that a repeated window could lie in."""

    def widen(texts: pa.Table, found: pa.Table) -> pa.Table:
        doc, pos = _positions(found, HITS)
        out: list[tuple] = []
        if not len(doc) or not texts.num_rows:
            return block_table(out)
        bucket = found.column("bucket")[0].as_py()
        for ids, data, offsets in read_text(binary_column(texts, "block")):
            lo, hi = _rows_of(ids, doc)
            own = np.flatnonzero(hi > lo)
            if not len(own):
                continue
            raw = data.tobytes()
            body = np.frombuffer(b"".join(raw[offsets[i] : offsets[i + 1]] for i in own.tolist()), np.uint8)
            at = np.concatenate([[0], np.cumsum(offsets[own + 1] - offsets[own])])
            for a, b in ranges(at, rule.chunk * 4):
                part = body[at[a] : at[b]]
                symbols, first, spans = rule.alphabet.symbols(part, at[a : b + 1] - at[a])
                raw, who, start, count, length, pieces = part.tobytes(), [], [], [], [], []
                for k in range(a, b):
                    i, size = own[k], int(first[k - a + 1] - first[k - a])
                    p = pos[lo[i] : hi[i]]
                    for s, e in zip(*map(np.ndarray.tolist, _stretches(np.maximum(p - (rule.width - rule.gram), 0), np.minimum(p + rule.width, size))), strict=True):
                        if e - s < rule.width:
                            continue
                        base = int(first[k - a])
                        piece = raw[base + s : base + e] if spans is None else raw[spans[0][base + s] : spans[1][base + e - 1]]
                        who.append(ids[i])
                        start.append(s)
                        count.append(e - s)
                        length.append(len(piece))
                        pieces.append(piece)
                if who:
                    out.append((bucket, REGIONS, encode(np.array(who, np.int64), np.array(start, np.uint32), np.array(count, np.uint32), np.array(length, np.int64), np.frombuffer(b"".join(pieces), np.uint8))))
        return block_table(out)

    return packed.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(widen, BLOCK)


def _read_regions(block: bytes):
    return decode(block, np.int64, np.uint32, np.uint32, np.int64, np.uint8)


def _merged_regions(batches, limit: int):
    """The stretches of many small blocks together, up to ``limit`` symbols or one block."""
    waiting, held = [], 0
    for batch in batches:
        for block in batch.column("block").to_pylist():
            waiting.append(_read_regions(block))
            held += int(waiting[-1][2].sum())
            if held >= limit:
                yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting, held = [], 0
    if waiting:
        yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))


def _windows(regions: DataFrame, rule: Rule, n: int) -> DataFrame:
    """Positions of the stretches' windows that no earlier document has."""

    def emit(batches):
        from tollgate.llm.symbols import Windows

        for ids, start, count, length, data in _merged_regions(batches, rule.chunk):
            offsets = np.concatenate([[0], np.cumsum(length)])
            for lo, hi in ranges(np.concatenate([[0], np.cumsum(count, dtype=np.int64)]), rule.chunk):
                symbols, first, _ = rule.alphabet.symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                many = np.diff(first) - rule.width + 1
                piece = np.repeat(np.arange(hi - lo), many)
                pos = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
                at = first[piece] + pos
                key = Windows(symbols)(at, rule.width)
                check = (Windows(symbols, 1)(at, rule.width) >> np.uint64(32)).astype(np.uint32)
                yield from reduced(key, check, ids[lo:hi][piece], pos + start[lo:hi][piece])

    def reduced(key, check, doc, pos):
        if not len(key):
            return
        order, group = _groups(key, check)
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        least = np.minimum.reduceat(doc[order], heads)
        keep = np.sort(order[doc[order] == least[group]])
        out: list[tuple] = []
        deal(_key_bucket(key[keep], n), KEYS, [_six(key[keep]), check[keep], doc[keep], pos[keep].astype(np.uint32)], out)
        yield block_batch(out)

    def settle(table: pa.Table) -> pa.Table:
        parts = [decode(b, np.uint8, np.uint32, np.int64, np.uint32) for b in binary_column(table, "block")]
        key, check, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, group = _groups(_from_six(key), check)
        least = np.minimum.reduceat(doc[order], np.flatnonzero(np.diff(group, prepend=-1)))
        alone = order[doc[order] == least[group]]
        out: list[tuple] = []
        _deal_positions(doc[alone], pos[alone], n, UNIQUE, out)
        return block_table(out)

    return regions.select("block").mapInArrow(emit, BLOCK).groupBy("bucket").applyInArrow(settle, BLOCK)


def _spans(regions: DataFrame) -> DataFrame:
    """The stretches without their text."""

    def strip(batches):
        for batch in batches:
            out = []
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
                who, start, count, *_ = _read_regions(block)
                out.append((bucket, REGIONS, encode(who, start, count)))
            yield block_batch(out)

    return regions.mapInArrow(strip, BLOCK)


def removed(rule: Rule, size: int, start: np.ndarray, count: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """Which of a document's symbols a repeated window covers (boolean, ``size`` long)."""
    change = np.zeros(size + 1, np.int32)
    hit = np.zeros(size + 1, bool)
    for s, c in zip(start.tolist(), count.tolist(), strict=True):
        hit[s : s + c - rule.width + 1] = True
    hit[unique[unique < size]] = False
    at = np.flatnonzero(hit[: max(size - rule.width + 1, 0)])
    change[at] += 1
    change[at + rule.width] -= 1
    return np.cumsum(change[:-1]) > 0


def repeats(docs: DataFrame, rule: Rule, finish, schema: str) -> DataFrame:
    """Apply ``finish(ids, data, offsets, covered)`` to blocks of whole documents.

    ``covered(i, size)`` gives document i's removed symbols, or None if there
    are none; ``finish`` returns an Arrow table of ``schema``.
    """
    n = bucket_count(docs)
    packed = packed_texts(docs, n)
    regions = materialize(_regions(packed, _sieve(docs, rule, n), rule, n), "regions")
    found = _spans(regions).unionByName(_windows(regions, rule, n))

    def last(texts: pa.Table, marks: pa.Table) -> pa.Table:
        where: dict[int, list] = {}
        if marks.num_rows:
            for kind, block in zip(marks.column("kind").to_pylist(), binary_column(marks, "block"), strict=True):
                if kind == REGIONS:
                    who, start, count = decode(block, np.int64, np.uint32, np.uint32)
                    for w, s, c in zip(who.tolist(), start.tolist(), count.tolist(), strict=True):
                        where.setdefault(w, []).append((s, c))
        doc, pos = _positions(marks, UNIQUE)
        out = []
        for ids, data, offsets in read_text(binary_column(texts, "block")):
            lo, hi = _rows_of(ids, doc)

            def covered(i: int, size: int, ids=ids, lo=lo, hi=hi):
                own = where.get(int(ids[i]))
                if not own or size < rule.width:
                    return None
                start, count = np.array(own, np.int64).T
                count = np.minimum(count, size - start)
                cover = removed(rule, size, start[count >= rule.width], count[count >= rule.width], pos[lo[i] : hi[i]])
                return cover if cover.any() else None

            out.append(finish(ids, data, offsets, covered))
        return pa.concat_tables(out)

    def whole(texts: pa.Table, marks: pa.Table) -> pa.Table:
        return last(texts, marks) if texts.num_rows else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return packed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(whole, schema)
