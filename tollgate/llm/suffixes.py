"""Suffix-array dedup: byte strings of a given length that occur twice or more.

Suffixes are sorted bucket by bucket (difference-cover blockwise construction):

1. A suffix's *bucket* follows from its first ``length`` bytes alone: the least
   hash of the grams of GRAM bytes in them. Equal strings so share a bucket, and
   neighbours mostly do, so a run of suffixes travels as one piece of text.
2. Equal pieces are one, first in each chunk of text, then in each bucket. What
   holds a gram that nothing else has is alone.
3. The rest of a bucket is sorted in blocks of whole grams by
   :mod:`tollgate.llm.blocksort`: bytes first, long ties by the ranks of the
   block's cover sample. Neighbours in that order are compared to ``length`` bytes.

A gram of very many places would make one bucket large. Such grams are counted
before; suffixes under them are dealt one by one, by fingerprints of 112 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.blocksort import Block
from tollgate.llm.common import BLOCK, binary_column, block_batch, block_table, bucket_count, bucket_of, deal, decode, documents, encode, materialize, mix, nullable_ids, ranges, text_columns
from tollgate.llm.cover import _from_six, _groups, _key_bucket, _six, difference_cover
from tollgate.llm.symbols import Bytes, Windows

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, text string"

#: Kinds of blocks.
PIECES, KEYS, HITS = 0, 1, 2
#: Bytes of a gram whose hash deals suffixes.
GRAM = 64
#: Grams with hashes below this are counted; 337 grams hold one but for a chance of 2e-5.
COUNTED = np.uint64(1 << 59)
#: Bytes of text hashed, of pieces dealt, and of pieces sorted, at a time.
CHUNK, WAITING, SORTED = 1 << 20, 24 << 20, 2 << 20
#: One in so many of a chunk's single grams is counted, as so many.
THINNED = 16
#: Most grams that are known as frequent on every worker, eight bytes each.
FREQUENT = 1_000_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _segments(offsets: np.ndarray, length: int):
    """(first document, last + 1, from, to): runs of whole documents of about CHUNK
    bytes, or parts of one long document that share length - 1 bytes."""
    for a, b in ranges(offsets, CHUNK):
        lo, hi = int(offsets[a]), int(offsets[b])
        while b == a + 1 and hi - lo > CHUNK + length:
            yield a, b, lo, lo + CHUNK
            lo += CHUNK - length + 1
        if hi - lo >= length:
            yield a, b, lo, hi


class _Chunk:
    """Gram hashes of some documents' text, and its runs of suffixes of one bucket."""

    def __init__(self, data: np.ndarray, gram: int):
        self.windows = Windows(Bytes().symbols(data, None)[0])
        p, n = self.windows.prefix, len(data) - gram + 1
        self.hash = mix((p[gram:] - p[:n]) * self.windows.inverse[:n])

    def runs(self, offsets: np.ndarray, length: int, gram: int):
        """Start and number of the suffixes of each run, their gram's hash, whether the
        run holds it twice, and where in the run it is (if it is one that is counted)."""
        wide = length - gram + 1
        low = sliding_least(self.hash, wide)
        n = len(low)
        mark = np.zeros(n + length + 1, np.int8)
        own = np.diff(offsets) >= length
        mark[offsets[:-1][own]] += 1
        mark[offsets[1:][own] - length + 1] -= 1
        valid = np.cumsum(mark[:n], dtype=np.int8) > 0
        same = valid[1:] & valid[:-1] & (low[1:] == low[:-1])
        start = np.flatnonzero(valid & ~np.concatenate([[False], same]))
        count = np.flatnonzero(valid & ~np.append(same, False)) + 1 - start
        value = low[start]
        at = np.flatnonzero(self.hash < COUNTED)
        kinds, group = np.unique(self.hash[at], return_inverse=True)
        place = np.sort(group.astype(np.int64) * (n + length) + at)
        known = np.minimum(np.searchsorted(kinds, value), max(len(kinds) - 1, 0)).astype(np.int64) * (n + length)
        first = np.searchsorted(place, known + start)
        held = np.searchsorted(place, known + start + count - 1 + wide) - first
        where = place[np.minimum(first, max(len(place) - 1, 0))] - known - start if len(place) else np.zeros(len(start), np.int64)
        return start, count, value, (value >= COUNTED) | (held > 1), np.where(value < COUNTED, where, 0).astype(np.uint32)


def frequent_grams(docs: DataFrame, gram: int, least: int) -> np.ndarray:
    """Hashes of counted grams with ``least`` places or more, over all documents, the
    FREQUENT most frequent at most. Single ones of a chunk are thinned by a hash,
    so a count is an estimate. It settles how a suffix is dealt and never what is
    found."""

    def count(batches):
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            for a, b, lo, hi in _segments(offsets, gram):
                grams = _Chunk(data[lo:hi], gram).hash
                found, first, n = np.unique(grams[grams < COUNTED], return_index=True, return_counts=True)
                thin = mix(found ^ np.uint64(int(ids[a]) & (1 << 64) - 1) ^ first.astype(np.uint64)) % np.uint64(THINNED) == 0
                n = np.where(n > 1, n, THINNED * thin)
                yield pa.RecordBatch.from_arrays([pa.array(found[n > 0].view(np.int64)), pa.array(n[n > 0], pa.int64())], ["gram", "n"])

    sums = docs.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = sums.orderBy(F.col("n").desc(), "gram").limit(FREQUENT).select("gram").toLocalIterator()
    return np.sort(np.array([r.gram for r in top], np.int64).view(np.uint64))


def _deal_hits(doc, tag, start, count, n: int, out: list) -> None:
    deal(bucket_of(doc, n), HITS, [doc, tag, start.astype(np.uint32), count.astype(np.uint32)], out)


def _emit(docs: DataFrame, length: int, gram: int, frequent: np.ndarray, n: int) -> DataFrame:
    """Pieces and keys for their buckets, and what chunks know already for the documents'."""

    def run(batches):
        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            tags = batch.column("tag").to_numpy().astype(np.uint32)
            for a, b, lo, hi in _segments(offsets, length):
                out: list[tuple] = []
                own = np.clip(offsets[a : b + 1], lo, hi) - lo
                waiting.append(chunk(ids[a:b], tags[a:b], lo - offsets[a] if b == a + 1 else 0, data[lo:hi], own, out))
                held += int(waiting[-1][1].sum()) + len(waiting[-1][1]) * length
                if held >= WAITING:
                    reduced(waiting, out)
                    waiting, held = [], 0
                if out:
                    yield block_batch(out)
        if waiting:
            out = []
            reduced(waiting, out)
            yield block_batch(out)

    def chunk(ids, tags, moved, data, offsets, out):
        own = _Chunk(data, gram)
        start, count, value, twice, where = own.runs(offsets, length, gram)
        doc = np.searchsorted(offsets, start, "right") - 1
        pos = start - offsets[doc] + moved
        if len(frequent):
            hot = frequent[np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)] == value
            if hot.any():
                keyed(own, data, start[hot], count[hot], ids[doc[hot]], tags[doc[hot]], pos[hot], out)
                start, count, value, twice, where, doc, pos = (x[~hot] for x in (start, count, value, twice, where, doc, pos))
        raw = data.tobytes()
        pieces = [raw[s : s + c] for s, c in zip(start.tolist(), (count + length - 1).tolist(), strict=True)]
        return value, count.astype(np.uint32), ids[doc], tags[doc], pos.astype(np.uint32), where, twice, pieces

    def reduced(waiting, out):
        """Deal pieces, equal ones once; that these are repeated is known here."""
        value, count, doc, tag, pos, where, twice = (np.concatenate([w[k] for w in waiting]) for k in range(7))
        first: dict[bytes, int] = {}
        same = np.array([first.setdefault(p, k) for k, p in enumerate(p for w in waiting for p in w[7])], np.int64)
        copies = np.bincount(same, minlength=len(same)) > 1
        known = np.flatnonzero(copies[same])
        _deal_hits(doc[known], tag[known], pos[known], count[known], n, out)
        pieces, head = list(first), np.fromiter(first.values(), np.int64, len(first))
        # The least of many hashes is small: mixed again, buckets are even.
        bucket = _key_bucket(mix(value[head]), n)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else []
        for x, y in zip(cut, cut[1:], strict=False):
            k = order[x:y]
            h = head[k]
            body = b"".join(pieces[i] for i in k.tolist())
            out.append((int(bucket[k[0]]), PIECES, encode(value[h], count[h], doc[h], tag[h], pos[h], where[h], copies[h], twice[h], np.frombuffer(body, np.uint8))))

    def keyed(own, data, start, count, ids, tags, pos, out):
        run = np.repeat(np.arange(len(start)), count)
        step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        at = start[run] + step
        key = own.windows(at, length)
        check = Windows(Bytes().symbols(data, None)[0], 1)(at, length)
        order, group = _groups(key, check)
        size = np.bincount(group)
        many = np.zeros(len(key), bool)
        many[order] = size[group] > 1
        head = order[np.flatnonzero(np.diff(group, prepend=-1))]
        _deal_hits(ids[run[many]], tags[run[many]], (pos[run] + step)[many], np.ones(int(many.sum())), n, out)
        deal(_key_bucket(key[head], n), KEYS, [_six(key[head]), check[head], many[head], ids[run[head]], tags[run[head]], (pos[run] + step)[head].astype(np.uint32)], out)

    return docs.mapInArrow(run, BLOCK)


def _settle_keys(blocks: list[bytes], n: int, out: list) -> None:
    if not blocks:
        return
    key, check, many, doc, tag, pos = (np.concatenate(x) for x in zip(*(decode(b, np.uint8, np.uint64, np.bool_, np.int64, np.uint32, np.uint32) for b in blocks), strict=True))
    order, group = _groups(_from_six(key), check)
    hit = order[(np.bincount(group)[group] > 1) & ~many[order]]
    _deal_hits(doc[hit], tag[hit], pos[hit], np.ones(len(hit)), n, out)


def _settle_pieces(blocks: list[bytes], length: int, gram: int, q: int, n: int, out: list) -> None:
    """Hits among a bucket's pieces, in blocks of whole grams."""
    if not blocks:
        return
    parts = [decode(b, np.uint64, np.uint32, np.int64, np.uint32, np.uint32, np.uint32, np.bool_, np.bool_, np.uint8) for b in blocks]
    value, count, doc, tag, pos, where, many, twice = (np.concatenate([p[k] for p in parts]) for k in range(8))
    count, home = count.astype(np.int64), np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    size = count + length - 1
    end = np.cumsum(size)
    bodies, base = [p[8] for p in parts], np.concatenate([[0], np.cumsum([len(p[8]) for p in parts])])
    start = end - size - base[home]
    order, group = _groups(value)
    members = np.bincount(group)
    # Alone under its gram: nothing else has it.
    keep = (members[group] > 1) | twice[order]
    order, group = order[keep], group[keep]
    cut = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else np.zeros(0, np.int64)
    hits: list[tuple] = []
    waiting: list[tuple[int, bytes, bool, int, int]] = []
    held, period = 0, difference_cover(q)[0]

    def flush() -> None:
        nonlocal held
        if waiting:
            hits.extend(_sorted_hits(waiting, gram, count, length, q))
            waiting.clear()
            held = 0

    for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        same: dict[bytes, list[int]] = {}
        for k in order[x:y].tolist():
            same.setdefault(bodies[home[k]][start[k] : start[k] + size[k]].tobytes(), []).append(k)
        unsure = any(twice[k[0]] for k in same.values())
        again = len(same) > 1 or unsure
        for piece, own in same.items():
            repeated = len(own) > 1 or bool(many[own[0]])
            if len(own) > 1:
                hits += [(k, 0, int(count[k])) for k in own if not many[k]]
            if again:
                # Filled up so that a gram's places have one residue: one shift then fits them all.
                piece = bytes(-(held + int(where[own[0]])) % period) + piece
                waiting.append((own[0], piece, repeated, x, -1 if unsure else int(where[own[0]])))
                held += len(piece)
        if held >= SORTED:
            flush()
    flush()
    if hits:
        k, step, run = (np.array(x, np.int64) for x in zip(*hits, strict=True))
        _deal_hits(doc[k], tag[k], pos[k] + step, run, n, out)


def _sorted_hits(waiting: list[tuple[int, bytes, bool, int, int]], gram: int, count: np.ndarray, length: int, q: int) -> list[tuple]:
    """(piece, first suffix, number of suffixes) of runs of repeated suffixes, of
    those pieces that aren't known to be repeated as a whole."""
    text = np.frombuffer(b"".join(x[1] for x in waiting), np.uint8)
    many = count[[x[0] for x in waiting]]
    base = np.cumsum([len(x[1]) for x in waiting]) - many - length + 1
    number = np.unique([x[3] for x in waiting], return_inverse=True)[1]
    where = np.array([x[4] for x in waiting])
    own = np.repeat(np.arange(len(waiting)), many)
    step = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    # Equal suffixes have their gram in one place, if they hold it once.
    bucket = number[own] * (length - gram + 1) + np.where(where[own] < 0, 0, where[own] - step)
    at, number = Block(text, length, q).classes(base[own] + step, bucket)
    hit = np.zeros(len(text) + 1, bool)
    hit[at[np.bincount(number)[number] > 1]] = True
    out = []
    for (k, _, known, *_), b, m in zip(waiting, base.tolist(), many.tolist(), strict=True):
        if not known:
            own = hit[b : b + m]
            if own.all():
                out.append((k, 0, m))
            elif own.any():
                edge = np.flatnonzero(np.diff(own.view(np.int8), prepend=0, append=0)).tolist()
                out += [(k, s, e - s) for s, e in zip(edge[::2], edge[1::2], strict=True)]
    return out


def _packed(docs: DataFrame, n: int) -> DataFrame:
    """Whole texts with their tags, as blocks for their documents' buckets."""

    def pack(batches):
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            tags = batch.column("tag").to_numpy().astype(np.uint32)
            for lo, hi in ranges(offsets, 4 << 20):
                bucket, out = bucket_of(ids[lo:hi], n), []
                raw = data[offsets[lo] : offsets[hi]].tobytes()
                at = offsets[lo : hi + 1] - offsets[lo]
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                for x, y in zip(cut, cut[1:], strict=False):
                    k = order[x:y]
                    body = b"".join(raw[at[i] : at[i + 1]] for i in k.tolist())
                    out.append((int(bucket[k[0]]), 0, encode(ids[lo + k], tags[lo + k], np.diff(at)[k], np.frombuffer(body, np.uint8))))
                yield block_batch(out)

    return docs.mapInArrow(pack, BLOCK)


def covered(size: int, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` bytes lie in a repeated string: ``count`` of them start at each ``start`` and on."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + count + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def suffix_dedup(docs: DataFrame, length: int = 400, q: int = 5, frequent: int = 5000, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts
    anywhere else, in the same document or another.

    See the module's text for the method: ``q`` sets the difference cover (period
    q^2 + q + 1); a gram with about ``frequent`` places or more has its suffixes
    dealt one by one.

    Returns one row per document: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and the remaining bytes (``text``; a character that lost some
    of its bytes is dropped there) or their ``kept_sha256`` with ``digest``.

    Null text is empty. Overlapping occurrences count. Rows that share an id are
    told apart by their texts; rows that share both are copies of each other.
    Other columns are ignored. An empty table gives an empty result.
    """
    gram, last = min(GRAM, max(8, length // 2)), "kept_sha256" if digest else "text"
    docs = documents(docs, id_col, text_col).withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0xFFFFFFFF))
    n = bucket_count(docs)
    hot = frequent_grams(docs, gram, frequent)

    def settle(t: pa.Table) -> pa.Table:
        by: dict[int, list[bytes]] = {PIECES: [], KEYS: [], HITS: []}
        for kind, block in zip(t.column("kind").to_pylist(), binary_column(t, "block"), strict=True):
            by[kind].append(block)
        bucket = t.column("bucket")[0].as_py()
        out = [(bucket, HITS, b) for b in by[HITS]]
        _settle_keys(by[KEYS], n, out)
        _settle_pieces(by[PIECES], length, gram, q, n, out)
        return block_table(out)

    # Written, so that the pieces' shuffle is gone before the texts are dealt.
    found = materialize(_emit(docs, length, gram, hot, n).groupBy("bucket").applyInArrow(settle, BLOCK), "hits")

    def finish(texts: pa.Table, marks: pa.Table) -> pa.Table:
        where: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for block in binary_column(marks, "block") if marks.num_rows else []:
            for d, g, s, c in zip(*(x.tolist() for x in decode(block, np.int64, np.uint32, np.uint32, np.uint32)), strict=True):
                where.setdefault((d, g), []).append((s, c))
        made: list[list] = [[], [], [], [], []]
        for block in binary_column(texts, "block") if texts.num_rows else []:
            ids, tags, sizes, data = decode(block, np.int64, np.uint32, np.int64, np.uint8)
            ends = np.cumsum(sizes)
            for d, g, size, end in zip(ids.tolist(), tags.tolist(), sizes.tolist(), ends.tolist(), strict=True):
                body, gone, spans = data[end - size : end], 0, 0
                if own := where.get((d, g)):
                    cover = covered(size, *np.array(own, np.int64).T, length)
                    gone, spans = int(cover.sum()), int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                    body = body[~cover]
                kept = body.tobytes()
                for column, x in zip(made, (d, size, gone, spans, hashlib.sha256(kept).hexdigest() if digest else kept.decode(errors="ignore")), strict=True):
                    column.append(x)
        return pa.table({"doc_id": nullable_ids(np.array(made[0], np.int64)), **{k: pa.array(x, pa.int64()) for k, x in zip(("n_bytes", "n_removed", "n_spans"), made[1:], strict=False)}, last: pa.array(made[4], pa.string())})

    return _packed(docs, n).groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(finish, SCHEMA.replace("text", last))
