"""Document likelihood by a subword lattice.

A text is a sequence of words and one end. Each token is drawn from the
training counts, absolutely discounted; the mass taken away goes to a lattice
over a public subword vocabulary, in which a word's probability is the sum over
all its segmentations. So every word arc and every segmentation of every word
is in one lattice. A document's own token distribution is drawn around this one
(Dirichlet), and the score is the marginal probability of the document over all
segmentations and all such distributions, in log space.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import BLOCK, NULL_ID, binary_column, block_table, bucket_count, decode, documents, encode, materialize, nullable_ids, packed_texts, read_text
from tollgate.llm.symbols import hash_words, word_spans
from tollgate.llm.tokens import default_path

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are taken one by one.
LONG = 512


def piece_bytes(token: str) -> bytes:
    """The bytes of a byte-level BPE token; its alphabet shows printable bytes as
    themselves and the others, in order, from U+0100 on."""
    return bytes(map(_alphabet().__getitem__, token))


@lru_cache(maxsize=1)
def _alphabet() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Lattice:
    """All segmentations of words into the pieces of a vocabulary file.

    A word is spelled with a space in front, as the vocabulary has it, and ends
    with an end mark; only pieces without an inner space take part.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        pieces = {}
        for token, i in vocabulary.items():
            if all(c in _alphabet() for c in token) and b" " not in (p := piece_bytes(token))[1:]:
                pieces[p] = i
        for b in range(256):
            pieces.setdefault(bytes([b]), len(vocabulary) + b)
        ordered = sorted(pieces, key=pieces.__getitem__)
        self.pieces = ordered
        self.end = len(ordered)
        self.longest = max(map(len, ordered))
        edges: dict[int, int] = {}
        marks = [-1]
        for i, p in enumerate(ordered):
            node = 0
            for b in p:
                key = (node << 8 | b) + 1
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(marks)
                    marks.append(-1)
            marks[node] = i
        self.mark = np.array(marks, np.int32)
        bits = max(4, int(len(edges) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key, self.next = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        keys, nodes = np.array(list(edges), np.uint64), np.array(list(edges.values()), np.int32)
        slot = ((keys * _MULTIPLIER) >> self.shift).astype(np.int64)
        while len(keys):
            # Of those that want a free slot, the first gets it; the rest move on by one.
            free = self.key[slot] == 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(slot), bool)
            won[first] = True
            won &= free
            self.key[slot[won]], self.next[slot[won]] = keys[won], nodes[won]
            keys, nodes, slot = keys[~won], nodes[~won], (slot[~won] + 1) & ((1 << bits) - 1)

    def start(self) -> np.ndarray:
        """Log probabilities by the vocabulary's own order (Zipf), with the end mark."""
        p = 1.0 / (np.arange(len(self.pieces) + 1) + 2.0)
        p[self.end] = p.sum() / 3
        return np.log(p / p.sum())

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = ((node.astype(np.uint64) << np.uint64(8)) | byte) + np.uint64(1)
        slot = ((key * _MULTIPLIER) >> self.shift).astype(np.int64)
        have = self.key[slot]
        out = np.where(have == key, self.next[slot], 0)
        open_ = np.flatnonzero((have != key) & (have != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.key) - 1)
            have = self.key[slot[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (have != 0)]
        return out

    def _arcs(self, text: np.ndarray, size: np.ndarray):
        """(start, end, words, pieces) of every arc of a padded batch, by ascending start."""
        for s in range(text.shape[1]):
            own = np.flatnonzero(size > s)
            node = np.zeros(len(own), np.int32)
            for at in range(s, min(s + self.longest, text.shape[1])):
                if at > s:
                    longer = size[own] > at
                    own, node = own[longer], node[longer]
                node = self._step(node, text[own, at])
                alive = node > 0
                own, node = own[alive], node[alive]
                if not len(own):
                    break
                mark = self.mark[node]
                has = mark >= 0
                if has.any():
                    yield s, at + 1, own[has], mark[has]

    def _batches(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray):
        order, at = np.argsort(size, kind="stable"), 0
        order = order[size[order] <= LONG]
        padded = np.concatenate([data, np.zeros(1, np.uint8)])
        while at < len(order):
            # As many words of ascending size as keep the padded batch small.
            to, step = at + 1, 1
            while to < len(order) and (to + step - at) * (int(size[order[min(to + step, len(order)) - 1]]) + 1) <= 300_000:
                to = min(to + step, len(order))
                step *= 2
            own = order[at:to]
            n, top = size[own], int(size[own[-1]])
            text = np.zeros((len(own), top + 1), np.uint8)
            text[:, 0] = 32
            column = np.arange(top)
            text[:, 1:] = padded[np.minimum(starts[own][:, None] + column, len(data))]
            yield own, text, n + 1
            at = to

    def log_probabilities(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Natural-log marginal probability of each word, by the forward recursion."""
        out = np.zeros(len(size))
        for own, text, n in self._batches(data, starts, size):
            alpha = np.full((len(own), text.shape[1] + 1), -np.inf)
            alpha[:, 0] = 0
            for s, e, words, marks in self._arcs(text, n):
                alpha[words, e] = np.logaddexp(alpha[words, e], alpha[words, s] + logp[marks])
            out[own] = alpha[np.arange(len(own)), n] + logp[self.end]
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = self._forward(_spelled(data, starts[k], size[k]), logp)[-1] + logp[self.end]
        return out

    def expected(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected piece counts over words that each count once (forward-backward)."""
        total = np.zeros(len(self.pieces) + 1)
        for own, text, n in self._batches(data, starts, size):
            rows = np.arange(len(own))
            alpha = np.full((len(own), text.shape[1] + 1), -np.inf)
            beta = alpha.copy()
            alpha[:, 0] = 0
            arcs = list(self._arcs(text, n))
            for s, e, words, marks in arcs:
                alpha[words, e] = np.logaddexp(alpha[words, e], alpha[words, s] + logp[marks])
            beta[rows, n] = 0
            whole = alpha[rows, n]
            for s, e, words, marks in reversed(arcs):
                out = logp[marks] + beta[words, e]
                beta[words, s] = np.logaddexp(beta[words, s], out)
            for s, e, words, marks in arcs:
                total += np.bincount(marks, np.exp(alpha[words, s] + logp[marks] + beta[words, e] - whole[words]), len(total))
            total[self.end] += len(own)
        for k in np.flatnonzero(size > LONG).tolist():
            text = _spelled(data, starts[k], size[k])
            alpha, beta = self._forward(text, logp), np.full(len(text) + 1, -np.inf)
            beta[-1] = 0
            for lo in range((len(text) - 1) // _PART * _PART, -1, -_PART):
                s, e, marks = self._arcs_from(text, lo, min(lo + _PART, len(text)))
                value, cut = logp[marks], np.searchsorted(s, np.arange(lo, min(lo + _PART, len(text)) + 1)).tolist()
                for at in range(len(cut) - 2, -1, -1):
                    a, b = cut[at], cut[at + 1]
                    beta[lo + at] = np.logaddexp.reduce(value[a:b] + beta[e[a:b]])
                total += np.bincount(marks, np.exp(alpha[s] + value + beta[e] - alpha[-1]), len(total))
            total[self.end] += 1
        return total

    def _arcs_from(self, text: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of the arcs of one word that start in a range, by start."""
        own, node, out = np.arange(lo, hi), np.zeros(hi - lo, np.int32), []
        for k in range(self.longest):
            inside = own + k < len(text)
            own, node = own[inside], node[inside]
            node = self._step(node, text[own + k])
            own, node = own[node > 0], node[node > 0]
            if not len(own):
                break
            has = self.mark[node] >= 0
            out.append((own[has], own[has] + k + 1, self.mark[node[has]]))
        s, e, marks = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(s, kind="stable")
        return s[order], e[order], marks[order]

    def _forward(self, text: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log mass of all segmentations up to each byte of one long word; arcs are
        looked up for a part of it at a time."""
        alpha = np.full(len(text) + 1, -np.inf)
        alpha[0] = 0
        for lo in range(0, len(text), _PART):
            s, e, marks = self._arcs_from(text, lo, min(lo + _PART, len(text)))
            value, cut = logp[marks], np.searchsorted(s, np.arange(lo, min(lo + _PART, len(text)) + 1)).tolist()
            for at, (a, b) in enumerate(zip(cut, cut[1:], strict=False), lo):
                to = e[a:b]
                alpha[to] = np.logaddexp(alpha[to], alpha[at] + value[a:b])
        return alpha


#: Bytes of a long word at a time.
_PART = 1 << 15


def _spelled(data: np.ndarray, start: int, size: int) -> np.ndarray:
    return np.concatenate([np.array([32], np.uint8), data[start : start + size]])


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def trains(ids: np.ndarray, folds: int, fold: int) -> np.ndarray:
    """Which documents are learned from; a null id is."""
    return np.array([i == NULL_ID or zlib.crc32(str(i).encode()) % folds != fold for i in ids.tolist()], bool)


def urn(doc: np.ndarray, word: np.ndarray, value: np.ndarray, size: np.ndarray, prior: float) -> np.ndarray:
    """log10 marginal probability of each document's tokens (all but the end,
    which comes once) when its distribution is Dirichlet around 10**value with
    weight ``prior``: a token's j-th repetition counts prior * p + j.
    """
    order = np.lexsort((word, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (word[order][1:] != word[order][:-1])
    at = np.arange(len(order))
    again = at - np.maximum.accumulate(np.where(new, at, 0))
    own = value[word[order]]
    first = math.log10(prior) + own
    with np.errstate(under="ignore"):
        gain = np.where(again == 0, first, np.log10(np.maximum(again, 1) + prior * 10.0**own))
    total = np.bincount(doc[order], gain, len(size))
    steps = np.concatenate([[0], np.cumsum(np.log10(prior + np.arange(int(size.max(initial=0)))))])
    return total - steps[size]


def _words(texts: list[bytes]):
    """Of all text blocks of a bucket: ids, words per document, word hashes, and the words' places."""
    ids, count, hashes, body, starts, ends, at = [], [], [], [], [], [], 0
    for own, data, offsets in read_text(texts):
        data = _LOWER[data]
        s, e, first = word_spans(data, offsets)
        ids.append(own)
        count.append(np.diff(first))
        hashes.append(hash_words(data, s, e))
        starts.append(s + at)
        ends.append(e + at)
        body.append(data)
        at += len(data)
    return tuple(np.concatenate(x) for x in (ids, count, hashes, body, starts, ends))


def _key_order(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets of sorted distinct hashes: ascending, since the bucket is the hash's top part."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


VOCABULARY = "bucket int, words binary, lists binary, total long, kinds long, once long, twice long"


def _vocabulary(packed: DataFrame, n: int, folds: int, fold: int) -> DataFrame:
    """All words of all documents, dealt by hash, with their training counts, and
    for each document bucket which of them it has."""

    def ask(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        ids, count, h, data, starts, ends = _words(binary_column(t, "block"))
        train = np.repeat(trains(ids, folds, fold), count)
        kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
        known = np.bincount(back[train], minlength=len(kinds))
        to = _key_order(kinds, n)
        size, raw, out = ends[first] - starts[first], data.tobytes(), []
        cut = np.searchsorted(to, np.arange(n + 1))
        for b in np.unique(to).tolist():
            lo, hi = int(cut[b]), int(cut[b + 1])
            body = b"".join(raw[x:y] for x, y in zip(starts[first[lo:hi]].tolist(), ends[first[lo:hi]].tolist(), strict=True))
            out.append((b, bucket, encode(known[lo:hi].astype(np.uint32), size[lo:hi].astype(np.uint32), np.frombuffer(body, np.uint8))))
        return block_table(out)

    def gather(t: pa.Table) -> pa.Table:
        asked = t.column("kind").to_pylist()
        parts = [decode(b, np.uint32, np.uint32, np.uint8) for b in binary_column(t, "block")]
        known, size, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum(size, dtype=np.int64)
        starts = ends - size
        kinds, first, back = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
        count = np.rint(np.bincount(back, known.astype(np.float64), len(kinds))).astype(np.int64)
        raw = data.tobytes()
        body = b"".join(raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True))
        words = encode(count, size[first], np.frombuffer(body, np.uint8))
        lists = encode(np.array(asked, np.int32), np.array([len(p[0]) for p in parts], np.int64), back.astype(np.uint32))
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "words": pa.array([words], pa.binary()), "lists": pa.array([lists], pa.binary()), "total": [int(count.sum())], "kinds": [int((count > 0).sum())], "once": [int((count == 1).sum())], "twice": [int((count == 2).sum())]})

    return packed.groupBy("bucket").applyInArrow(ask, BLOCK).groupBy("bucket").applyInArrow(gather, VOCABULARY)


def _read_words(block: bytes):
    count, size, data = decode(block, np.int64, np.uint32, np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    return count, data, ends - size, size.astype(np.int64)


def train_pieces(vocabulary: DataFrame, path: str, steps: int, floor: float = 0.01) -> np.ndarray:
    """Piece scores: the vocabulary's order, then ``steps`` of expectation
    maximisation over every distinct training word. The sums that come to the
    driver are as many as the vocabulary has pieces."""
    logp = lattice(path).start()
    for _ in range(steps):

        def count(batches, logp=logp):
            model, total = lattice(path), None
            for batch in batches:
                for block in batch.column("words").to_pylist():
                    known, data, starts, size = _read_words(block)
                    own = np.flatnonzero(known > 0)
                    new = model.expected(data, starts[own], size[own], logp)
                    total = new if total is None else total + new
            if total is not None:
                own = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], ["piece", "value"])

        sums = vocabulary.select("words").mapInArrow(count, "piece int, value double").groupBy("piece").agg(F.sum("value").alias("value")).collect()
        p = np.full(len(logp), floor)
        for row in sums:
            p[row.piece] += row.value
        logp = np.log(p / p.sum())
    return logp


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"


def lattice_scores(docs: DataFrame, folds: int = 7, fold: int = 2, tokenizer: str | None = None, steps: int = 2, prior: float = 3000.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text; learn from documents whose crc32(id as text) mod
    ``folds`` is not ``fold``.

    A-Z are lower-cased; tokens are words ``[^\\x20\\x09-\\x0D]+`` and one end.
    ``base_score``: add-one word unigram, log10. ``lattice_score``: log10 of the
    document's marginal probability over all segmentations. ``score``: the same
    over all token distributions around the lattice's besides, where ``prior`` is
    how many tokens the corpus weighs against the document's own. All counts
    cover all training documents. Words of any length are spelled by all pieces;
    the time for one grows in proportion to its bytes.

    Null or empty text: the end alone. A null id is learned from. Rows that
    share an id are all scored, and all learned from if one is. No training
    documents: counts are zero and the vocabulary's order gives the scores.
    Other columns are ignored. An empty table gives no rows.
    """
    path = tokenizer or default_path()
    docs = documents(docs, id_col, text_col)
    n = max(1, bucket_count(docs))
    packed = packed_texts(docs, n)
    vocabulary = materialize(_vocabulary(packed, n, folds, fold), "vocabulary")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    ends = docs.agg(F.count(F.when(F.coalesce(rest != fold, F.lit(True)), 1))).first()[0]
    sums = vocabulary.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "kinds", "once", "twice"))).first()
    total, kinds = sums[0] + ends, sums[1] + (ends > 0)
    once, twice = sums[2] + (ends == 1), sums[3] + (ends == 2)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    logp = train_pieces(vocabulary, path, steps if kinds > (ends > 0) else 0)
    spare = discount * kinds / total if total else 0.5

    def answer(batches):
        for batch in batches:
            for words, lists in zip(batch.column("words").to_pylist(), batch.column("lists").to_pylist(), strict=True):
                count, data, starts, size = _read_words(words)
                spelled = lattice(path).log_probabilities(data, starts, size, logp)
                with np.errstate(divide="ignore"):
                    direct = np.log(np.maximum(count - discount, 0) / total) if total else np.full(len(count), -np.inf)
                score = np.logaddexp(direct, math.log(spare) + spelled) / math.log(10)
                asked, many, which = decode(lists, np.int32, np.int64, np.uint32)
                cut, bucket, out = np.concatenate([[0], np.cumsum(many)]), batch.column("bucket"), []
                for k, to in enumerate(asked.tolist()):
                    own = which[cut[k] : cut[k + 1]]
                    out.append((to, bucket[0].as_py(), encode(count[own].astype(np.uint32), score[own])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "kind", "block"])

    one = vocabulary.select("bucket", "words", "lists")

    def single(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from answer([batch.slice(i, 1)])

    answers = one.mapInArrow(single, BLOCK)
    end_score = math.log10(max(ends - discount, 0) / total) if ends > discount else math.log10(0.5)
    end_base = math.log10((ends + 1) / (total + kinds + 1))

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return empty
        ids, many, h, *_ = _words(binary_column(texts, "block"))
        known, value = np.zeros(0, np.int64), np.zeros(0)
        kinds_here, back = np.unique(h, return_inverse=True)
        if found.num_rows:
            parts = sorted(zip(found.column("kind").to_pylist(), binary_column(found, "block"), strict=True), key=lambda x: x[0])
            known, value = (np.concatenate(x) for x in zip(*(decode(b, np.uint32, np.float64) for _, b in parts), strict=True))
        known = known.astype(np.int64)
        if len(known) != len(kinds_here):
            raise RuntimeError("a document bucket's words and answers differ")
        base = np.log10((known + 1) / (total + kinds + 1))
        doc = np.repeat(np.arange(len(ids)), many)
        held = ~trains(ids, folds, fold)
        return pa.table({
            "doc_id": nullable_ids(ids),
            "held_out": pa.array(held),
            "n_tokens": pa.array(many + 1, pa.int64()),
            "n_known": pa.array(np.bincount(doc, (known > 0)[back], len(ids)).astype(np.int64) + int(ends > 0)),
            "train_tokens": pa.array(np.full(len(ids), total), pa.int64()),
            "base_score": pa.array(np.bincount(doc, base[back], len(ids)) + end_base),
            "score": pa.array(urn(doc, back, value, many + 1, prior) + math.log10(prior) + end_score),
            "lattice_score": pa.array(np.bincount(doc, value[back], len(ids)) + end_score),
        })

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(SCORES)).empty_table()
    return packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, SCORES)
