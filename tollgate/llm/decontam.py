"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus are TF-IDF vectors over the benchmark's own words. A
distributed randomised SVD of all passages gives a latent space. Candidates are
the windows that hold one of an item's rarest terms; they are ordered by cosine
there, and settled by a longest common subsequence and by whether the item's
informative words (its answer) are there.

Words outside the benchmark change none of these measures, so the first pass
keeps only the places of benchmark words, and everything after it works on
that small table.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import NULL_ID, decode, documents, encode, materialize, ranges, text_columns
from tollgate.llm.symbols import hash_words, word_spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum()]] = True

#: Words of a corpus passage, and the unit of search windows in words.
PASSAGE, STRIDE = 64, 8
#: Benchmark items longer than a passage are compared piece by piece; those of
#: at most SHORT words with windows of half a passage.
PIECE, SHORT = 48, 24


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[data]
    starts, ends, first = word_spans(data, offsets, _SEPARATOR)
    return hash_words(data, starts, ends), first


class Items:
    """A block of benchmark items: their pieces as sequences of term numbers."""

    def __init__(self, ids: list[int], texts: list[str]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        h, first = _word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.terms, number = np.unique(h, return_inverse=True)
        self.item, self.pieces = [], []
        for i, item in enumerate(ids):
            words = number[first[i] : first[i + 1]]
            parts = 1 if len(words) <= PASSAGE else -(-len(words) // PIECE)
            for part in np.array_split(words, parts):
                if len(part):
                    self.item.append(item)
                    self.pieces.append(part)
        bits = max(16, int(len(self.terms)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[(self.terms >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and term numbers of the benchmark's words in a sequence."""
        at = np.flatnonzero(self.sieve[(h >> self.shift).astype(np.int64)])
        own = h[at]
        i = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        hit = self.terms[i] == own
        return at[hit], i[hit]


def _places(docs: DataFrame, items: Items) -> DataFrame:
    """Blocks of documents: ids, words, benchmark words, and these words' places and numbers."""

    def run(batches):
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            for lo, hi in ranges(offsets, 4 << 20):
                h, first = _word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at, term = items.find(h)
                cut = np.searchsorted(at, first)
                pos = at - np.repeat(first[:-1], np.diff(cut))
                step = np.diff(pos, prepend=0)
                step[cut[:-1][np.diff(cut) > 0]] = pos[cut[:-1][np.diff(cut) > 0]]
                yield pa.RecordBatch.from_arrays([pa.array([encode(ids[lo:hi], np.diff(first), np.diff(cut).astype(np.uint32), step.astype(np.uint32), term.astype(np.uint32))], pa.binary())], ["block"])

    return docs.mapInArrow(run, "block binary")


def _read(block: bytes):
    """ids, words and first token of each document; position and term of each token."""
    ids, words, count, step, term = decode(block, np.int64, np.int64, np.uint32, np.uint32, np.uint32)
    first = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    total = np.cumsum(step, dtype=np.int64)
    has = count > 0
    base = np.zeros(len(count), np.int64)
    base[has] = total[first[:-1][has]] - step[first[:-1][has]]
    return ids, words, first, total - np.repeat(base, count), term.astype(np.int64)


def _passages(first: np.ndarray, words: np.ndarray, pos: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each token's passage in the block, and each document's first passage."""
    start = np.concatenate([[0], np.cumsum(-(-words // size))])
    return np.repeat(start[:-1], np.diff(first)) + pos // size, start


def _sum_blocks(df: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Sums of (slot, binary doubles) rows by slot; the slots are few by construction."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in t.column("part").to_pylist())
        return pa.table({"slot": pa.array([t.column("slot")[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    summed = df.groupBy("slot").applyInArrow(add, "slot int, part binary")
    return {r.slot: np.frombuffer(bytes(r.part), np.float64).reshape(-1, width) for r in summed.collect()}


SLICE = 512


def _emit(matrix: np.ndarray):
    """A matrix in slices of rows, so that its sums are dealt over tasks."""
    slots = range(0, len(matrix), SLICE)
    return pa.RecordBatch.from_arrays([pa.array([s // SLICE for s in slots], pa.int32()), pa.array([matrix[s : s + SLICE].astype(np.float64).tobytes() for s in slots], pa.binary())], ["slot", "part"])


def _whole(parts: dict[int, np.ndarray], rows: int, width: int) -> np.ndarray:
    return np.concatenate([parts[k] for k in sorted(parts)]) if parts else np.zeros((rows, width))


def _frequencies(places: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Passages that hold each term, over all documents, and all passages."""

    def run(batches):
        total, passages = np.zeros((n, 1)), 0
        for batch in batches:
            for block in batch.column("block").to_pylist():
                _, words, first, pos, term = _read(block)
                at, start = _passages(first, words, pos, PASSAGE)
                passages += int(start[-1])
                # A table of some passages by all terms, as large as memory allows.
                step = max(1, (8 << 20) // max(n, 1))
                cut = np.searchsorted(at, np.arange(0, int(start[-1]) + step, step))
                for k, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
                    if hi > lo:
                        have = np.zeros((int(at[hi - 1]) - k * step + 1, n), bool)
                        have[at[lo:hi] - k * step, term[lo:hi]] = True
                        total[:, 0] += have.sum(axis=0)
        yield _emit(np.concatenate([total, [[passages]]]))

    sums = _whole(_sum_blocks(places.mapInArrow(run, "slot int, part binary"), 1), n + 1, 1)
    return sums[:n, 0], int(sums[n, 0])


def _matrix(block: bytes, idf: np.ndarray):
    """Non-zeros of the block's TF-IDF passages of unit length: passage, term, weight."""
    _, words, first, pos, term = _read(block)
    at, start = _passages(first, words, pos, PASSAGE)
    keep = idf[term] > 0
    at, term = at[keep], term[keep]
    weight = idf[term]
    norm = np.sqrt(np.bincount(at, weight**2, int(start[-1])))
    return at, term, (weight / norm[at] if len(at) else weight).astype(np.float32)


def _rows_times(at: np.ndarray, term: np.ndarray, weight: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages that have terms, and their rows times a dense matrix."""
    heads = np.flatnonzero(np.diff(at, prepend=-1))
    return at[heads], np.add.reduceat(dense[term] * weight[:, None], heads, axis=0) if len(heads) else np.zeros((0, dense.shape[1]))


def latent_space(places: DataFrame, idf: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms by rank) of all TF-IDF passages: a random
    range, one power step and a small exact decomposition."""
    n, r = len(idf), min(rank + 8, len(idf))
    omega = np.random.default_rng(seed).standard_normal((n, r)).astype(np.float32)

    def power(batches):
        total = np.zeros((n, r))
        for batch in batches:
            for block in batch.column("block").to_pylist():
                at, term, weight = _matrix(block, idf)
                which, y = _rows_times(at, term, weight, omega)
                order = np.argsort(term, kind="stable")
                heads = np.flatnonzero(np.diff(term[order], prepend=-1))
                if len(heads):
                    place = np.searchsorted(which, at[order])
                    total[term[order][heads]] += np.add.reduceat(y[place] * weight[order][:, None], heads, axis=0)
        yield _emit(total)

    z = _whole(_sum_blocks(places.mapInArrow(power, "slot int, part binary"), r), n, r)
    q, _ = np.linalg.qr(z)
    q = np.ascontiguousarray(q)
    narrow = q.astype(np.float32)

    def gram(batches):
        total = np.zeros((r, r))
        for batch in batches:
            for block in batch.column("block").to_pylist():
                y = _rows_times(*_matrix(block, idf), narrow)[1]
                total += (y.T @ y).astype(np.float64)
        yield _emit(total)

    g = _whole(_sum_blocks(places.mapInArrow(gram, "slot int, part binary"), r), r, r)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    return q @ vectors[:, ::-1][:, : min(rank, int((values > 1e-9).sum()) or 1)]


def common_subsequence(masks: dict[int, int], sequence: list[int], size: int) -> int:
    """Length of the longest common subsequence with a sequence whose terms'
    places are given as bit masks (bit-parallel)."""
    full = (1 << size) - 1
    v = full
    for t in sequence:
        u = v & masks.get(t, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, start_word long"


def _search(places: DataFrame, items: Items, idf: np.ndarray, space: np.ndarray, lcs: float, answer: float) -> DataFrame:
    latent = (space * idf[:, None]).astype(np.float32)
    queries = np.stack([latent[p].sum(axis=0) for p in items.pieces])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    masks, known, keys = [], [], []
    for k, p in enumerate(items.pieces):
        own: dict[int, int] = {}
        for i, t in enumerate(p.tolist()):
            own[t] = own.get(t, 0) | 1 << i
        masks.append(own)
        informative = sorted((t for t in own if idf[t] > 0), key=lambda t: -idf[t])
        total = float(sum(idf[t] for t in informative))
        known.append((set(informative), total))
        # Without all of these rarest terms, what is left can't pass the answer check.
        missing = 0.0
        for t in informative:
            if missing > (1 - answer) * total:
                break
            missing += idf[t]
            keys.append((t, k))
    keys.sort()
    key_term, key_piece = (np.array(x, np.int64) for x in zip(*keys, strict=True))
    key_first = np.searchsorted(key_term, np.arange(len(idf) + 1))
    sizes = np.array([len(p) for p in items.pieces])
    #: Units of the windows that a piece is compared with.
    units = np.where(sizes <= SHORT, PASSAGE // 2 // STRIDE, PASSAGE // STRIDE)

    def run(batches):
        for batch in batches:
            for block in batch.column("block").to_pylist():
                ids, words, first, pos, term = _read(block)
                at, start = _passages(first, words, pos, STRIDE)
                # Windows around every key term of every piece.
                many = np.diff(key_first)[term]
                token = np.repeat(np.arange(len(term)), many)
                if not len(token):
                    continue
                piece = key_piece[np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + key_first[term[token]]]
                near = np.unique(np.stack([at[token], piece]), axis=1)
                unit, piece = near
                x = np.zeros((int(start[-1]) + 1, latent.shape[1]), np.float32)
                keep = idf[term] > 0
                which, sums = _rows_times(at[keep], term[keep], np.ones(int(keep.sum()), np.float32), latent)
                x[1:][which] = sums
                x = np.cumsum(x, axis=0, dtype=np.float64)
                doc = np.searchsorted(start, unit, "right") - 1
                best: dict[tuple[int, int], tuple] = {}
                for lo in range(0, len(unit), 8192):
                    u, k, d = unit[lo : lo + 8192], piece[lo : lo + 8192], doc[lo : lo + 8192]
                    value, where = np.full(len(u), -1.0), u.copy()
                    for back in range(int(units.max())):
                        a = np.maximum(u - back, start[d])
                        b = np.minimum(a + units[k], start[d + 1])
                        v = x[b] - x[a]
                        c = np.einsum("ij,ij->i", v, queries[k]) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)
                        better = (back < units[k]) & (c > value)
                        value[better], where[better] = c[better], a[better]
                    # Whatever the cosine: it only tells which window is looked at first.
                    for j in range(len(u)):
                        i, piece_no, own_doc = int(where[j]), int(k[j]), int(d[j])
                        key = (own_doc, items.item[piece_no])
                        if key in best and best[key][2] >= 1.0:
                            continue
                        size, wide = int(sizes[piece_no]), int(units[piece_no])
                        base, f, g = int(start[own_doc]), int(first[own_doc]), int(first[own_doc + 1])
                        informative, total = known[piece_no]
                        least = max(lcs, 0.9) if size < 8 else lcs

                        def checked(low: int, high: int) -> tuple[float, float]:
                            """Shares of the answer and of the common subsequence between two units;
                            the latter is 0 where the first is too small."""
                            lo, hi = f + int(np.searchsorted(pos[f:g], STRIDE * (low - base))), f + int(np.searchsorted(pos[f:g], STRIDE * (high - base)))
                            sequence = term[lo:hi].tolist()
                            told = sum(idf[t] for t in informative.intersection(sequence)) / total if total else 1.0
                            return told, common_subsequence(masks[piece_no], sequence, size) / size if told >= answer else 0.0

                        # What all windows around this place hold together bounds what one of them holds.
                        unit_no = int(u[j])
                        if checked(unit_no - wide - 1, unit_no + wide + 2)[1] < least:
                            continue
                        for window in (i, *(a for a in range(max(unit_no - wide + 1, base), unit_no + 1) if a != i)):
                            told, share = checked(window - 2, window + wide + 2)
                            if share >= least and (key not in best or best[key][2] < share):
                                v = x[min(window + wide, int(start[own_doc + 1]))] - x[window]
                                near_by = float(v @ queries[piece_no] / max(np.linalg.norm(v), 1e-9))
                                best[key] = (ids[own_doc], near_by, share, told, max(STRIDE * (window - 2 - base), 0))
                            if key in best and best[key][2] >= 1.0:
                                break
                out = [(v[0], k[1], *v[1:]) for k, v in best.items()]
                if out:
                    who = np.array([o[0] for o in out], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(who, mask=who == NULL_ID), pa.array([o[1] for o in out], pa.int64()), *(pa.array([float(o[k]) for o in out]) for k in (2, 3, 4)), pa.array([o[5] for o in out], pa.int64())], ["doc_id", "item_id", "cosine", "lcs", "answer", "start_word"])

    return places.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 32, lcs: float = 0.5, answer: float = 0.6, common: float = 0.05, block_items: int = 5000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document and benchmark item: doc_id, item_id,
    cosine of the best window, lcs (share of the item's words, in order, in the
    window), answer (share of the item's informative words, by weight) and
    start_word. Clean documents have no row.

    A window is compared with an item where it holds one of the item's rarest
    terms, those without which the answer check can't pass; every such window
    goes to the two checks, whatever its cosine in the latent space, which only
    settles their order. Words are
    lower-cased runs of letters and digits. Terms that are in more
    than a share ``common`` of all passages carry no weight, unless an item has
    fewer than four others. Items come in blocks of ``block_items``, each
    against all documents; an item of more than 64 words is compared in pieces,
    and one piece is enough. Items of fewer than eight words need nine tenths.

    Null or empty documents and items match nothing. Null ids give rows with
    null. Rows that share an id are looked at one by one and merged. Other
    columns are ignored. Empty tables give no rows.
    """
    docs = documents(docs, id_col, text_col)
    spark = docs.sparkSession
    found = None
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null").orderBy("item", "text").toLocalIterator()
    while block := list(islice(rows, block_items)):
        items = Items([r.item for r in block], [r.text for r in block])
        if not items.pieces:
            continue
        places = materialize(_places(docs, items), "places")
        df, passages = _frequencies(places, len(items.terms))
        idf = np.log((passages + 1) / (df + 1))
        often = df > common * passages
        for p in items.pieces:
            own = np.unique(p)
            if (~often[own]).sum() < 4:
                often[own[np.argsort(df[own])[:4]]] = False
        idf[often] = 0
        idf = np.maximum(idf, 0)
        idf[(idf == 0) & ~often] = 1e-3
        space = latent_space(places, idf, rank)
        own = _search(places, items, idf, space, lcs, answer)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], FOUND)
    best = F.max_by(F.struct("cosine", "lcs", "answer", "start_word"), F.struct("lcs", "answer", "cosine", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
