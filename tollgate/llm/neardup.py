"""Near-duplicate documents by ProbMinHash signatures, banding and verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import NULL_ID, compress, decompress, documents, materialize, mix, ranges, remove, text_columns
from tollgate.llm.graph import components
from tollgate.llm.symbols import hash_words, word_spans

_GOLD, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: (document index, hash, count), sorted
    by document, and each document's word hashes as a 128-bit key (two columns).

    A document of fewer than ``size`` words is one shingle; one of none has none.
    """
    starts, ends, first = word_spans(data, offsets)
    words = hash_words(data, starts, ends)
    n = np.diff(first)
    keys = np.zeros((len(n), 2), np.int64)
    raw = words.tobytes()
    for i, (a, b) in enumerate(zip((8 * first[:-1]).tolist(), (8 * first[1:]).tolist(), strict=True)):
        keys[i] = np.frombuffer(xxhash.xxh3_128_digest(raw[a:b]), np.int64)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    h = words[at] if len(at) else np.zeros(0, np.uint64)
    for k in range(1, size):
        inside = n[doc] > k
        h = mix(h * _C + np.where(inside, words[np.minimum(at + k, len(words) - 1)], np.uint64(k))) if len(at) else h
    own = mix(h ^ (doc.astype(np.uint64) * _GOLD))
    order = np.argsort(own)
    heads = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(own) else np.zeros(0, np.int64)
    weight = np.diff(np.append(heads, len(own)))
    doc, h = doc[order[heads]], h[order[heads]]
    back = np.argsort(doc, kind="stable")
    return doc[back], h[back], weight[back], keys


def weights(count: np.ndarray) -> np.ndarray:
    """A shingle's weight: one plus the logarithm of its count."""
    return 1.0 + np.log(count)


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """ProbMinHash signatures, ``n_docs`` by ``k``.

    Each element sends a Poisson process of arrivals whose rate is its weight;
    every arrival falls on a random component, which keeps its earliest one. An
    element stops as soon as its time is past the latest of its document's
    components. All documents advance together.
    """
    first = np.full(n_docs * k, np.inf)
    sign = np.zeros(n_docs * k, np.uint64)
    time, turn = np.zeros(len(doc)), 0
    while len(doc):
        turn += 1
        u = mix(h + np.uint64(turn * int(_GOLD) & (1 << 64) - 1))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = doc * k + (mix(u ^ _C) % np.uint64(k)).astype(np.int64)
        better = np.flatnonzero(time < first[slot])
        np.minimum.at(first, slot[better], time[better])
        won = better[time[better] == first[slot[better]]]
        sign[slot[won]] = h[won]
        alive = time < first.reshape(n_docs, k).max(axis=1)[doc]
        doc, h, weight, time = doc[alive], h[alive], weight[alive], time[alive]
    return sign.reshape(n_docs, k)


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """sum_i 1 / sum_j max(x_j / x_i, y_j / y_i) over the elements that both have."""
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y = x[order], y[order]
    above = np.cumsum(x[::-1])[::-1]  # of this and later elements, whose ratio is at least as large
    below = np.cumsum(y) - y
    both = (x > 0) & (y > 0)
    return float(np.sum(1.0 / (above[both] / x[both] + below[both] / y[both])))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the Jaccard similarity of the shingle sets and the
    probability Jaccard of their weights, which are the same where no shingle is
    repeated; a and b are (hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    plain = float((len(a[0]) + len(b[0]) - len(every)) / len(every))
    if a[1].max() == 1 and b[1].max() == 1:
        return plain
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[back[: len(a[0])]], y[back[len(a[0]) :]] = weights(a[1]), weights(b[1])
    return max(plain, probability_jaccard(x, y))


SIGNS = "doc_id long, text_a long, text_b long, key_a long, key_b long, bands array<long>"


def numbered(docs: DataFrame) -> DataFrame:
    """With the 128-bit hash of the text, which together with the id names a row
    but for exact copies of it."""
    return docs.withColumns({"text_a": F.xxhash64("text"), "text_b": F.xxhash64(F.lit(1), "text")})


def signatures(docs: DataFrame, size: int, bands: int, per_band: int) -> DataFrame:
    """Per document: the key of its word sequence and its band hashes (null without
    words), twice as many where shingles are repeated: by weights and by the plain set."""
    k = bands * per_band

    def banded(s: np.ndarray) -> np.ndarray:
        b = np.zeros((len(s), bands), np.uint64)
        for j in range(per_band):
            b = mix(b * _C + s[:, j::per_band])
        return mix(b + np.arange(bands, dtype=np.uint64) * _GOLD)

    def sign(batches):
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            for lo, hi in ranges(offsets, 4 << 20):
                n = hi - lo
                doc, h, count, keys = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                b = banded(prob_minhash(doc, h, weights(count), n, k))
                none = np.bincount(doc, minlength=n) == 0
                # Of documents with repeated shingles also the bands of the plain set;
                # those of all others are that already.
                again = np.zeros(n, bool)
                again[doc[count > 1]] = True
                own = again[doc]
                place = np.cumsum(again) - 1
                plain = banded(prob_minhash(place[doc[own]], h[own], np.ones(int(own.sum())), int(again.sum()), k))
                at = np.concatenate([[0], np.cumsum(bands * (1 + again.astype(np.int32)))]).astype(np.int32)
                flat = np.zeros(int(at[-1]), np.uint64)
                flat[at[:-1, None] + np.arange(bands)] = b
                flat[at[:-1][again][:, None] + bands + np.arange(bands)] = plain
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)), mask=pa.array(none))
                own = [batch.column(c).slice(lo, n) for c in ("text_a", "text_b")]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), *own, pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists], ["doc_id", "text_a", "text_b", "key_a", "key_b", "bands"])

    return docs.mapInArrow(sign, SIGNS)


def _bodies(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, body) of the nodes (node, doc_id, text_a, text_b)."""

    def squeeze(batches):
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            raw = data.tobytes()
            body = [(offsets[i + 1] - offsets[i]).tobytes() + compress(raw[offsets[i] : offsets[i + 1]]) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("text_a"), batch.column("text_b"), pa.array(body, pa.binary())], ["doc_id", "text_a", "text_b", "body"])

    name = ["doc_id", "text_a", "text_b"]
    return docs.mapInArrow(squeeze, "doc_id long, text_a long, text_b long, body binary").dropDuplicates(name).join(nodes, name).select("node", "body")


def verified(bodies: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough. Each text travels
    once for every pair that it is in; a document in very many pairs is split by
    the skew-aware join."""
    left = pairs.join(bodies, pairs["a"] == bodies["node"]).select("a", "b", F.col("body").alias("one"))
    both = left.join(bodies, left["b"] == bodies["node"]).select("a", "b", "one", F.col("body").alias("two"))

    def compare(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n = part.num_rows
                own = _shingled([*part.column("one").to_pylist(), *part.column("two").to_pylist()], size)
                keep = np.array([similarity(own[i], own[n + i]) >= threshold for i in range(n)])
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(keep)), part.column("b").filter(pa.array(keep))], ["a", "b"])

    return both.mapInArrow(compare, "a long, b long")


def _shingled(bodies: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of compressed texts."""
    texts = [decompress(x[8:], int.from_bytes(x[:8], "little")) for x in bodies]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    doc, h, count, _ = shingles(np.frombuffer(b"".join(texts), np.uint8), offsets, size)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(h[a:b], count[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _across(members: DataFrame, size: int, threshold: float, block: int) -> DataFrame:
    """Links (a, b) between members of a bucket that have different labels.

    Members (band, doc, label, n of the bucket, body) are dealt into blocks by
    hash, and each pair of blocks is compared alone: shared shingles of one
    member with all others are counted at once. Of the links found, only those
    that join two classes of the block are returned, fewer than its members.
    """
    blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc", F.lit(11)), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(t: pa.Table) -> pa.Table:
        doc, label = t.column("doc").to_pylist(), t.column("label").to_numpy()
        mine, i, j = t.column("own").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        a, b = [], []
        if len(np.unique(label)) > 1:
            shingled = _shingled(t.column("body").to_pylist(), size)
            length = np.array([len(h) for h, _ in shingled])
            every, flat = np.unique(np.concatenate([h for h, _ in shingled]), return_inverse=True)
            heads = np.cumsum(length) - length
            repeated = np.array([int(c.max(initial=1)) > 1 for _, c in shingled])
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            mark = np.zeros(len(every), np.int32)
            # Weights as shares of their document's sum.
            share = np.concatenate([weights(c) / max(weights(c).sum(), 1.0) for _, c in shingled])
            other = np.zeros(len(every))
            right = mine == j
            for x in np.flatnonzero(mine == i).tolist():
                # Only what no link has joined to x so far is worth counting.
                y = np.flatnonzero(right & (label != label[x]) & ((i != j) | (np.arange(len(doc)) > x)))
                # Sizes alone rule out what is too short or too long, but for repeated shingles.
                near = (length[y] >= threshold * length[x]) & (length[x] >= threshold * length[y]) | repeated[y] | repeated[x]
                y = y[near & (length[y] > 0)]
                if not len(y):
                    continue
                mark[flat[heads[x] : heads[x] + length[x]]] = 1
                shared = np.add.reduceat(mark[flat], heads[length > 0])[np.cumsum(length > 0)[y] - 1]
                mark[flat[heads[x] : heads[x] + length[x]]] = 0
                likeness = shared / (length[x] + length[y] - shared)
                most = likeness
                odd = repeated[y] | repeated[x]
                if odd.any():
                    # Of each shared shingle the smaller share of its document's weight: their sum
                    # is at least the probability Jaccard, as sum_j max(x_j / x_i, y_j / y_i) is at
                    # least sum_j x_j / x_i and sum_j y_j / y_i. What is below it can't be a link.
                    mine_at = slice(heads[x], heads[x] + length[x])
                    other[flat[mine_at]] = share[mine_at]
                    bound = np.add.reduceat(np.minimum(other[flat], share), heads[length > 0])[np.cumsum(length > 0)[y] - 1]
                    other[flat[mine_at]] = 0
                    most = np.where(odd, np.maximum(likeness, bound + 1e-9), likeness)
                for k in np.flatnonzero(most >= threshold).tolist():
                    z = int(y[k])
                    p, q = root(int(label[x])), root(int(label[z]))
                    if p != q and (likeness[k] >= threshold or similarity(shingled[x], shingled[z]) >= threshold):
                        parent[p] = q
                        a.append(doc[x])
                        b.append(doc[z])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pairs = dealt.select("band", "i", "j", "own", "doc", "label", "body").groupBy("band", "i", "j").applyInArrow(compare, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def duplicate_classes(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 30, per_band: int = 5, block: int = 512) -> DataFrame:
    """One row per document (doc_id, text): doc_id, text_a, text_b (see
    :func:`numbered`), class_id, class_size, keep; see :func:`near_duplicates`.

    Documents are told apart by their words, never by their ids.
    """
    docs = numbered(docs)
    # The number of a row, fixed by the write, settles which of exact copies stays.
    signs = materialize(signatures(docs, size, bands, per_band).withColumn("row", F.monotonically_increasing_id()), "signatures")
    worded = signs.where("bands is not null")
    # Documents with the same words are one node; one of them stands for all.
    least = F.min(F.struct("doc_id", "text_a", "text_b", "row"))
    heads = materialize(worded.groupBy("key_a", "key_b").agg(least.alias("first")).select("key_a", "key_b", "first.*").withColumn("node", F.monotonically_increasing_id()), "heads")
    firsts = materialize(worded.join(heads.select("row", "node"), "row").select("node", "bands"), "firsts")
    entries = firsts.select(F.explode(F.array_distinct("bands")).alias("band"), F.col("node").alias("doc"))
    buckets = entries.groupBy("band").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(entries.join(buckets, "band"), "members")
    near = members.select(F.col("doc").alias("node")).distinct()
    bodies = materialize(_bodies(docs, heads.select("node", "doc_id", "text_a", "text_b").join(near, "node")), "bodies")
    stars = members.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    linked = materialize(verified(bodies, stars, size, threshold), "links")
    labels = components(linked)
    labelled = members.join(labels, members["doc"] == labels["node"], "left").select("band", "doc", "n", F.coalesce("label", "doc").alias("label"))
    open_bands = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    unsettled = labelled.join(open_bands, "band").join(bodies.withColumnRenamed("node", "doc"), "doc")
    more = materialize(_across(unsettled, size, threshold, block), "links")
    labels = materialize(components(linked.unionByName(more)), "labels")
    for done in (firsts, members, bodies, linked, more):
        remove(done)
    known = heads.join(labels, "node", "left").select("key_a", "key_b", F.coalesce("label", "node").alias("label"))
    whole = signs.select("doc_id", "text_a", "text_b", "row", "key_a", "key_b", F.col("bands").isNotNull().alias("worded"))
    classed = whole.join(known.withColumn("worded", F.lit(True)), ["key_a", "key_b", "worded"], "left")
    # Written, so that both sides of the join are plain shuffles, which can be split where a class is large.
    sizes = materialize(classed.where("worded").groupBy("label").agg(F.count(F.lit(1)).alias("class_size"), least.alias("first")), "sizes")
    own = classed.join(sizes, "label", "left")
    class_id = F.coalesce("first.doc_id", "doc_id")
    return own.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "text_a",
        "text_b",
        F.when(class_id != NULL_ID, class_id).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("keep"),
    )


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 30, per_band: int = 5, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class),
    class_size, keep (it is the one row of its class that stays, of the smallest id).

    Documents are linked when their shingles of ``size`` words (words
    ``[^\\x20\\x09-\\x0D]+``, unchanged) are similar by ``threshold`` or more, and
    classes are the connected components of these links. Documents with the
    same words count once. A pair at the threshold is a candidate with
    probability 1 - (1 - threshold^per_band)^bands (6.7e-6 short of 1 by
    default), whichever of the two similarities it is by. Candidates are first compared with their bucket's smallest member;
    where a bucket still holds several classes after that, all its members of
    different classes are compared in blocks, so no link between candidates of
    different classes is lost and no group's pairs are listed.

    Fewer than ``size`` words: one shingle of them all. No words (null, empty):
    a class of its own. Null ids sort below all others, so a class that has one
    is named null. Rows that share an id, or have none, are in one class only if
    their texts are; their classes then have the same name, and ``keep`` still
    marks one row of each. Other columns are ignored. An empty table gives no rows.
    """
    docs = documents(docs, id_col, text_col)
    return duplicate_classes(docs, size, threshold, bands, per_band, block).select("doc_id", "class_id", "class_size", "keep")
