"""Best-fit packing of documents into sequences by a grouping genetic algorithm."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import documents, materialize, nullable_ids, ranges, text_columns
from tollgate.llm.tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """Every document's pieces: itself, or for longer ones a first piece of what
    is left over and then full ones."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            for lo, hi in ranges(offsets, 2 << 20):
                tokens, first = coder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                raw, at = memoryview(tokens.astype("<u4").tobytes()), first.tolist()
                who, which, start, length, crc = [], [], [], [], []
                for i, doc_id in enumerate(ids[lo:hi].tolist()):
                    base, n = at[i], at[i + 1] - at[i] + 1
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        who.append(doc_id)
                        which.append(k)
                        start.append(a)
                        length.append(b - a)
                        own = zlib.crc32(raw[4 * (base + a) : 4 * (base + min(b, n - 1))])
                        crc.append(zlib.crc32(end, own) if b == n else own)
                yield pa.RecordBatch.from_arrays([nullable_ids(np.array(who, np.int64)), pa.array(which, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put each item, in the given order, into the bin it fills best; open bins as needed."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in enumerate(free):
        if room:
            stacks[room].append(b)
            mask |= 1 << room
    for i in items:
        size = lengths[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
            free.append(0)
        room -= size
        free[b] = room
        if room:
            stacks[room].append(b)
            mask |= 1 << room


def fitness(bins: list[list[int]], free: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more uneven fill, which leaves room to improve."""
    return len(bins), -float(sum((1 - f / capacity) ** 2 for f in free)) / max(len(bins), 1)


def individual(lengths: list[int], capacity: int, rng: random.Random | None) -> tuple[list[list[int]], list[int]]:
    """Best fit in descending order; with ``rng`` the order is blurred."""
    order = range(len(lengths))
    key = (lambda i: -lengths[i]) if rng is None else (lambda i: -lengths[i] * rng.uniform(0.85, 1.15))
    bins: list[list[int]] = []
    free: list[int] = []
    best_fit(lengths, sorted(order, key=key), bins, free, capacity)
    return bins, free


def crossover(lengths: list[int], a, b, capacity: int, rng: random.Random, well: float = 0.995):
    """Inject whole well-filled bins of ``b`` into ``a``; bins of ``a`` that
    share an item with them go, and their other items are best-fitted again."""
    good = [k for k, room in enumerate(b[1]) if room <= (1 - well) * capacity]
    if not good:
        good = sorted(range(len(b[1])), key=b[1].__getitem__)[: max(1, len(b[1]) // 4)]
    chosen = rng.sample(good, max(1, len(good) // 2))
    taken = {i for k in chosen for i in b[0][k]}
    bins, free, displaced = [list(b[0][k]) for k in chosen], [b[1][k] for k in chosen], []
    for own, room in zip(*a, strict=True):
        # A badly filled bin is broken up too: the mutation of this operator.
        if taken.isdisjoint(own) and (room <= 0.02 * capacity or rng.random() < 0.9):
            bins.append(list(own))
            free.append(room)
        else:
            displaced += [i for i in own if i not in taken]
    displaced.sort(key=lambda i: -lengths[i])
    best_fit(lengths, displaced, bins, free, capacity)
    return bins, free


def bound(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: by total size, and by items that can't share."""
    least = -(-sum(lengths) // capacity)
    return max(least, sum(2 * n > capacity for n in lengths))


def evolve(lengths: list[int], capacity: int, seed: int, guests: list, population: int, generations: int):
    """One island's best packing after some generations; stops at the lower bound."""
    rng = random.Random(seed)
    people = [*guests, individual(lengths, capacity, None)]
    target = bound(lengths, capacity)
    best = min(people, key=lambda p: fitness(*p, capacity))
    if len(best[0]) <= target:
        return best
    while len(people) < population:
        people.append(individual(lengths, capacity, rng))
    scored = sorted(((fitness(*p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2])
    for g in range(generations):
        i, j = rng.sample(range(len(scored)), 2) if len(scored) > 1 else (0, 0)
        i, j = min(i, j), max(i, j)
        child = crossover(lengths, scored[j][2], scored[i][2], capacity, rng)
        scored.append((fitness(*child, capacity), population + g, child))
        scored.sort(key=lambda x: x[:2])
        scored.pop()
        if scored[0][0][0] <= target:
            break
    return scored[0][2]


def _assignment(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, own in enumerate(bins):
        out[own] = k
    return out.tobytes()


def _bins(assignment: bytes, lengths: list[int], capacity: int):
    of = np.frombuffer(assignment, "<i4")
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    bins = [x.tolist() for x in np.split(order, cuts)] if len(order) else []
    return bins, [capacity - sum(lengths[i] for i in own) for own in bins]


ELITE = "shard int, island int, n_bins int, cost double, bins binary"


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, shard_items: int = 16384, islands: int = 2, rounds: int = 2, population: int = 4, generations: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as it can.

    Only documents longer than ``capacity`` are cut; a full piece is a sequence
    of its own. The others are dealt at random into shards of about
    ``shard_items``. Each shard evolves on ``islands`` islands for ``rounds``
    rounds; after each round every island's elite moves to the next one. The
    best island's packing is the shard's. A packing is never worse than best
    fit in descending order, which is in every island's first population.

    Null or empty text is one piece with the end id alone. Null ids are packed
    like others. Rows that share an id are packed one by one. Other columns are
    ignored. An empty table gives an empty result.
    """
    table = materialize(pieces(documents(docs, id_col, text_col), capacity, tokenizer or default_path(), end_id), "pieces")
    full = table.where(F.col("length") == capacity)
    # Bit 62 keeps these numbers apart from those of the shards.
    full = full.select("*", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = table.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard_items))
    items = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(7)), F.lit(shards)).cast("int"))
    dealt = items.select("shard", "doc_id", "piece", "ids_crc32", "length").withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(islands)))))

    def ordered(t: pa.Table) -> pa.Table:
        return t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])

    def first(t: pa.Table) -> pa.Table:
        return island(t, None, 0)

    def island(t: pa.Table, elites: pa.Table | None, turn: int) -> pa.Table:
        schema = pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("n_bins", pa.int32()), ("cost", pa.float64()), ("bins", pa.binary())])
        if not t.num_rows:
            return schema.empty_table()
        shard, k = t.column("shard")[0].as_py(), t.column("island")[0].as_py()
        lengths = ordered(t).column("length").to_pylist()
        guests = [_bins(b, lengths, capacity) for b in elites.column("bins").to_pylist()] if elites is not None else []
        bins, free = evolve(lengths, capacity, (shard << 8) + (k << 4) + turn, guests, population, generations)
        n, cost = fitness(bins, free, capacity)
        return pa.table({"shard": [shard], "island": [k], "n_bins": [n], "cost": [cost], "bins": [_assignment(bins, len(lengths))]}, schema=schema)

    def later(turn: int):
        def again(own: pa.Table, guests: pa.Table) -> pa.Table:
            return island(own, guests, turn)

        return again

    elites = materialize(dealt.groupBy("shard", "island").applyInArrow(first, ELITE), "elites")
    for turn in range(1, rounds):
        moved = elites.withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))))
        elites = materialize(dealt.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInArrow(later(turn), ELITE), "elites")
    best = elites.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "cost", "island")).alias("bins"))

    def place(own: pa.Table, winner: pa.Table) -> pa.Table:
        own = ordered(own)
        of = np.frombuffer(winner.column("bins")[0].as_py(), "<i4").astype(np.int64)
        length = own.column("length").to_numpy()
        order = np.argsort(of, kind="stable")
        total = np.cumsum(length[order]) - length[order]
        head = np.concatenate([[True], np.diff(of[order]) != 0])
        offset = np.empty(len(of), np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(head, total, 0))
        shard = own.column("shard")[0].as_py()
        return own.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array((shard << 32) + of)).append_column("offset", pa.array(offset))

    placed = items.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, PACKED)
    return full.select(*placed.columns).unionByName(placed)
