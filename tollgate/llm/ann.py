"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import materialize

#: Points that a batch of insertions or searches holds at a time.
BATCH = 256


def _rows(lists: list) -> np.ndarray:
    return np.array(lists, np.float64)


def beam_search(x: np.ndarray, norm: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` best points that a beam search finds, nearest
    first (-1: none), and their squared distances. The graph's last row and the
    last point stand for "no neighbour"."""
    n, b = len(x) - 1, len(q)
    rows = np.arange(b)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    ids = np.full((b, width), n)
    dist = np.full((b, width), np.inf, np.float32)
    open_ = np.zeros((b, width), bool)
    entry = entry[:width]
    seen[:, entry] = True
    ids[:, : len(entry)] = entry
    dist[:, : len(entry)] = norm[entry][None, :] - 2 * (q @ x[entry].T)
    open_[:, : len(entry)] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist, open_ = (np.take_along_axis(a, order, axis=1) for a in (ids, dist, open_))
    live = rows
    while len(live):
        at = np.argmax(open_[live], axis=1)  # sorted by distance: the nearest open one
        some = open_[live, at]
        live, at = live[some], at[some]
        if not len(live):
            break
        open_[live, at] = False
        near = np.sort(graph[ids[live, at]], axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        d = norm[near] - 2 * np.einsum("ard,ad->ar", x[near], q[live], optimize=True)
        d[~fresh] = np.inf
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_dist = np.concatenate([dist[live], d], axis=1)
        all_open = np.concatenate([open_[live], fresh], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        ids[live] = np.take_along_axis(all_ids, order, axis=1)
        dist[live] = np.take_along_axis(all_dist, order, axis=1)
        open_[live] = np.take_along_axis(all_open, order, axis=1) & np.isfinite(dist[live])
    ids[~np.isfinite(dist)] = -1
    return ids, dist + (q**2).sum(axis=1, dtype=np.float32)[:, None]


def robust_prune(x: np.ndarray, norm: np.ndarray, point: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse out-edges of each point: the nearest candidate is kept and rules
    out every other that is ``alpha`` times closer to it than to the point."""
    n = len(x) - 1
    c = np.sort(candidates, axis=1)
    c[(c < 0) | (c == point[:, None])] = n
    c[:, 1:][c[:, 1:] == c[:, :-1]] = n
    d = norm[c] + norm[point][:, None] - 2 * np.einsum("acd,ad->ac", x[c], x[point], optimize=True)
    d[c == n] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    c, d = np.take_along_axis(c, order, axis=1), np.take_along_axis(d, order, axis=1)
    vectors, out = x[c], np.full((len(point), degree), n)
    alive, rows = np.isfinite(d), np.arange(len(point))
    for k in range(degree):
        at = np.argmax(alive, axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        out[some, k] = c[rows, at][some]
        chosen = c[rows, at]
        between = norm[c] + norm[chosen][:, None] - 2 * np.einsum("acd,ad->ac", vectors, x[chosen], optimize=True)
        alive &= ~((alpha * alpha * between <= d) & some[:, None])
        alive[rows, at] = False
    return out


def build_graph(points: np.ndarray, degree: int, width: int, alpha: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries): ``degree`` out-edges of each point, -> ``len(points)``
    where there are fewer. Points are inserted in random order, batch by batch:
    a greedy search of the graph so far proposes neighbours, pruning keeps some,
    and these get edges back, pruned again where there are too many."""
    n, d = points.shape
    x = np.concatenate([points, np.zeros((1, d))]).astype(np.float32)
    norm = (x**2).sum(axis=1)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    slack = degree + degree // 2
    graph = np.full((n + 1, slack), n)
    middle = int(np.argmin(norm[:n] - 2 * (x[:n] @ x[:n].mean(axis=0))))
    entry = np.unique(np.concatenate([[middle], order[: min(n, 48)]]))
    first = np.concatenate([entry, order[: min(n, 2 * degree)]])
    first = np.unique(first)
    # The first few points are pruned among themselves.
    graph[first, :degree] = robust_prune(x, norm, first, np.tile(first, (len(first), 1)), degree, alpha)
    rest = order[~np.isin(order, first)]
    at, size = 0, max(16, degree)
    while at < len(rest):
        own = rest[at : at + size]
        at, size = at + len(own), min(BATCH, 2 * size)
        found, _ = beam_search(x, norm, graph, entry, x[own], width)
        # Points of one batch don't see each other in the graph; propose them too.
        among = np.argsort(norm[own][None, :] - 2 * (x[own] @ x[own].T), axis=1)[:, : degree // 2]
        edges = robust_prune(x, norm, own, np.concatenate([found, own[among]], axis=1), degree, alpha)
        graph[own, :degree] = edges
        source, target = np.repeat(own, degree), edges.ravel()
        real = target < n
        source, target = source[real], target[real]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads = np.flatnonzero(np.diff(target, prepend=-1))
        counts = np.diff(np.append(heads, len(target)))
        nodes = target[heads]
        have = (graph[nodes] < n).sum(axis=1)
        place = np.arange(len(target)) - np.repeat(heads, counts) + np.repeat(have, counts)
        fits = np.repeat(have + counts <= slack, counts)
        graph[target[fits], place[fits]] = source[fits]
        full = np.flatnonzero(have + counts > slack)
        for lo in range(0, len(full), BATCH):
            part = full[lo : lo + BATCH]
            top = int(counts[part].max())
            extra = np.full((len(part), top), -1)
            for r, k in enumerate(part.tolist()):
                extra[r, : counts[k]] = source[heads[k] : heads[k] + counts[k]]
            kept = robust_prune(x, norm, nodes[part], np.concatenate([np.where(graph[nodes[part]] == n, -1, graph[nodes[part]]), extra], axis=1), degree, alpha)
            graph[nodes[part]] = n
            graph[nodes[part], :degree] = kept
    return connect(x, norm, graph, entry, width), entry


def connect(x: np.ndarray, norm: np.ndarray, graph: np.ndarray, entry: np.ndarray, width: int) -> np.ndarray:
    """Edges for points that no walk from the entries reaches: each gets one
    from the nearest reached point that a search for it finds."""
    n = len(x) - 1
    while True:
        reached = np.zeros(n + 1, bool)
        reached[n] = True
        front = entry
        while len(front):
            reached[front] = True
            front = np.unique(graph[front])
            front = front[~reached[front]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return graph
        found, _ = beam_search(x, norm, graph, entry, x[lost[:BATCH]], width)
        for point, near in zip(lost[:BATCH].tolist(), found, strict=True):
            near = near[near >= 0]
            room = near[(graph[near] == n).any(axis=1)]
            if not len(room):
                graph = np.concatenate([graph, np.full((n + 1, 1), n)], axis=1)
                room = near
            row = graph[room[0]]
            row[np.argmax(row == n)] = point


GRAPH = "shard int, ids binary, counts binary, vectors binary, points binary, graph binary, entry binary, size long, dimension long"
FOUND = "query_id long, vec_id long, score double"


def build_index(vectors: DataFrame, k: int, shard_rows: int, degree: int, width: int, alpha: float, id_col: str, vector_col: str) -> DataFrame:
    """A written table with one graph per shard of about ``shard_rows`` distinct vectors.

    Equal vectors are one point with its ``k`` + 1 smallest ids, which is all
    that a search can ask for. Inner product becomes distance by one more
    coordinate, which fills every vector up to the longest one's length.
    """
    same = Window.partitionBy("vector").orderBy("id")
    ranked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1)
    distinct = materialize(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(F.expr("aggregate(vector, 0D, (s, x) -> s + x * x)"))).first()
    shards = max(1, -(-n // shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(shards)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        vectors = _rows(t.column("vector").to_pylist())
        ids = t.column("ids").to_pylist()
        spare = np.sqrt(np.maximum(longest - (vectors**2).sum(axis=1), 0))
        points = np.concatenate([vectors, spare[:, None]], axis=1)
        graph, entry = build_graph(points, degree, width, alpha)
        flat = np.array([i for own in ids for i in own], np.int64)
        row = [t.column("shard")[0].as_py(), flat.tobytes(), np.array([len(o) for o in ids], np.int64).tobytes(), vectors.tobytes(), points.astype(np.float32).tobytes(), graph.astype(np.int32).tobytes(), entry.astype(np.int64).tobytes(), len(ids), vectors.shape[1]]
        kinds = [pa.int32(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
        names = [f.split()[0] for f in GRAPH.split(", ")]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return materialize(dealt.groupBy("shard").applyInArrow(build, GRAPH), "graph")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Vectors without null, that are not zero and whose components are finite; as doubles, with one zero."""
    own = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias(vector_col)).where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.where(finite & F.exists(vector_col, lambda x: x != 0)).withColumn(vector_col, F.transform(vector_col, lambda x: x + F.lit(0.0)))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = 8192, degree: int = 32, width: int = 200, build_width: int = 80, alpha: float = 1.2, query_block: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest of all other rows by inner product: query_id,
    rank (from 1), vec_id, score. Ties go to the smaller id; the query's own id
    is no candidate. With fewer candidates, all are returned.

    All rows are indexed, dealt over shards by hash; every shard's graph is
    searched by every query, in blocks of ``query_block`` queries. Scores are
    exact, in double precision, the products added in the order of the components.

    Rows with a null id or vector, or with a vector that is zero, empty or holds
    null or non-finite components take no part, as candidates or queries. Rows
    that repeat a query id ask again and are merged; a vector id that is there
    twice may be found twice. Vectors must have one dimension. Other columns are
    ignored. Empty tables give no rows.
    """
    own = usable(vectors, id_col, vector_col)
    index = build_index(own, k, shard_rows, degree, build_width, alpha, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("vector")).dropDuplicates(["query_id"])
    count = asked.count()
    blocks = max(1, -(-count // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)).cast("int"))
    shards = index.select("shard").distinct().count()
    to_shards = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(q: pa.Table, g: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if q.num_rows and g.num_rows:
            size, d = g.column("size")[0].as_py(), g.column("dimension")[0].as_py()

            def read(name, kind):
                return np.frombuffer(g.column(name)[0].as_py(), kind)

            ids, counts = read("ids", np.int64), read("counts", np.int64)
            vectors, points = read("vectors", np.float64).reshape(size, d), read("points", np.float32).reshape(size, d + 1)
            graph, entry = read("graph", np.int32).reshape(size + 1, -1), read("entry", np.int64)
            x = np.concatenate([points, np.zeros((1, d + 1), np.float32)])
            norm = (x**2).sum(axis=1)
            heads = np.cumsum(counts) - counts
            query_ids, wanted = q.column("query_id").to_numpy(), _rows(q.column("vector").to_pylist())
            for lo in range(0, len(wanted), BATCH):
                own = wanted[lo : lo + BATCH]
                near, _ = beam_search(x, norm, graph, entry, np.concatenate([own, np.zeros((len(own), 1))], axis=1).astype(np.float32), min(max(width, k + 1), size))
                for i in range(len(own)):
                    found = near[i][near[i] >= 0]
                    # Summed from the first component to the last, so that a pair's score depends
                    # on neither its place in the shard nor the processor's kernels.
                    score = np.cumsum(vectors[found] * own[i], axis=1)[:, -1]
                    if len(found) > k + 1:
                        # All that tie with the last one stay, for the ids to decide.
                        keep = score >= np.partition(score, -(k + 1))[-(k + 1)]
                        found, score = found[keep], score[keep]
                    many = counts[found]
                    flat = ids[np.repeat(heads[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    value = np.repeat(score, many)
                    other = flat != query_ids[lo + i]
                    flat, value = flat[other], value[other]
                    best = np.lexsort((flat, -value))[:k]
                    out_q += [int(query_ids[lo + i])] * len(best)
                    out_v += flat[best].tolist()
                    out_s += value[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = to_shards.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block")).applyInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
