"""Operator 2: nearest neighbours by inner product, one navigable small-world graph per shard.

Rows are dealt to shards of bounded size by a hash. Each shard builds a hierarchical graph and stores
it as flat neighbour arrays (one row per layer: node numbers and a neighbour table), written to the
shared folder. Every query searches every shard, greedily through the upper layers and with a beam
through the lowest; the shards' best are merged.

Inner product is made a distance by one more component, ``sqrt(largest norm**2 - norm**2)``: the
nearest such point is the one with the largest inner product. Equal vectors are one node, or a crowd
of copies would fill all its neighbour lists and cut the graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultfold.session import settle, work_dir

SHARD_ROWS = 4096
#: Neighbours of a node, above the lowest layer and in it.
LINKS = 16
LINKS_0 = 32
#: Candidates from which a node's neighbours are chosen, and the beam of a search.
CANDIDATES = 64
BEAM = 96
#: Open candidates that a query expands in one step.
EXPAND = 4
#: Queries that travel and are searched together.
QUERY_BLOCK = 1024

GRAPH = "shard long, dim int, layer int, nodes binary, neighbours binary, vectors binary, classes binary, max_norm double"


def levels(n: int, seed: int) -> np.ndarray:
    """The top layer of every node; each layer keeps one in ``LINKS``."""
    u = np.random.default_rng(seed).random(n)
    return np.minimum((-np.log(1 - u) / np.log(LINKS)).astype(np.int64), 8)


def _choose(points: np.ndarray, near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Diverse neighbours for all nodes at once: a candidate is taken when no neighbour taken before
    is closer to it than the node itself; free places go to the nearest passed over."""
    n, c = near.shape
    taken = np.full((n, most), -1, np.int32)
    counts = np.zeros(n, np.int64)
    passed = np.zeros((n, c), bool)
    rows = np.arange(n)
    for j in range(c):
        cand = near[:, j]
        valid = cand >= 0
        gap = points[taken] - points[cand][:, None, :]
        between = np.einsum("nkd,nkd->nk", gap, gap)
        between[taken < 0] = np.inf
        ok = valid & (counts < most) & (between.min(axis=1) >= dist[:, j])
        taken[rows[ok], counts[ok]] = cand[ok]
        counts[ok] += 1
        passed[:, j] = valid & ~ok
    for j in range(c):
        ok = passed[:, j] & (counts < most)
        taken[rows[ok], counts[ok]] = near[ok, j]
        counts[ok] += 1
    return taken


def build_layer(points: np.ndarray, most: int) -> np.ndarray:
    """Neighbour table (-1: none) of one layer; links run both ways as far as there is room."""
    n = len(points)
    if n == 1:
        return np.full((1, most), -1, np.int32)
    c = min(CANDIDATES if most == LINKS_0 else CANDIDATES // 2, n - 1)
    norms = np.einsum("nd,nd->n", points, points)
    near, dist = np.empty((n, c), np.int32), np.empty((n, c), np.float32)
    for a in range(0, n, 512):
        d = norms[a : a + 512, None] + norms[None, :] - 2 * (points[a : a + 512] @ points.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        best = np.argpartition(d, c - 1, axis=1)[:, :c]
        own = np.take_along_axis(d, best, 1)
        order = np.argsort(own, axis=1, kind="stable")
        near[a : a + 512] = np.take_along_axis(best, order, 1)
        dist[a : a + 512] = np.take_along_axis(own, order, 1)
    table = np.full((n, most), -1, np.int32)
    half = max(1, most // 2)
    for a in range(0, n, 512):
        table[a : a + 512, :half] = _choose(points, near[a : a + 512], dist[a : a + 512], half)
    # Links back, nearest first.
    src, slot = np.nonzero(table[:, :half] >= 0)
    dst = table[src, slot]
    gap = points[src] - points[dst]
    order = np.lexsort((np.einsum("nd,nd->n", gap, gap), dst))
    src, dst = src[order], dst[order]
    known = (table[dst, :half] == src[:, None]).any(axis=1)
    src, dst = src[~known], dst[~known]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst, "left")
    fits = rank < most - half
    table[dst[fits], half + rank[fits]] = src[fits]
    return table


def build_graph(points: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest up: (node numbers, neighbour table in positions of that layer)."""
    top = levels(len(points), seed)
    top[0] = top.max()
    return [
        (nodes, build_layer(points[nodes], LINKS_0 if layer == 0 else LINKS))
        for layer in range(int(top.max()) + 1)
        for nodes in [np.flatnonzero(top >= layer).astype(np.int32)]
    ]


def search(points: np.ndarray, layers: list, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(node numbers, distances) of the ``beam`` nearest found per query, nearest first; -1 pads.

    All queries of a block step together: each expands its nearest open candidates until its beam
    has none left.
    """
    q = len(queries)
    entry = np.zeros(q, np.int64)
    for nodes, table in reversed(layers[1:]):
        at = np.searchsorted(nodes, entry)
        own = points[nodes]
        best = ((own[at] - queries) ** 2).sum(axis=1)
        live = np.arange(q)
        while len(live):
            near = table[at[live]]
            d = ((own[near] - queries[live][:, None, :]) ** 2).sum(axis=2)
            d[near < 0] = np.inf
            j = d.argmin(axis=1)
            d = d[np.arange(len(live)), j]
            better = d < best[live]
            live = live[better]
            at[live] = near[better, j[better]]
            best[live] = d[better]
        entry = nodes[at].astype(np.int64)
    table = layers[0][1]
    n = len(points)
    beam = min(beam, n)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    open_ = np.zeros((q, beam), bool)
    ids[:, 0], dist[:, 0], open_[:, 0] = entry, ((points[entry] - queries) ** 2).sum(axis=1), True
    seen = np.zeros((q, n), bool)
    seen[np.arange(q), entry] = True
    live = np.arange(q)
    stamp = np.zeros((q, n), np.int32)
    wide = min(EXPAND, beam)
    while len(live):
        todo = np.where(open_[live], dist[live], np.inf)
        j = np.argpartition(todo, wide - 1, axis=1)[:, :wide]
        some = np.isfinite(np.take_along_axis(todo, j, 1))
        busy = some.any(axis=1)
        live, j, some = live[busy], j[busy], some[busy]
        if not len(live):
            break
        open_[live[:, None], j] = False
        near = table[np.where(some, ids[live[:, None], j], 0)].astype(np.int64)
        near = np.where(some[:, :, None], near, -1).reshape(len(live), -1)
        r, c = np.nonzero((near >= 0) & ~seen[live[:, None], near])
        # Of a node that several of the expanded ones link to, one entry counts.
        order = np.arange(len(r), dtype=np.int32)
        stamp[live[r], near[r, c]] = order
        one = stamp[live[r], near[r, c]] == order
        r, c = r[one], c[one]
        seen[live[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, np.float32)
        gap = points[near[r, c]] - queries[live[r]]
        d[r, c] = np.einsum("nd,nd->n", gap, gap)
        all_ids = np.concatenate((ids[live], near), axis=1)
        all_d = np.concatenate((dist[live], d), axis=1)
        all_open = np.concatenate((open_[live], np.isfinite(d)), axis=1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ids[live] = np.take_along_axis(all_ids, keep, 1)
        dist[live] = np.take_along_axis(all_d, keep, 1)
        open_[live] = np.take_along_axis(all_open, keep, 1)
    ids[~np.isfinite(dist)] = -1
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows whose vector has only finite components, not all zero, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where("id is not null and v is not null").where(fine & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    k: int = 20,
    beam: int = BEAM,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product to each row of ``queries``.

    Columns: query_id, rank (from 1), vec_id, score (in double precision on the original vectors).
    ``queries`` has the columns of ``vectors``; left out, it is the rows whose id 20 divides. Equal
    scores go to the smaller id; a query's own id is not a candidate. Every row is indexed.

    Of equal vectors the ``k + 1`` smallest ids are kept, more cannot be among the ``k`` nearest.
    Vectors of different length are dealt to different shards and never compared. A task holds one
    shard and one block of queries.

    Cases: null ids, vectors null, empty, zero, or with null or non-finite components take no part;
    of repeated rows with one id and vector one counts; fewer candidates than ``k`` give all of
    them; an empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    if queries is None:
        asked = rows.where("id % 20 = 0")
    else:
        asked = usable(queries, id_col, vector_col)
    asked = asked.dropDuplicates(["id", "v"])
    # Components -0.0 and 0.0 are the same number; grouping by the array would tell them apart.
    same = F.transform("v", lambda x: x + F.lit(0.0))
    one = rows.select("id", same.alias("v")).withColumn("key", F.xxhash64("v"))
    first = Window.partitionBy("key", "v").orderBy("id")
    few = one.dropDuplicates(["id", "key", "v"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = settle(few.groupBy("key", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-classes.count() // shard_rows))
    dealt = classes.withColumn("shard", F.pmod("key", F.lit(shards))).withColumn("dim", F.size("v"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        exact = flat.reshape(-1, dim)
        norms = np.einsum("nd,nd->n", exact, exact)
        largest = float(norms.max())
        points = np.column_stack((exact, np.sqrt(np.maximum(0, largest - norms)))).astype(np.float32)
        ids = table.column("ids").to_pylist()
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        classes_ = np.concatenate((counts.astype(np.int64), np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum()))))
        out = {n: [] for n in ("shard", "dim", "layer", "nodes", "neighbours", "vectors", "classes", "max_norm")}
        for layer, (nodes, links) in enumerate(build_graph(points, seed=shard)):
            row = (shard, dim, layer, nodes.tobytes(), links.tobytes(), exact.tobytes() if not layer else b"", classes_.tobytes() if not layer else b"", largest)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), types, strict=True)})

    folder = work_dir(spark, "graphs")
    dealt.groupBy("shard", "dim").applyInArrow(build, GRAPH).write.parquet(folder)
    graphs = spark.read.parquet(folder)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        graph = sorted(right.to_pylist(), key=lambda r: r["layer"])
        dim = graph[0]["dim"]
        exact = np.frombuffer(graph[0]["vectors"], np.float64).reshape(-1, dim)
        n = len(exact)
        raw = np.frombuffer(graph[0]["classes"], np.int64)
        counts, flat = raw[:n], raw[n:]
        starts = np.cumsum(counts) - counts
        norms = np.einsum("nd,nd->n", exact, exact)
        points = np.column_stack((exact, np.sqrt(np.maximum(0, graph[0]["max_norm"] - norms)))).astype(np.float32)
        layers = [
            (np.frombuffer(g["nodes"], np.int32), np.frombuffer(g["neighbours"], np.int32).reshape(-1, LINKS_0 if g["layer"] == 0 else LINKS))
            for g in graph
        ]
        q_ids = left.column("id").to_numpy()
        q_vec = left.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        out_q, out_v, out_s = [], [], []
        for a in range(0, len(q_ids), 256):
            ids, vec = q_ids[a : a + 256], q_vec[a : a + 256]
            asked_points = np.column_stack((vec, np.zeros(len(vec)))).astype(np.float32)
            found, _ = search(points, layers, asked_points, max(beam, 2 * k))
            for i in range(len(ids)):
                own = found[i][found[i] >= 0]
                score = np.array([float(np.dot(exact[x], vec[i])) for x in own])
                member = np.concatenate([flat[starts[x] : starts[x] + counts[x]] for x in own])
                score = np.repeat(score, counts[own])
                other = member != ids[i]
                member, score = member[other], score[other]
                best = np.lexsort((member, -score))[:k]
                out_q.append(np.full(len(best), ids[i], np.int64))
                out_v.append(member[best])
                out_s.append(score[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    def every(n: int, name: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)

    # A shard meets a block of queries in one group: both are sent there under both numbers.
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    sent = asked.select("id", "v", F.size("v").alias("dim"), block, every(shards, "shard"))
    placed = graphs.select("*", every(blocks, "block"))
    found = (
        sent.groupBy("shard", "dim", "block")
        .cogroup(placed.groupBy("shard", "dim", "block"))
        .applyInArrow(find, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(best).cast("int"))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
