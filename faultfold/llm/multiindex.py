"""Operator 13: near-duplicate embeddings by an inverted multi-index.

1. *Codebooks.* Unit vectors are cut into halves; each half has its own codebook, learnt by k-means on a
   bounded sample (``SAMPLE``). The product of both is a grid of cells, and every vector lies in one.
2. *Condensing.* Equal vectors are one. Where a cell is crowded, vectors within half the link angle of a
   leader become a ball: any two of a ball are linked, so a crowd of near copies costs one node.
3. *Traversal.* Every node visits the cells nearest to it, in the order of the multi-sequence algorithm.
   How many cells it takes to meet ``TARGET`` of all links is measured first: some vectors are
   compared with all others, and the rank of each partner's cell is counted.
4. *Verification.* Visitors and members of a cell are compared in double precision. Two balls are
   linked as a whole, or not at all, where the angle of their leaders and their radii prove it;
   otherwise their members are compared.

A pair that meets in two cells is settled in the smaller one. Cells send counts and spanning links, never
pairs; the components are found on Spark.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from faultfold.llm.common import give_back
from faultfold.llm.simhash import components
from faultfold.session import settle

LEAST_COSINE = 0.9
#: Vectors, by the smallest hashes, from which the codebooks are learnt, and rounds of k-means.
SAMPLE = 20_000
ROUNDS = 8
#: Nodes of an average cell, and the most centres of a codebook.
CELL_ROWS = 256
MOST_CENTRES = 1024
#: Share of links that the traversal has to meet, measured on ``PROBES`` vectors against all; the share is
#: taken over pairs and over vectors, and the smaller of both counts. Most cells that a node visits.
TARGET = 0.995
PROBES = 512
MOST_CELLS = 64
#: A cell of more nodes than this, twice the average, is condensed, around so many leaders a round.
CROWD = 512
LEADERS = 8
CONDENSINGS = 3
#: Members of a cell that one group holds, and rows of small cells that share a group.
BLOCK_ROWS = 8192
GROUP_ROWS = 20_000
#: Angles nearer than this to a bound are looked at pair by pair.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id whose vector is finite and not zero; v has its numbers as bytes.

    A column of floats is kept as floats, which is half the size; all arithmetic is in doubles.
    """
    kind = "float" if vectors.schema[vector_col].dataType == ArrayType(FloatType()) else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(fine & F.exists("v", lambda c: c != 0))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column("v")
            # Adding zero makes one of both zeros.
            flat = column.flatten().to_numpy(zero_copy_only=False) + 0.0
            ends = np.cumsum(np.diff(column.offsets.to_numpy())).tolist()
            packed = [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], ["id", "v"])
        give_back()

    return rows.mapInArrow(run, "id long, v binary")


def numbers(rows: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors of ``dim`` floats or doubles as a matrix of doubles."""
    kind = np.float32 if rows and len(rows[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(rows), kind).reshape(-1, dim).astype(np.float64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return numbers(column.to_pylist(), dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Vectors of length one; those with very large or small entries are scaled first."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Grid:
    """Two codebooks and the cells of their product, numbered ``first * width + second``."""

    def __init__(self, first: np.ndarray, second: np.ndarray, cells: int = 1):
        self.books, self.cells = (first, second), cells
        self.dim, self.width = first.shape[1] + second.shape[1], len(second)

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the centres of each half, less what is the same for all centres."""
        at = self.books[0].shape[1]
        halves = units[:, :at], units[:, at:]
        return tuple((b * b).sum(axis=1) - 2 * h @ b.T for h, b in zip(halves, self.books, strict=True))

    def homes(self, units: np.ndarray) -> np.ndarray:
        first, second = self.distances(units)
        return first.argmin(axis=1) * self.width + second.argmin(axis=1)

    def visits(self, units: np.ndarray) -> np.ndarray:
        """The ``cells`` nearest cells of every vector, nearest first."""
        first, second = self.distances(units)
        near, far = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        out = np.empty((len(units), self.cells), np.int64)
        for i in range(len(units)):
            order = multi_sequence(first[i, near[i]], second[i, far[i]], self.cells)
            out[i] = [near[i, a] * self.width + far[i, b] for a, b in order]
        return out

    def ranks(self, one: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place of each of ``cells`` in the traversal of one vector, from 0."""
        first, second = (d[0] for d in self.distances(one[None, :]))
        ordered = np.sort(second)
        sums = first[cells // self.width] + second[cells % self.width]
        # What differs by rounding only is the cell itself or its equal.
        return sum(np.searchsorted(ordered, sums - d - 1e-12, "left") for d in first)


def multi_sequence(first: np.ndarray, second: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The ``most`` pairs (i, j) with the smallest ``first[i] + second[j]``; both are sorted.

    A pair enters the heap when both its predecessors, (i - 1, j) and (i, j - 1), have been taken.
    """
    heap, out = [(first[0] + second[0], 0, 0)], []
    taken = np.zeros((len(first) + 1, len(second) + 1), bool)
    taken[-1, :] = taken[:, -1] = True
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((i, j))
        taken[i, j] = True
        if i + 1 < len(first) and taken[i + 1, j - 1]:
            heapq.heappush(heap, (first[i + 1] + second[j], i + 1, j))
        if j + 1 < len(second) and taken[i - 1, j + 1]:
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
    return out


def codebook(points: np.ndarray, centres: int, seed: int) -> np.ndarray:
    """k-means on a sample; centres that lose all points stay where they are."""
    rng = np.random.default_rng(seed)
    made = points[rng.choice(len(points), min(centres, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = ((made * made).sum(axis=1) - 2 * points @ made.T).argmin(axis=1)
        count = np.bincount(own, minlength=len(made))
        total = np.zeros_like(made)
        np.add.at(total, own, points)
        made[count > 0] = total[count > 0] / count[count > 0, None]
    return made


def fit_grid(classes: DataFrame, dim: int, n: int) -> Grid:
    """Codebooks from the ``SAMPLE`` vectors with the smallest hashes, one cell for ``CELL_ROWS`` vectors."""
    rows = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    units = unit(numbers([bytes(r["v"]) for r in rows], dim))
    centres = min(MOST_CENTRES, max(1, math.isqrt(n // CELL_ROWS)))
    half = dim // 2
    return Grid(codebook(units[:, :half], centres, 1), codebook(units[:, half:], centres, 2))


def cells_for_target(classes: DataFrame, grid: Grid, least: float, target: float) -> int:
    """How many cells a vector has to visit, measured on ``PROBES`` vectors against all.

    A pass over all vectors with the probes beside them; what comes back is a count for each probe and
    rank. A pair is met by either of its vectors, so the true share is higher.
    """
    most = min(MOST_CELLS, len(grid.books[0]) * grid.width)
    rows = classes.select("v").orderBy(F.xxhash64("v", F.lit(7)), "v").limit(PROBES).collect()
    probes = unit(numbers([bytes(r["v"]) for r in rows], grid.dim))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(probes), most + 1), np.int64)
        for part in parts:
            for a in range(0, part.num_rows, 2048):
                units = unit(matrix(part.column("v").slice(a, 2048), grid.dim))
                found = probes @ units.T
                linked = (found >= least) & (found < 1 - 1e-12)
                homes = grid.homes(units)
                for i in np.flatnonzero(linked.any(axis=1)).tolist():
                    at = np.minimum(grid.ranks(probes[i], homes[linked[i]]), most)
                    count[i] += np.bincount(at, minlength=most + 1)
        give_back()
        probe, rank = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(rank), pa.array(count[probe, rank])], ["probe", "rank", "n"])

    counted = classes.select("v").mapInArrow(run, "probe long, rank long, n long").groupBy("probe", "rank").agg(F.sum("n").alias("n"))
    table = np.zeros((len(probes), most + 1))
    for r in counted.collect():
        table[r["probe"], r["rank"]] = r["n"]
    table = table[table.sum(axis=1) > 0]
    if not len(table):
        return min(most, 8)
    met = np.cumsum(table, axis=1)
    share = np.minimum(met.sum(axis=0) / met[:, -1].sum(), (met / met[:, -1:]).mean(axis=0))[:most]
    enough = np.flatnonzero(share >= target)
    return int(enough[0]) + 1 if len(enough) else most


def placed(nodes: DataFrame, grid: Grid) -> DataFrame:
    """``nodes`` with ``cell``, the number of the cell that holds ``v``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            homes = grid.homes(unit(matrix(part.column("v"), grid.dim))) if part.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(homes)], [*part.schema.names, "cell"])

    return nodes.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in nodes.dtypes), "cell long"]))


def condensed(classes: DataFrame, grid: Grid, alpha: float) -> DataFrame:
    """Classes (id, v, n, cell) with ``ball``, the class id of their leader or their own, and ``turn``,
    the angle to it.

    A crowded cell names ``LEADERS`` of its vectors, those with the smallest hashes; vectors within half
    of ``alpha`` of one join the nearest. What is left of a cell that is still crowded does so again.
    Members are never gathered: the few leaders of a cell are joined to them.
    """
    half = alpha / 2 - SLACK
    free = settle(classes.withColumns({"ball": F.col("id"), "turn": F.lit(0.0)}))
    done = []
    for turn in range(CONDENSINGS):
        crowded = free.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CROWD).select("cell")
        crowded = settle(crowded)
        if crowded.isEmpty():
            break
        done.append(free.join(crowded, "cell", "left_anti").select(*free.columns))
        close = free.join(crowded, "cell", "left_semi")
        first = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(turn)), "id")
        some = close.withColumn("place", F.row_number().over(first)).where(F.col("place") <= LEADERS)
        some = some.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("place", "id", "v"))).alias("leaders"))

        def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                ball, angle = part.column("id").to_pylist(), [0.0] * part.num_rows
                cells = part.column("cell").to_numpy()
                for cell in np.unique(cells).tolist():
                    at = np.flatnonzero(cells == cell)
                    leaders = part.column("leaders")[int(at[0])].as_py()
                    heads = unit(numbers([x["v"] for x in leaders], grid.dim))
                    # Leaders that are near each other do not both lead.
                    keep = [0]
                    for i in range(1, len(heads)):
                        if angles(heads[keep] @ heads[i]).min() > half:
                            keep.append(i)
                    found = angles(unit(matrix(part.column("v").take(pa.array(at)), grid.dim)) @ heads[keep].T)
                    nearest = found.argmin(axis=1)
                    for i, j, x in zip(at.tolist(), nearest.tolist(), found.min(axis=1).tolist(), strict=True):
                        if x <= half:
                            ball[i], angle[i] = leaders[keep[j]]["id"], x
                columns = {"id": part.column("id"), "v": part.column("v"), "n": part.column("n"), "cell": part.column("cell"), "ball": pa.array(ball, pa.int64()), "turn": pa.array(angle, pa.float64())}
                yield pa.RecordBatch.from_pydict(columns)

        joined = close.select("id", "v", "n", "cell").join(some, "cell")
        made = settle(joined.mapInArrow(join, "id long, v binary, n long, cell long, ball long, turn double"))
        sizes = made.groupBy("ball").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("ball").alias("led"))
        led = made.join(sizes, F.col("ball") == F.col("led"), "left")
        done.append(led.where("led is not null").select(*free.columns))
        free = settle(led.where("led is null").select(*free.columns))
    for part in done:
        free = free.unionByName(part)
    return settle(free)


NODE = "id long, v binary, w long, r double, cell long"


def verdicts(cosines: np.ndarray, reach: np.ndarray, least: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked as a whole, to be looked at): pairs of nodes by the cosine of their leaders and the sum of
    their radii. Where both have no radius the cosine itself decides."""
    single = reach == 0
    linked = (cosines >= least) & single
    if single.all():
        return linked, np.zeros_like(linked)
    turn = angles(cosines)
    sure = ~single & (turn + reach <= alpha - SLACK)
    open_ = ~single & ~sure & (turn - reach <= alpha + SLACK)
    return linked | sure, open_


def merged(edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same ids, a star around the smallest id of every component."""
    left, right = (np.concatenate(x) for x in zip(*edges, strict=True))
    ids, flat = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


MEETING = "kind int, a long, b long, n long"


def meetings(nodes: DataFrame, grid: Grid, least: float, alpha: float) -> DataFrame:
    """What the cells find out: rows of kind 0 (a is linked with n further vectors), 1 (spanning links a,
    b) and 2 (nodes a, b whose members have to be looked at)."""
    dim, cells = grid.dim, grid.cells

    def travel(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 1024):
                own = part.slice(a, 1024)
                visits = grid.visits(unit(matrix(own.column("v"), dim)))
                # Once as a member of its own cell, with its path, and once as a visitor of each cell.
                path = pa.array([x.tobytes() for x in visits], pa.binary())
                none = pa.nulls(own.num_rows, pa.binary())
                rest = [own.column(c) for c in ("id", "v", "w", "r")]
                home = own.column("cell")
                names = ["id", "v", "w", "r", "home", "cell", "visits"]
                yield pa.RecordBatch.from_arrays([*rest, home, home, path], names)
                for k in range(visits.shape[1]):
                    yield pa.RecordBatch.from_arrays([*rest, home, pa.array(visits[:, k]), none], names)
        give_back()

    sizes = nodes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    travelled = nodes.mapInArrow(travel, "id long, v binary, w long, r double, home long, cell long, visits binary")
    # Members of a large cell are dealt to blocks; a visitor goes to all blocks of a cell. Cells that
    # nobody lives in are left out here.
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    blocks = F.explode(F.when(F.col("visits").isNotNull(), own).otherwise(every))
    dealt = travelled.join(sizes, "cell").withColumn("block", blocks).drop("blocks")
    groups = max(8, nodes.count() * (1 + cells) // GROUP_ROWS)
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("cell", "block"), F.lit(groups)))

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = ("id", "w", "r", "cell", "home", "block")
        ids, weight, radius, cell, home, block = (table.column(c).to_numpy() for c in names)
        stays = ~table.column("visits").is_null().to_numpy()
        units = unit(matrix(table.column("v"), dim))
        order = np.lexsort((block, cell))
        edges = np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(block[order]) != 0)) + 1
        total: dict[int, int] = {}
        links, look = [(np.empty(0, np.int64), np.empty(0, np.int64))], [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for at in np.split(order, edges):
            live, come = at[stays[at]], at[~stays[at]]
            if not len(live):
                continue
            paths = np.frombuffer(b"".join(table.column("visits").take(pa.array(live)).to_pylist()), np.int64).reshape(len(live), -1)
            here = int(cell[live[0]])
            for a in range(0, len(come), 512):
                some = come[a : a + 512]
                linked, open_ = verdicts(units[some] @ units[live].T, radius[some][:, None] + radius[live][None, :], least, alpha)
                i, j = np.nonzero(linked | open_)
                # Two that live here meet twice; two that visit each other are settled in the smaller cell.
                from_, to = some[i], live[j]
                back = (paths[j] == home[from_][:, None]).any(axis=1) if len(i) else np.empty(0, bool)
                keep = np.where(home[from_] == here, ids[from_] < ids[to], ~back | (here < home[from_]))
                i, j, from_, to = i[keep], j[keep], from_[keep], to[keep]
                sure = linked[i, j]
                for x, y in ((from_[sure], to[sure]), (to[sure], from_[sure])):
                    names_, where = np.unique(x, return_inverse=True)
                    sums = np.bincount(where, weight[y], len(names_)) if len(x) else []
                    for k, s in zip(ids[names_].tolist(), sums, strict=True):
                        total[k] = total.get(k, 0) + int(s)
                links.append((ids[from_[sure]], ids[to[sure]]))
                look.append((ids[from_[~sure]], ids[to[~sure]]))
                if sum(len(x) for x, _ in links) > 500_000:
                    links = [merged(links)]
        del units
        give_back()
        a, b = merged(links)
        c, d = (np.concatenate(x) for x in zip(*look, strict=True))
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(total), len(a), len(c)])
        return pa.table(
            {
                "kind": pa.array(kinds),
                "a": pa.array(np.concatenate((np.fromiter(total, np.int64, len(total)), a, c))),
                "b": pa.array(np.concatenate((np.zeros(len(total), np.int64), b, d))),
                "n": pa.array(np.concatenate((np.fromiter(total.values(), np.int64, len(total)), np.zeros(len(a) + len(c), np.int64)))),
            }
        )

    return settle(dealt.groupBy("g").applyInArrow(meet, MEETING))


def looked_at(open_: DataFrame, nodes: DataFrame, members: DataFrame, least: float, alpha: float, dim: int) -> DataFrame:
    """(a, na, b, nb, x, y): linked pairs of classes a of ball x and b of ball y that leaders left open.

    First the members of one ball are held against the other as a whole, then what is still open
    member by member, so that only pairs near the bound are made.
    """

    def close(columns: list[str]):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                if not part.num_rows:
                    continue
                one, two = unit(matrix(part.column("v"), dim)), unit(matrix(part.column("u"), dim))
                linked, left = verdicts(np.einsum("nd,nd->n", one, two), part.column("r").to_numpy(), least, alpha)
                state = pa.array(np.where(linked, 1, 2).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), state], [*columns, "state"]).filter(pa.array(linked | left))

        return run

    of = members.select(F.col("ball").alias("x"), F.col("id").alias("a"), "v", F.col("n").alias("na"))
    whole = nodes.select(F.col("id").alias("y"), F.col("v").alias("u"), F.col("w").alias("nb"), "r")
    met = open_.select("x", "y").join(of, "x").join(whole, "y").select("x", "y", "a", "v", "na", "u", "nb", "r")
    first = met.mapInArrow(close(["x", "y", "a", "v", "na", "nb"]), "x long, y long, a long, v binary, na long, nb long, state int")
    first = settle(first)
    sure = first.where("state = 1").select("a", "na", F.lit(None).cast("long").alias("b"), "nb", "x", "y")
    other = members.select(F.col("ball").alias("y"), F.col("id").alias("b"), F.col("v").alias("u"), F.col("n").alias("nb"), F.lit(0.0).alias("r"))
    met = first.where("state = 2").drop("nb").join(other, "y").select("x", "y", "a", "v", "na", "b", "u", "nb", "r")
    pairs = met.mapInArrow(close(["x", "y", "a", "na", "b", "nb"]), "x long, y long, a long, na long, b long, nb long, state int")
    return settle(sure.unionByName(pairs.select("a", "na", "b", "nb", "x", "y")))


def near_copies(classes: DataFrame, dim: int, least: float, target: float) -> DataFrame:
    """(id, links, component) of every class (id, v, n) of one dimension that is linked with another."""
    n = classes.count()
    alpha = math.acos(least)
    grid = fit_grid(classes, dim, n)
    grid.cells = cells_for_target(classes, grid, least, target)
    members = condensed(placed(classes, grid), grid, alpha)
    sums = members.groupBy("ball").agg(F.sum("n").alias("w"), F.max("turn").alias("r"), F.count(F.lit(1)).alias("size"))
    heads = members.select(F.col("id").alias("ball"), "v", "cell")
    nodes = settle(sums.join(heads, "ball").select(F.col("ball").alias("id"), "v", "w", "r", "cell"))
    found = meetings(nodes, grid, least, alpha)
    edges = found.where("kind = 1").select("a", "b")
    # A ball links its own members.
    edges = edges.unionByName(members.where("ball <> id").select(F.col("id").alias("a"), F.col("ball").alias("b")))
    more = found.where("kind = 0").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("more"))
    open_ = found.where("kind = 2").select(F.col("a").alias("x"), F.col("b").alias("y"))
    extra = None
    if not open_.isEmpty():
        pairs = looked_at(open_, nodes, members, least, alpha, dim)
        single = pairs.where("b is not null")
        whole = pairs.where("b is null")
        # Members of a ball that is linked as a whole with one vector each gain it.
        gained = whole.groupBy(F.col("y").alias("ball")).agg(F.sum("na").alias("gained"))
        more = more.unionByName(gained.select("ball", F.col("gained").alias("more"))).groupBy("ball").agg(F.sum("more").alias("more"))
        extra = whole.select(F.col("a").alias("id"), F.col("nb").alias("extra"))
        extra = extra.unionByName(single.select(F.col("a").alias("id"), F.col("nb").alias("extra")))
        extra = extra.unionByName(single.select(F.col("b").alias("id"), F.col("na").alias("extra")))
        extra = extra.groupBy("id").agg(F.sum("extra").alias("extra"))
        edges = edges.unionByName(whole.select("a", F.col("y").alias("b"))).unionByName(single.select("a", "b"))
    labels = components(edges)
    rows = members.select("id", "ball", "n").join(sums.select("ball", "w"), "ball").join(more, "ball", "left")
    if extra is None:
        rows = rows.withColumn("extra", F.lit(0).cast("long"))
    else:
        rows = rows.join(extra, "id", "left")
    links = F.col("w") - F.col("n") + F.coalesce("more", F.lit(0)) + F.coalesce("extra", F.lit(0))
    return rows.select("id", links.alias("links")).join(labels, "id", "left")


def near_duplicates(
    vectors: DataFrame,
    least: float = LEAST_COSINE,
    target: float = TARGET,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Links and components of the rows of ``vectors`` at a cosine of ``least`` (from 0.5 to below 1).

    Columns: vec_id, n_links (other vectors linked directly), component_id (the smallest vec_id
    reachable, its own included), kept (vec_id = component_id). Links below ``least`` are never made;
    ``target`` is the share of links that the traversal meets at least, as measured on a sample.

    Cases: vectors null, empty, zero or with null or non-finite components are rows without links, as
    are rows without an id (component and kept null); repeated rows of one id and vector are one;
    one id with several vectors is a row each; vectors of different length are never linked; an
    empty table gives no rows; other columns are left out.
    """
    if not 0.5 <= least < 1:
        raise ValueError("least must lie in [0.5, 1)")
    rows = usable(vectors, id_col, vector_col)
    # Two 64-bit hashes stand for the vector, so that rows need not carry it.
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]
    rows = rows.select("id", "v", *keys).dropDuplicates(["id", "k1", "k2"])
    classes = rows.groupBy("k1", "k2").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.max("v").alias("v"))
    # A class is known by a number of its own: one id may have several vectors.
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()))
    width = 4 if vectors.schema[vector_col].dataType == ArrayType(FloatType()) else 8
    dims = sorted(r["d"] for r in classes.select((F.octet_length("v") / width).cast("int").alias("d")).distinct().collect())
    found = None
    for dim in dims:
        own = near_copies(classes.where(F.octet_length("v") == width * dim).select("id", "v", "n"), dim, least, target)
        found = own if found is None else found.unionByName(own)
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    if found is None:
        alone = every.dropDuplicates()
        return alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    known = classes.select("id", "least_id", "k1", "k2", "n").join(found, "id")
    known = settle(known.withColumn("component", F.coalesce("component", "id")))
    least_of = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(least_of, "component").select("k1", "k2", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.select(F.col("id").alias("vec_id"), "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    taking = rows.select(F.col("id").alias("vec_id"))
    bad = every.dropDuplicates().join(taking, "vec_id", "left_anti")
    alone = bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
