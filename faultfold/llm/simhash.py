"""Operator 9: near-duplicates by SimHash and pivot distance tables.

A fingerprint's row in the pivot table holds its Hamming distances to reference fingerprints. By the
triangle inequality two fingerprints within ``radius`` differ by no more than ``radius`` in every
coordinate, so a pair with a larger difference anywhere is discarded unseen; survivors are verified
bit by bit.

Distances of 64-bit fingerprints to any fixed references crowd around 32, so the coordinates alone
cannot keep a large table from comparing everything with everything. The table is therefore cut into
cells first: the fingerprint is cut into ``radius + 2`` runs of bits, and two fingerprints that differ
in at most ``radius`` bits agree in at least two of them. Each choice of two runs is a cell key, so
every linked pair meets in some cell, and only pairs of a cell reach the pivot tables. A cell that many
fingerprints share is cut again by the bits that are left.

A cell emits a spanning forest of its links, not the pairs: a fingerprint's row joins the component
it is linked to once. Components of the forest are found by alternating label steps on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.llm.common import U64, give_back, mixed
from faultfold.session import settle

RADIUS = 4
SHINGLE = 4
BITS = 64
#: The bits are cut into ``radius + AGREE`` runs; any pair within the radius agrees in two of them.
AGREE = 2
#: Fingerprints of a cell that is not cut again, and how often at most cells are cut.
CELL_ROWS = 4_096
CUTS = 4
#: Rows of cells that one group works off.
GROUP_ROWS = 150_000
#: Reference fingerprints of a cell's pivot table.
PIVOTS = 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SHIFTS = np.arange(BITS, dtype=U64)


def fingerprint(text: str | None) -> int:
    """SimHash over XXH64 (seed 42) of all 4-word shingles, repeats included; no words give zero."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(flat[a:b], 42) for a, b in spans), U64, n - SHINGLE + 1)
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * total > len(hashes)).astype(U64) << _SHIFTS).sum(dtype=U64))


def fingerprints(docs: DataFrame, *keep: str, name: str = "fp") -> DataFrame:
    """``keep`` columns of every row and ``name``, the fingerprint as a signed long."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.fromiter(map(fingerprint, part.column("text").to_pylist()), U64, part.num_rows)
            kept = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values.view(np.int64))], [*keep, name])
        give_back()

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep]
    return source.mapInArrow(run, ", ".join([*fields, f"`{name}` long"]))


def run_masks(free: int, runs: int, agree: int = AGREE) -> list[int]:
    """Masks of every choice of ``agree`` runs, when the set bits of ``free`` are cut into ``runs``."""
    places = [i for i in range(BITS) if free >> i & 1]
    edges = [round(i * len(places) / runs) for i in range(runs + 1)]
    cut = [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(pick) for pick in combinations(cut, agree)]


def pivot_table(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per value and one column per pivot."""
    return np.bitwise_count(values[:, None] ^ pivots[None, :]).astype(np.int8)


def _pivots_of(values: np.ndarray, n: int) -> np.ndarray:
    """References spread over a cell: each next one lies farthest from those chosen before."""
    chosen = [values[0]]
    nearest = np.bitwise_count(values ^ chosen[0]).astype(np.int16)
    while len(chosen) < min(n, len(values)):
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        chosen.append(values[far])
        nearest = np.minimum(nearest, np.bitwise_count(values ^ chosen[-1]))
    return np.array(chosen, U64)


def cell_forest(values: np.ndarray, radius: int = RADIUS, pivots: int = PIVOTS) -> list[tuple[int, int]]:
    """Links (i, j) that join the same fingerprints as all pairs within ``radius`` would.

    Components are grown from one fingerprint at a time: against those not yet reached, first the
    pivot rows are compared and, where no coordinate differs by more than ``radius``, the bits.
    """
    m = len(values)
    if m < 2:
        return []
    if m == 2:
        return [(0, 1)] if (int(values[0]) ^ int(values[1])).bit_count() <= radius else []
    table = pivot_table(values, _pivots_of(values, min(pivots, 2 + m // 8)))
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    lo = np.searchsorted(first, first - np.int8(radius), "left")
    hi = np.searchsorted(first, first + np.int8(radius), "right")
    ranked, rows = values[order], table[order]
    free = np.ones(m, bool)
    links = []
    for seed in range(m):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            near = lo[x] + np.flatnonzero(free[lo[x] : hi[x]])
            for c in range(1, rows.shape[1]):
                if not len(near):
                    break
                near = near[np.abs(rows[near, c] - rows[x, c]) <= radius]
            if len(near):
                near = near[np.bitwise_count(ranked[near] ^ ranked[x]) <= radius]
                free[near] = False
                links += [(int(order[x]), int(order[y])) for y in near]
                queue += near.tolist()
    return links


def cut_cells(rows: DataFrame, radius: int) -> DataFrame:
    """The smaller cells of every row of ``rows`` (cell, free, fp, id), the same columns.

    ``free`` has the bits in which members of a cell may differ. They are cut into ``radius + AGREE``
    runs, and a fingerprint goes to the cell of each choice of ``AGREE``: two members within
    ``radius`` agree in one of them.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cell, free, fp = (part.column(c).to_numpy().view(U64) for c in ("cell", "free", "fp"))
            for bits in np.unique(free).tolist():
                at = np.flatnonzero(free == U64(bits))
                own, kept = fp[at], pa.array(at)
                for i, mask in enumerate(run_masks(bits, radius + AGREE)):
                    named = mixed(mixed((own & U64(mask)) + U64(i + 1)) ^ cell[at])
                    left = np.full(len(at), bits & ~mask, U64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(named.view(np.int64)), pa.array(left.view(np.int64)), part.column("fp").take(kept), part.column("id").take(kept)],
                        ["cell", "free", "fp", "id"],
                    )

    return rows.select("cell", "free", "fp", "id").mapInArrow(run, "cell long, free long, fp long, id long")


def cells(nodes: DataFrame, radius: int, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, int]:
    """Cells (cell, fp, id) of all fingerprints, and how many rows they have.

    Cells of more than ``cell_rows`` rows are cut again, as long as bits are free: after ``CUTS`` cuts
    about 13 are, so no cell has more than some 8,000 distinct fingerprints, however many texts one
    template makes.
    """
    dealt = cut_cells(nodes.select(F.lit(0).cast("long").alias("cell"), F.lit(-1).cast("long").alias("free"), "fp", "id"), radius)
    rows = nodes.count() * len(run_masks((1 << BITS) - 1, radius + AGREE))
    done = []
    for _ in range(CUTS - 1):
        sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        hot = settle(sizes.where(F.col("n") > cell_rows).select("cell"))
        if hot.isEmpty():
            break
        done.append(dealt.join(hot, "cell", "left_anti"))
        dealt = settle(cut_cells(dealt.join(hot, "cell"), radius))
        rows += dealt.count()
    for part in done:
        dealt = dealt.unionByName(part)
    return dealt.select("cell", "fp", "id"), rows


def links(nodes: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Spanning links (a, b), a < b, between the ids of ``nodes`` (fp, id), distinct in fp.

    All cells of a task are worked off together, so small cells cost no call each.
    """
    dealt, rows = cells(nodes, radius, cell_rows)
    groups = F.pmod(F.col("cell"), F.lit(max(8, rows // GROUP_ROWS)))

    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell").to_numpy()
        fp = table.column("fp").to_numpy().view(U64)
        ids = table.column("id").to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, fp, ids = cell[order], fp[order], ids[order]
        edges = np.flatnonzero(np.diff(cell)) + 1
        starts = np.concatenate(([0], edges))
        stops = np.concatenate((edges, [len(cell)]))
        out: set[tuple[int, int]] = set()
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a > 1:
                own = ids[a:b]
                for i, j in cell_forest(fp[a:b], radius):
                    x, y = int(own[i]), int(own[j])
                    out.add((x, y) if x < y else (y, x))
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    found = dealt.withColumn("g", groups).groupBy("g").applyInArrow(run, "a long, b long")
    return found.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of ``edges`` (a, b).

    Alternating large-star and small-star steps: neighbours above a node, then those below it, are
    hung on the smallest neighbour. The number of rounds grows with the logarithm of the longest
    path. Stars are aggregates (a minimum per node) and joins, so a hub is not collected anywhere;
    every round is cut off with a checkpoint.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a")
        if large:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.where("a <> b").distinct()

    e = settle(edges.where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        e = settle(star(star(e, True), False))
        state = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def simhash_components(docs: DataFrame, *keep: str, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of every row of ``docs`` (doc_id, text).

    Columns: doc_id, ``keep``, fp (signed long), fingerprint (16 hex digits), component_id (the
    smallest doc_id reachable over links, its own included).

    Equal fingerprints are one node before any pair is looked at, so exact copies cost nothing.

    Cases: null and empty texts have fingerprint zero and are linked like any other; rows with a
    null doc_id take part in links but name no component: a component without any doc_id has a null
    component_id; repeated rows are one node; an empty table gives no rows; other columns are left
    out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    rows = settle(fingerprints(rows, "doc_id", *keep))
    # An id for every fingerprint: its smallest doc_id, or one above all others where it has none.
    by_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = by_fp.where("least is not null").select("fp", F.col("least").alias("id"))
    nameless = by_fp.where("least is null")
    nameless = nameless.select(
        "fp", (F.lit((1 << 62)) + F.shiftrightunsigned(F.xxhash64("fp"), 2)).alias("id")
    )
    nodes = settle(nodes.union(nameless))
    found = components(links(nodes, radius))
    named = nodes.join(found, "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component")
    )
    named = named.withColumn(
        "component_id", F.when(F.col("component") < F.lit(1 << 62), F.col("component"))
    ).drop("component")
    return rows.join(named, "fp").select(
        "doc_id", *keep, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) that stay: one of every component.

    It is the row with the smallest doc_id, one without a doc_id only where the component has no
    other; of rows that share it, the one with the smaller hash of its text. Rows that repeat doc_id
    and text stay once. No name of a column of ``docs`` clashes with those used inside.
    """
    key = [F.col("doc_id").isNull().alias("__none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.xxhash64("text").alias("__text")]
    named = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key)
    slim = settle(fingerprints(named.select("__none", "__id", "__text", "text"), "__none", "__id", "__text", name="fp"))
    # A fingerprint is its own id here.
    nodes = settle(slim.select("fp", F.col("fp").alias("id")).distinct())
    found = components(links(nodes, radius))
    placed = slim.withColumnRenamed("fp", "id").join(found, "id", "left")
    best = placed.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min(F.struct("__none", "__id", "__text")).alias("k"))
    # The copies of a row are merged before the shuffle; the semi-join needs no other one.
    once = named.dropDuplicates(["__none", "__id", "__text"])
    stay = once.join(best.select("k.*"), ["__none", "__id", "__text"], "left_semi")
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])
