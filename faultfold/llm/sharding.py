"""Operator 10: shards from a hierarchical weighted hash tree.

A row descends region, rack and shard. At every level each child draws ``-ln(u) / weight`` with
``u`` from a hash of (key, child), and the smallest draw wins, so a child receives rows in proportion
to its weight, and a changed weight moves rows only into or out of the subtrees on its path. A node's
weight is the sum of what lies under it. A new shard opens a region of its own: that region's draw is
the only new one, so growth moves rows into the new shard and nowhere else.

Everything is DataFrame functions; the draws are evaluated only along the path taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash cells of a shard for the numbering; cells times shards bounds the table of offsets.
CELLS = 4096


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Rack:
    name: str
    shards: tuple[Shard, ...]

    @property
    def weight(self) -> float:
        return sum(s.weight for s in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> tuple[Region, ...]:
    """Shards ``0 .. shards - 1`` of weight one, filled rack by rack."""
    racks = [
        Rack(f"k{i // per_rack}", tuple(Shard(n) for n in range(i, min(i + per_rack, shards))))
        for i in range(0, shards, per_rack)
    ]
    return tuple(
        Region(f"r{i // racks_per_region}", tuple(racks[i : i + racks_per_region]))
        for i in range(0, len(racks), racks_per_region)
    )


def grown(tree: tuple[Region, ...], weight: float = 1.0) -> tuple[Region, ...]:
    """One more shard, in a region and rack of its own."""
    number = 1 + max(s.number for r in tree for k in r.racks for s in k.shards)
    return (*tree, Region(f"r+{number}", (Rack(f"k+{number}", (Shard(number, weight),)),)))


def _children(nodes: list[tuple[str, float, int]]) -> Column:
    """The children of one node as a constant array; those without weight take nothing."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(n).alias("n"))
            for name, weight, n in nodes
            if weight > 0
        ]
    )


def _winner(key: Column, children: Column) -> Column:
    """The number of the child with the smallest draw; equal draws go to the smaller number."""

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11).cast("double")
        drawn = -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / child["weight"]
        return F.struct(drawn.alias("draw"), child["n"].alias("n"))

    return F.array_min(F.transform(children, draw))["n"]


def shard_of(tree: tuple[Region, ...], key: Column) -> Column:
    """The shard of a key: region, then rack, then shard; each level's winner selects the next draws.

    Racks are numbered through the whole tree, so a rack's number finds its shards.
    """
    racks = [(r, k) for r in tree for k in r.racks]
    place = {(r.name, k.name): i for i, (r, k) in enumerate(racks)}
    regions = _children([(r.name, r.weight, i) for i, r in enumerate(tree)])
    by_region = F.array(
        *[_children([(f"{r.name}/{k.name}", k.weight, place[r.name, k.name]) for k in r.racks]) for r in tree]
    )
    by_rack = F.array(
        *[_children([(f"shard {s.number}", s.weight, s.number) for s in k.shards]) for _, k in racks]
    )
    region = _winner(key, regions)
    rack = _winner(key, F.element_at(by_region, region + 1))
    return _winner(key, F.element_at(by_rack, rack + 1)).cast("int")


def hash_tree_shards(docs: DataFrame, tree: tuple[Region, ...] | None = None) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text): shard, slot in the shard, and shard after growth.

    Columns: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law (always ``key``), shard,
    slot (0, 1, ... without gaps in each shard), grown_shard (with one more shard).

    Slots follow (hash cell, doc_id, checksum, size). A shard is numbered in ``CELLS`` pieces whose
    starts come from partial counts, so no task holds a shard; counting reads doc_id only.

    Cases: a null doc_id is a key like any other; a null text has size 16 and the checksum of no
    bytes, 0; repeated rows share a shard and get a slot each; an empty table gives no rows; other
    columns are left out, whatever their names.
    """
    tree = tree or even_tree(40)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))

    def placed(*extra: Column) -> DataFrame:
        cell = F.pmod(F.xxhash64(key), F.lit(CELLS)).alias("cell")
        return docs.select("doc_id", cell, shard_of(tree, key).alias("shard"), *extra)

    starts = placed().groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = placed(
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(grown(tree), key).alias("grown_shard"),
    )
    within = Window.partitionBy("shard", "cell").orderBy(
        F.col("doc_id").asc_nulls_last(), "text_crc32", "size"
    )
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).alias("slot"),
            "grown_shard",
        )
    )
