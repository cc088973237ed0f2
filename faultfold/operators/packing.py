"""Greedy packing of ordered rows into batches, without a task that holds a group.

Next-fit is a walk: a batch takes rows while both caps allow, then the next one begins. Where a batch that
begins at some row ends is known from running totals alone, so a stretch of rows can be walked from
every place at which a batch may enter it. Entering places are few, since a batch has a bounded number
of rows. What a stretch does is then a short table, entry to exit; the tables of a group are put together
two by two (pointer doubling), and each stretch learns at which row its first batch begins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from faultfold.operators.prefix import running
from faultfold.session import settle

#: Rows of a stretch, at least; the walk of one lies in one task.
STRETCH = 4096


def _next(upto: np.ndarray, size: np.ndarray, most: int, room: int) -> np.ndarray:
    """For every row the row after the last of a batch that begins there; a batch has one row at least."""
    n = len(upto)
    fits = np.searchsorted(upto, upto - size + room, "right")
    here = np.arange(n)
    return np.maximum(np.minimum(fits, here + most), here + 1)


def _walk(step: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(exit, batches) from every row of a stretch of ``rows``: where the first batch beyond it begins,
    and how many begin inside."""
    out, count = step.copy(), np.ones(len(step), np.int64)
    for i in range(rows - 1, -1, -1):
        if step[i] < rows:
            out[i], count[i] = out[step[i]], count[step[i]] + 1
    return out[:rows], count[:rows]


def _same(left: DataFrame, right: DataFrame, group: list[str]) -> Column:
    match = left["_seg"] == right["_to"]
    for c in group:
        match = match & left[c].eqNullSafe(right[f"_r_{c}"])
    return match


def next_fit(
    entries: DataFrame, group: list[str], order: list[str], size: Column, most: int, room: int, stretch: int = STRETCH
) -> DataFrame:
    """``entries`` with ``batch_no``, from 0 in every group: rows in ``order``, at most ``most`` in a batch,
    and at most ``room`` of ``size`` together, but for a row that alone has more.

    ``order`` must be total inside a group and ``size`` at least 1. Null group keys are groups.
    """
    stretch = max(stretch, 2 * most)
    columns = entries.columns
    placed = running(
        entries.withColumn("_size", size.cast("bigint")), group, order,
        sums={"_place": F.lit(1).cast("bigint"), "_upto": size.cast("bigint")},
    )
    placed = settle(placed.withColumn("_seg", F.floor((F.col("_place") - 1) / stretch).cast("bigint")))

    # A stretch sees the rows that a batch begun in it may still take.
    ahead = F.col("_place") - 1 - F.col("_seg") * stretch < most
    owners = F.when(ahead & (F.col("_seg") > 0), F.array("_seg", F.col("_seg") - 1)).otherwise(F.array("_seg"))
    seen = placed.select(*group, "_place", "_upto", "_size", F.explode(owners).alias("_seg"))
    kept = [placed.schema[c] for c in group]

    def tables(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        place, upto, own = (table.column(c).to_numpy() for c in ("_place", "_upto", "_size"))
        seg = table.column("_seg")[0].as_py()
        rows = int((place <= (seg + 1) * stretch).sum())
        out, count = _walk(_next(upto, own, most, room), rows)
        entry = min(most, rows)
        ends = pa.array([(out[:entry] - rows).tolist()], pa.list_(pa.int64()))
        made = [table.column(c).slice(0, 1) for c in group]
        return pa.table([*made, pa.array([seg]), ends, pa.array([count[:entry].tolist()], pa.list_(pa.int64()))], names=[*group, "_seg", "_exit", "_count"])

    shape = StructType([*kept, StructField("_seg", LongType())])
    maps = seen.groupBy(*group, "_seg").applyInArrow(tables, f"{_ddl(shape)}, _exit array<bigint>, _count array<bigint>")
    entry = _entries(settle(maps), group)

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("_place")
        if not left.num_rows:  # behind the last stretch of a group
            return pa.table({c: left.column(c) for c in (*group, "_place")} | {"batch_no": pa.array([], pa.int64())})
        place, upto, own = (left.column(c).to_numpy() for c in ("_place", "_upto", "_size"))
        seg = left.column("_seg")[0].as_py()
        first, base = right.column("_entry")[0].as_py(), right.column("_base")[0].as_py()
        rows = int((place <= (seg + 1) * stretch).sum())
        step = _next(upto, own, most, room)
        begins = np.zeros(rows, np.int64)
        i = first
        while i < rows:
            begins[i] = 1
            i = int(step[i])
        # Rows before the first beginning belong to the last batch of the stretch before.
        number = base - 1 + np.cumsum(begins)
        kept_ = [left.column(c).slice(0, rows) for c in (*group, "_place")]
        return pa.table([*kept_, pa.array(number)], names=[*group, "_place", "batch_no"])

    shape = StructType([*kept, StructField("_place", LongType()), StructField("batch_no", LongType())])
    numbers = seen.groupBy(*group, "_seg").cogroup(entry.groupBy(*group, "_seg")).applyInArrow(assign, shape)
    numbers = numbers.select(*[F.col(c).alias(f"_r_{c}") for c in group], F.col("_place").alias("_to"), "batch_no")
    match = placed["_place"] == numbers["_to"]
    for c in group:
        match = match & placed[c].eqNullSafe(numbers[f"_r_{c}"])
    return placed.join(numbers, match).select(*[placed[c] for c in columns], "batch_no")


def _ddl(shape: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)


def _entries(maps: DataFrame, group: list[str]) -> DataFrame:
    """(group, _seg, _entry, _base): the row of each stretch at which its first batch begins, and how many
    batches begin before it.

    After round j a table tells what ``2 ** j`` stretches do that end with its own; the last round is
    the one whose reach exceeds the longest group. The table of the first stretch begins at its row 0.
    """
    longest = maps.agg(F.max("_seg")).first()[0]
    reach = 1
    while longest is not None and reach <= longest:
        before = maps.select(
            *[F.col(c).alias(f"_r_{c}") for c in group], (F.col("_seg") + reach).alias("_to"),
            F.col("_exit").alias("_from"), F.col("_count").alias("_more"),
        )
        joined = maps.join(before, _same(maps, before, group), "left")
        # ``_from`` leads into the table; entries count from 0, elements from 1. A batch may reach over
        # the end of a short last stretch; nothing begins behind it.
        exits = F.transform("_from", lambda x: F.coalesce(F.try_element_at("_exit", (x + 1).cast("int")), F.lit(0)))
        counts = F.transform(
            "_from",
            lambda x, i: F.element_at("_more", (i + 1).cast("int"))
            + F.coalesce(F.try_element_at("_count", (x + 1).cast("int")), F.lit(0)),
        )
        maps = settle(
            joined.select(
                *group, "_seg",
                F.coalesce(exits, F.col("_exit")).alias("_exit"),
                F.coalesce(counts, F.col("_count")).alias("_count"),
            )
        )
        reach *= 2
    # Whole prefixes now: what leaves a stretch enters the next.
    after = maps.select(*group, (F.col("_seg") + 1).alias("_seg"), F.element_at("_exit", 1).alias("_entry"), F.element_at("_count", 1).alias("_base"))
    first = maps.where("_seg = 0").select(*group, "_seg", F.lit(0).cast("bigint").alias("_entry"), F.lit(0).cast("bigint").alias("_base"))
    return first.unionByName(after)

