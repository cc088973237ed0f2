"""Running totals over ordered groups of any size.

A window with ``PARTITION BY key ORDER BY t`` sorts a whole group in one task, which a hot key
does not survive. Here rows are range-partitioned on (keys, order), so that a large group spreads
over many partitions; each partition computes its own running value and adds what the group holds
in earlier partitions. Only a group that crosses a partition border has such a carry, and each
border is crossed by at most one group, so the carries number less than the partitions: that bound
is why they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultfold.session import settle

_PART = "_range_part"


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add running sums and running maxima, current row included, in ascending ``order``.

    ``order`` must be total inside a group. Keys compare null-safely. ``parts`` is the number of
    partitions; without one adaptive execution makes as many as the rows need, once it has seen their
    size, up to what the session shuffles into.
    """
    sums = sums or {}
    maxima = maxima or {}
    valued = rows.select("*", *[v.alias(n) for n, v in {**sums, **maxima}.items()])
    wanted = [parts] if parts else []
    # Kept, since the carries and the rows must see the same partitions. The input is computed twice,
    # for a sample of its keys and for the shuffle.
    placed = settle(
        valued.repartitionByRange(*wanted, *keys, *order).withColumn(_PART, F.spark_partition_id())
    )
    carries = _carries(placed, keys, list(sums), list(maxima))

    here = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed
    for name in sums:
        inside = inside.withColumn(name, F.sum(name).over(here))
    for name in maxima:
        inside = inside.withColumn(name, F.max(name).over(here))

    joined = inside.join(F.broadcast(carries), _same(inside, carries, keys), "left")
    totals = {n: F.coalesce(carries[_carry(n)], F.lit(0)) + inside[n] for n in sums}
    peaks = {n: F.greatest(carries[_carry(n)], inside[n]) for n in maxima}
    computed = {**totals, **peaks}
    return joined.select(
        *[inside[c] for c in rows.columns], *[v.alias(n) for n, v in computed.items()]
    )


def number_rows(
    rows: DataFrame, keys: list[str], order: list[str], out: str = "position", parts: int | None = None
) -> DataFrame:
    """1-based position of every row in its group."""
    return running(rows, keys, order, sums={out: F.lit(1).cast("bigint")}, parts=parts)


def _carry(name: str) -> str:
    return f"_carry_{name}"


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    match = left[_PART] == right[f"_{_PART}"]
    for key in keys:
        match = match & left[key].eqNullSafe(right[f"_{key}"])
    return match


def _carries(placed: DataFrame, keys: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    """What each group holds in the partitions before each partition it reaches."""
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum(n).alias(n) for n in sums] + [F.max(n).alias(n) for n in maxima]
    pieces = placed.groupBy(*keys, _PART).agg(*totals)
    return pieces.select(
        F.col(_PART).alias(f"_{_PART}"),
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[F.sum(n).over(before).alias(_carry(n)) for n in sums],
        *[F.max(n).over(before).alias(_carry(n)) for n in maxima],
    ).where(F.col("_earlier") > 0)
