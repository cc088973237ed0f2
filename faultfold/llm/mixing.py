"""Operator 8: mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, its target over its size. The
expected copies are summed along the source's documents, one random offset is added, and a document
is emitted once for each whole number its step crosses. Walking from long to short documents keeps
the words taken within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultfold.llm.common import word_count
from faultfold.session import settle

#: No source, and so no document, is repeated more often than this.
MOST_COPIES = 2
#: Documents of one source and size that are numbered in one piece.
CELL_ROWS = 1_000


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5
) -> DataFrame:
    """One row per source: its size, weight and target in words.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words.
    No target exceeds ``MOST_COPIES`` times its source; what is cut is shared anew by weight. With
    sources ordered by cap over weight that is a running sum: the first source not filled fixes the
    level. The windows run over one row per source, not over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    cap = (F.col("source_size") * MOST_COPIES).cast("double")
    rows = totals.withColumn("weight", turn).withColumn("cap", cap)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(
        F.sum("cap").over(before), F.lit(0.0)
    )
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    open_level = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    rows = rows.withColumn("level", F.first(open_level, ignorenulls=True).over(whole))
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def _drawn(value: Column, digits: int) -> Column:
    """A whole number of so many hexadecimal digits, fixed by ``value`` on every engine."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by source and seed, in steps that sums of copies keep exactly."""
    named = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))
    bits = _drawn(F.concat(F.lit(f"{seed}/"), named), 5)
    return bits.cast("double") / F.lit(float(1 << 20))


def systematic_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    seed: int = 17,
) -> DataFrame:
    """Copies of every row of ``docs`` (doc_id, text, source) in the mix.

    Columns: doc_id, source, size (words), source_size, target (of the source, in words), copies,
    taken (copies times size). The same rows and seed give the same copies.

    A source is never numbered in one task: documents are counted by (source, size), and a size that
    very many documents share is cut further by a hash of doc_id; a running sum over these cells
    gives each its start. Sizes are kept in the checkpoint folder, since three steps read them.

    Cases: a null text has size 0 and takes no words; a null source is a source, listed last; a null
    doc_id is allowed; of repeated rows each counts; an empty table gives no rows; other columns
    are left out.
    """
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sized, weights, share)
    by_size = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    cut = by_size.withColumn("pieces", F.floor(F.col("n") / CELL_ROWS) + 1).drop("n")

    def same(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
        right = right.select(*[F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in right.columns])
        on = [left[n].eqNullSafe(right[f"__{n}"]) for n in names]
        return left.join(right, on).drop(*[f"__{n}" for n in names])

    celled = same(sized, cut, "source", "size").withColumn(
        "cell", _drawn(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 8) % F.col("pieces")
    )
    cells = celled.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    walk = Window.partitionBy("source").orderBy(F.desc("size"), "cell")
    cells = cells.withColumn("start", F.sum("n").over(walk) - F.col("n")).drop("n")
    cells = same(cells, targets, "source")
    within = Window.partitionBy("source", "size", "cell").orderBy(F.col("doc_id").asc_nulls_last())
    rows = celled.drop("pieces").withColumn("place", F.row_number().over(within))
    rows = same(rows, cells, "source", "size", "cell")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    step = F.col("start") + F.col("place")
    offset = _offset(F.col("source"), seed)
    copies = F.floor(step * rate + offset) - F.floor((step - 1) * rate + offset)
    rows = rows.withColumn("copies", F.least(copies, F.lit(MOST_COPIES)).cast("long"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept.

    Rows that share a doc_id are dealt their copies in the order of size and text; a row with a null
    doc_id is dealt them the same way. doc_id names documents, so few rows share one.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    dealt = systematic_mix(docs, **options).select(key.alias("__key"), "source", "size", "copies")
    dealt = dealt.groupBy("__key").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("\0null")).alias("source"), "size", "copies"))).alias("__dealt")
    )
    order = Window.partitionBy("__key").orderBy(
        F.coalesce("source", F.lit("\0null")), word_count(F.col("text")), "text"
    )
    rows = docs.withColumn("__key", key).withColumn("__place", F.row_number().over(order))
    copies = F.element_at("__dealt", F.col("__place"))["copies"]
    return (
        rows.join(dealt, "__key")
        .where(copies > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
