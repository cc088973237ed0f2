"""Processed events, signature claims and the signature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.operators.prefix import number_rows
from faultfold.operators.rollup import EVENT_ORDER

CLAIMED = "claimed"
FOLLOWED_READY = "followed_ready"
FOLLOWED_PENDING = "followed_pending"
PENDING = "pending"
READY = "ready"
COMPLETED = "COMPLETED"
FAILED = "FAILED"


def ledger_status(writes: DataFrame) -> DataFrame:
    """Current state of an append-only ledger: the last write of an insert id wins."""
    latest = F.max(F.struct("processed_timestamp", "status"))
    return writes.groupBy("insert_id").agg(latest.alias("w")).select(
        "insert_id", "w.status", "w.processed_timestamp"
    )


def new_events(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries never processed, each once. Any ledger status counts as processed.

    One entry per insert id is left before the join. The join type is left to Spark, which
    broadcasts the ledger only while it measures small.
    """
    seen = ledger.select("insert_id")
    return events.dropDuplicates(["insert_id"]).join(seen, "insert_id", "left_anti")


def claim_outcomes(signed: DataFrame, signatures: DataFrame) -> DataFrame:
    """What each entry does to its signature.

    A signature without a record is claimed by its first entry and pending for the others. A ready
    one is followed, and its count grows by one per entry. A pending one makes every entry wait.
    """
    numbered = number_rows(signed.select("signature", *EVENT_ORDER), ["signature"], EVENT_ORDER)
    record = signatures.select(
        "signature",
        F.col("status").alias("_status"),
        F.col("count").alias("_count"),
        F.col("report_id"),
    )
    both = numbered.join(record, "signature", "left")
    is_new = F.col("_status").isNull()
    is_ready = (F.col("_status") == READY) & F.col("report_id").isNotNull()
    outcome = (
        F.when(is_new & (F.col("position") == 1), CLAIMED)
        .when(is_ready, FOLLOWED_READY)
        .otherwise(FOLLOWED_PENDING)
    )
    stored = F.coalesce(F.col("_count"), F.lit(1))
    count = F.when(is_ready, stored + F.col("position")).otherwise(stored)
    return both.select(
        "insert_id",
        "signature",
        outcome.alias("outcome"),
        "report_id",
        count.cast("bigint").alias("count"),
    )


def release(signatures: DataFrame, released: DataFrame) -> DataFrame:
    """Delete claims, so that the next entry of the signature claims it again."""
    return signatures.join(released.select("signature"), "signature", "left_anti")


def fold_signatures(parts: DataFrame) -> DataFrame:
    """Merge signature rows of the same key: counts add up, the latest state wins.

    A union folded by one aggregation needs a single shuffle and combines on the map side, unlike
    a full outer join of table and changes.
    """
    by_update = F.struct("updated_at", "status", "report_id")
    by_create = F.struct("created_at", "log_message", "severity")
    return (
        parts.groupBy("signature")
        .agg(
            F.max(by_update).alias("u"),
            F.min(by_create).alias("c"),
            F.sum("count").alias("count"),
            F.max("report_id").alias("report_id"),
        )
        .select(
            "signature",
            F.when(F.col("report_id").isNotNull(), READY).otherwise(F.col("u.status")).alias("status"),
            "count",
            "c.created_at",
            "u.updated_at",
            "c.log_message",
            "c.severity",
            "report_id",
        )
    )


def signature_rows(rollup: DataFrame, report_id, status: str) -> DataFrame:
    """Signature records for a rollup."""
    return rollup.select(
        "signature",
        F.lit(status).alias("status"),
        F.col("incident_count").alias("count"),
        F.col("first_seen").alias("created_at"),
        F.col("last_seen").alias("updated_at"),
        "log_message",
        "severity",
        report_id.alias("report_id"),
    )
