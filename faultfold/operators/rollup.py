"""Signatures per entry, and one row of counts per signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.fingerprint import signature
from faultfold.functions.severity import upper_severity
from faultfold.operators.prefix import number_rows
from faultfold.operators.selection import sanitize, service_of

EVENT_ORDER = ["ts", "insert_id"]


def with_signature(logs: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """insert_id, ts, severity, service_name, log_message, signature for each entry."""
    clean = sanitize(logs, strict, keep=("insert_id", *keep))
    return clean.select(
        *keep,
        "insert_id",
        "ts",
        upper_severity(F.col("severity")).alias("severity"),
        service_of().alias("service_name"),
        F.col("message").alias("log_message"),
        signature(F.col("resource.labels"), F.col("severity"), F.col("message")).alias("signature"),
    )


def fault_totals() -> list[Column]:
    """The aggregates of a fault: what it is, occurrences, first and last sighting and insert id."""
    position = F.struct("ts", "insert_id")
    return [
        F.min("severity").alias("severity"),
        F.min("service_name").alias("service_name"),
        F.min("log_message").alias("log_message"),
        F.count(F.lit(1)).alias("incident_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min(position)["insert_id"].alias("first_insert_id"),
        F.max(position)["insert_id"].alias("last_insert_id"),
    ]


def incident_rollup(signed: DataFrame) -> DataFrame:
    """Occurrences, first and last sighting, first and last insert id per signature.

    Every aggregate merges, so map tasks shrink a hot signature to one row before the shuffle.
    """
    return signed.groupBy("signature").agg(*fault_totals())


def claim_winners(signed: DataFrame) -> DataFrame:
    """The first entry of each signature: the only one that gets analysed."""
    first = F.min(F.struct("ts", "insert_id", "severity", "service_name", "log_message"))
    return signed.groupBy("signature").agg(first.alias("w")).select("signature", "w.*")


def running_counts(signed: DataFrame) -> DataFrame:
    """The count each entry sees: 1 for the first of its signature, k for the k-th."""
    return number_rows(signed, ["signature"], EVENT_ORDER, "running_count")
