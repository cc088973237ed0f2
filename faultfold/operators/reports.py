"""Incident reports: creating, counting, filtering, listing and exporting them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.display import iso_utc, present
from faultfold.functions.fingerprint import report_id
from faultfold.functions.periods import parse_period
from faultfold.functions.severity import normalize_impact
from faultfold.schemas import INCIDENT_COLUMNS

_UNSET = object()

REPORT_COLUMNS = [
    "id",
    *INCIDENT_COLUMNS,
    "severity",
    "signature",
    "log_message",
    "last_insert_id",
    "incident_count",
    "created_at",
]


def make_reports(incidents: DataFrame, created_at: Column | None = None) -> DataFrame:
    """A report row for each incident; created when the fault was first seen unless told."""
    created = F.col("first_seen") if created_at is None else created_at
    first = F.col("first_insert_id")
    if "incident_no" in incidents.columns:
        # Further incidents of the same answer get ids of their own.
        number = F.when(F.col("incident_no") > 0, F.concat(F.lit("#"), "incident_no"))
        first = F.concat_ws("", first, number)
    return incidents.select(
        report_id(F.col("signature"), first).alias("id"),
        *INCIDENT_COLUMNS,
        "severity",
        "signature",
        "log_message",
        "last_insert_id",
        F.col("incident_count").cast("bigint").alias("incident_count"),
        created.alias("created_at"),
    )


def newest_first(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.desc("created_at"), "id")


def get_report(reports: DataFrame, report: str) -> DataFrame:
    """The report with this id, or no row."""
    return reports.where(F.col("id") == report)


def severity_is(severity: str) -> Column:
    """Any case on both sides; an empty argument filters nothing."""
    if not severity:
        return F.lit(True)
    return F.upper(F.coalesce("severity", F.lit(""))) == severity.upper()


def service_is(service) -> Column:
    """Null-safe: ``None`` finds the reports without a service."""
    return F.col("service_name").eqNullSafe(F.lit(service))


def impact_is(impact: str) -> Column:
    if not impact:
        return F.lit(True)
    return normalize_impact(F.col("business_impact")) == impact


def created_within(period: str, as_of: dt.datetime) -> Column:
    start = as_of - parse_period(period)
    return F.col("created_at") >= F.lit(start.isoformat(sep=" ")).cast("timestamp")


def find_reports(
    reports: DataFrame,
    period: str,
    as_of: dt.datetime,
    severity=_UNSET,
    service_name=_UNSET,
    signature=_UNSET,
) -> DataFrame:
    """Reports of the look-back period, newest first.

    A filter left out does not filter; a filter given as ``None`` finds nulls.
    """
    found = reports.where(created_within(period, as_of))
    asked = {"severity": severity, "service_name": service_name, "signature": signature}
    for column, value in asked.items():
        if value is not _UNSET:
            found = found.where(F.col(column).eqNullSafe(F.lit(value)))
    return newest_first(found)


def filter_reports(
    reports: DataFrame, severity: str = "", service: str = "", impact: str = ""
) -> DataFrame:
    """The dashboard's three filters; an empty argument filters nothing."""
    kept = reports.where(severity_is(severity) & impact_is(impact))
    return kept.where(F.col("service_name") == service) if service else kept


def follower_deltas(followers: DataFrame) -> DataFrame:
    """Per report: how many entries followed it, and the last of them.

    Needs report_id, ts and insert_id. Counts combine before the shuffle.
    """
    with_id = F.when(present(F.col("insert_id")).isNotNull(), F.struct("ts", "insert_id"))
    return followers.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("more"),
        F.max("ts").alias("last_seen"),
        F.max(with_id)["insert_id"].alias("last_insert_id"),
    )


def apply_deltas(reports: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counter and last sighting after the followers.

    Both sides are unique per report, so no key is hot here.
    """
    d = deltas.select(
        F.col("report_id").alias("id"),
        "more",
        F.col("last_seen").alias("_last_seen"),
        F.col("last_insert_id").alias("_last_insert_id"),
    )
    changed = {
        "incident_count": F.coalesce("incident_count", F.lit(0)) + F.coalesce("more", F.lit(0)),
        "last_seen_timestamp": F.coalesce(iso_utc(F.col("_last_seen")), "last_seen_timestamp"),
        "last_insert_id": F.coalesce("_last_insert_id", "last_insert_id"),
    }
    return (
        reports.join(d, "id", "left").withColumns(changed).select(*reports.columns)
    )


def upsert_reports(reports: DataFrame, inserts: DataFrame, deltas: DataFrame) -> DataFrame:
    """New reports added and existing ones counted on."""
    return apply_deltas(reports.unionByName(inserts), deltas)


def export_json(reports: DataFrame) -> DataFrame:
    """One JSON document per report, timestamps as ISO text, nested values included."""
    row = F.struct(
        *[
            (iso_utc(F.col(c)).alias(c) if t == "timestamp" else F.col(c))
            for c, t in reports.dtypes
        ]
    )
    return reports.select("id", F.to_json(row, {"ignoreNullFields": "false"}).alias("document"))
