"""Views over the given tables that the registered queries start from.

Every view covers its whole table; times split history from what is new.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold.functions.fingerprint import report_id
from faultfold.functions.jsontext import compact_json, escaped_bytes
from faultfold.functions.once import compute_once
from faultfold.operators import claims, reports, rollup
from faultfold.operators.analysis import rule_analyzer
from faultfold.operators.selection import exportable, sanitize, service_of
from faultfold.sources.tables import logs, read_table

SELF_SERVICE = "log-triage"
CUTOFF = dt.datetime(2024, 1, 16)
AS_OF = dt.datetime(2024, 1, 31)
PENDING_SINCE = dt.datetime(2024, 1, 15)


def moment(at: dt.datetime):
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def error_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only error events have a severity that the export takes.
    return logs(spark, sf_dir, "error").where(exportable(SELF_SERVICE))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.with_signature(error_logs(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors before the cut-off: what is already in the stores."""
    return rollup.with_signature(error_logs(spark, sf_dir).where(F.col("ts") < moment(CUTOFF)))


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors from the cut-off on."""
    return rollup.with_signature(error_logs(spark, sf_dir).where(F.col("ts") >= moment(CUTOFF)))


def signature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature table at the cut-off; the youngest claims are still pending."""
    rolled = rollup.incident_rollup(history(spark, sf_dir))
    open_claim = F.col("first_seen") >= moment(PENDING_SINCE)
    rid = F.when(~open_claim, report_id(F.col("signature"), F.col("first_insert_id")))
    rows = claims.signature_rows(rolled, rid, claims.READY)
    return rows.withColumn(
        "status", F.when(F.col("report_id").isNull(), claims.PENDING).otherwise(claims.READY)
    )


def all_reports(spark: SparkSession, sf_dir: str, faults: DataFrame | None = None) -> DataFrame:
    """One report per signature over all errors, by the rule analyzer.

    ``faults`` are the signed errors, where a caller has them at hand.
    """
    faults = signed(spark, sf_dir) if faults is None else faults
    return reports.make_reports(rule_analyzer(rollup.incident_rollup(faults)))


def history_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.make_reports(rule_analyzer(rollup.incident_rollup(history(spark, sf_dir))))


def worn_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as years of writers leave them: free impact texts, gaps, zero counters."""
    base = all_reports(spark, sf_dir)
    mark = F.substring("signature", 1, 1)
    n = F.col("incident_count")
    impact = F.col("business_impact")
    changed = {
        "business_impact": F.when(n % 5 == 0, F.concat(F.lit(" "), F.lower(impact), F.lit(" impact ")))
        .when(n % 5 == 1, "not assessed")
        .otherwise(impact),
        "service_name": F.when(mark == "f", F.lit(None).cast("string"))
        .when(mark == "e", "")
        .otherwise(F.col("service_name")),
        "incident_count": F.when(n % 7 == 0, F.lit(None).cast("bigint"))
        .when(n % 11 == 0, F.lit(0).cast("bigint"))
        .otherwise(n),
        "severity": F.when(mark == "d", F.lower("severity"))
        .when(mark == "c", "")
        .otherwise(F.col("severity")),
        "last_seen_timestamp": F.when(mark == "0", "")
        .when(mark == "1", "yesterday")
        .otherwise(F.col("last_seen_timestamp")),
        "action_plan": F.when(mark == "b", F.array().cast(base.schema["action_plan"].dataType))
        .otherwise(F.col("action_plan")),
    }
    return base.withColumns(changed)


def ledger_writes(spark: SparkSession, sf_dir: str, until: dt.datetime | None = None) -> DataFrame:
    """Ledger writes of all errors, or of those before ``until``: critical entries fail; what came
    before noon completes later."""
    past = error_logs(spark, sf_dir).select("insert_id", "ts", "severity")
    if until is not None:
        past = past.where(F.col("ts") < moment(until))
    first = past.select(
        "insert_id",
        F.when(F.col("severity") == "CRITICAL", claims.FAILED).otherwise(claims.COMPLETED).alias("status"),
        F.col("ts").alias("processed_timestamp"),
    )
    again = past.where(F.hour("ts") < 12).select(
        "insert_id",
        F.lit(claims.COMPLETED).alias("status"),
        (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("processed_timestamp"),
    )
    return first.unionByName(again)


def hourly_incidents(spark: SparkSession, sf_dir: str, faults: DataFrame | None = None) -> DataFrame:
    """Incidents of hourly batches per service: one per signature and hour, analysed by rules."""
    hour = F.date_trunc("hour", F.col("ts"))
    faults = signed(spark, sf_dir) if faults is None else faults
    s = faults.withColumn("hour", hour)
    rolled = s.groupBy("signature", "hour").agg(
        F.min("severity").alias("severity"),
        F.min("service_name").alias("service_name"),
        F.min("log_message").alias("log_message"),
        F.count(F.lit(1)).alias("incident_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.min(F.struct("ts", "insert_id"))["insert_id"].alias("first_insert_id"),
        F.max(F.struct("ts", "insert_id"))["insert_id"].alias("last_insert_id"),
    )
    named = rolled.withColumns(
        {
            "incident_id": F.md5(
                F.concat_ws("|", "signature", F.date_format("hour", "yyyy-MM-dd HH"))
            ),
            "as_of": F.col("first_seen"),
        }
    )
    return rule_analyzer(named)


def sized_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitized entries of every severity with the bytes each takes in a JSON payload."""
    clean = sanitize(logs(spark, sf_dir)).withColumn("service_name", service_of())
    row = F.struct("severity", "service_name", "message")
    written = compute_once(clean, _json=compact_json(row))
    return written.select(
        "insert_id", "ts", "service_name", escaped_bytes(F.col("_json")).alias("bytes")
    )


def sized_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed entries of every severity with the bytes each takes in a JSON payload."""
    signed_rows = rollup.with_signature(logs(spark, sf_dir))
    row = F.struct("severity", "service_name", F.col("log_message").alias("message"))
    written = compute_once(signed_rows, _json=compact_json(row))
    return written.withColumn("bytes", escaped_bytes(F.col("_json"))).drop("_json")


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    written = compute_once(docs, _json=compact_json(F.struct("doc_id", "text")))
    return written.select("doc_id", "source", escaped_bytes(F.col("_json")).alias("bytes"))


