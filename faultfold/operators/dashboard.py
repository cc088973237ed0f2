"""What the operator asks of the reports: figures, rollups, tables, details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.functions.display import or_dash, present, show_timestamp
from faultfold.functions.severity import IMPACTS, count_or_one, normalize_impact


def report_kpis(reports: DataFrame, exact: bool = True) -> DataFrame:
    """Reports, occurrences, critical and high reports, services touched: one pass, one row.

    ``exact=False`` counts services with a sketch, for very many of them.
    """
    impact = normalize_impact(F.col("business_impact"))
    service = present(F.col("service_name"))
    services = F.count_distinct(service) if exact else F.approx_count_distinct(service)
    return reports.agg(
        F.count(F.lit(1)).alias("reports"),
        F.coalesce(F.sum(count_or_one(F.col("incident_count"))), F.lit(0.0)).alias("occurrences"),
        F.count_if(impact == "CRITICAL").alias("critical"),
        F.count_if(impact == "HIGH").alias("high"),
        services.alias("services"),
    )


def impact_rollup(reports: DataFrame) -> DataFrame:
    """Occurrences per impact level in fixed order, zero where there are none, unknown left out."""
    impact = normalize_impact(F.col("business_impact"))
    weight = count_or_one(F.col("incident_count"))
    totals = reports.agg(
        *[F.sum(F.when(impact == level, weight)).alias(level) for level in IMPACTS]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("ord"),
                F.lit(level).alias("impact"),
                F.coalesce(level, F.lit(0.0)).alias("count"),
            )
            for i, level in enumerate(IMPACTS)
        ]
    )
    return totals.select(F.inline(rows))


def service_list(reports: DataFrame) -> DataFrame:
    """Distinct service names in binary order, empty ones left out."""
    named = reports.where(present(F.col("service_name")).isNotNull())
    return named.select("service_name").distinct().orderBy("service_name")


def filter_counts(reports: DataFrame, kept) -> DataFrame:
    """"n of m" for a filter: both counts in one pass."""
    return reports.agg(
        F.count_if(kept).alias("shown"), F.count(F.lit(1)).alias("total")
    )


def report_table(reports: DataFrame) -> DataFrame:
    """The report list as shown."""
    created = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    last = F.coalesce(present(F.col("last_seen_timestamp")), created)
    return reports.select(
        "id",
        normalize_impact(F.col("business_impact")).alias("impact"),
        or_dash(F.col("severity")).alias("severity"),
        or_dash(F.col("service_name")).alias("service"),
        F.col("operational_summary").alias("summary"),
        F.coalesce("incident_count", F.lit(1)).alias("count"),
        show_timestamp(last).alias("last_seen"),
    )


def report_detail(reports: DataFrame) -> DataFrame:
    """The detail page's fields with their defaults."""
    impact = normalize_impact(F.col("business_impact"))
    raw = present(F.col("business_impact"))
    return reports.select(
        "id",
        F.coalesce(present(F.col("service_name")), F.lit("Unknown service")).alias("title"),
        F.col("operational_summary").alias("summary"),
        impact.alias("impact"),
        F.when(raw != impact, raw).alias("impact_note"),
        F.coalesce(present(F.col("severity")), F.lit("n/a")).alias("severity"),
        F.coalesce("incident_count", F.lit(1)).alias("occurrences"),
        or_dash(F.col("root_cause")).alias("root_cause"),
        or_dash(F.col("ai_suggestion")).alias("ai_suggestion"),
        show_timestamp(F.col("first_seen_timestamp")).alias("first_seen"),
        show_timestamp(F.col("last_seen_timestamp")).alias("last_seen"),
        or_dash(F.col("signature")).alias("signature"),
        present(F.col("log_message")).alias("log_message"),
    )


def action_plan_rows(reports: DataFrame) -> DataFrame:
    """One row per step in plan order; a report without a plan keeps one row that says so."""
    steps = reports.select("id", F.posexplode_outer("action_plan").alias("pos", "s"))
    return steps.select(
        "id",
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.col("s.step").alias("step"),
        F.coalesce("s.action", F.lit("No action plan recorded.")).alias("action"),
        present(F.col("s.warning")).alias("warning"),
    )
