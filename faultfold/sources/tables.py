"""Reading tables, and the log-entry view over an ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold.schemas import LOG_SCHEMA, REPORT_SCHEMA

_FORMATS = {"parquet", "orc", "json"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_logs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Log entries stored in the log schema; JSON lines by default."""
    if fmt not in _FORMATS:
        raise ValueError(f"unsupported log format: {fmt!r}")
    return spark.read.schema(LOG_SCHEMA).format(fmt).load(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).parquet(path)


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_severity() -> Column:
    by_type = (
        F.when(F.col("event_type") == "signup", "WARNING")
        .when(F.col("event_type") == "purchase", "NOTICE")
        .when(F.col("event_type") == "click", "INFO")
        .when(F.col("event_type") == "view", "DEBUG")
    )
    error = F.when(F.col("value") >= 100, "CRITICAL").otherwise("ERROR")
    return F.when(F.col("event_type") == "error", error).otherwise(by_type)


def event_message() -> Column:
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("Record write failed  code "), (props_k() % 5).cast("string")))
        .when(kind == 1, F.concat(F.lit("Email user"), user, F.lit("@example.com\nalready exists")))
        .when(kind == 2, F.concat(F.lit("auth token: k"), F.lpad(user, 19, "0"), F.lit(" rejected")))
        .otherwise(
            F.concat(
                F.lit("Upstream timeout, card "),
                (F.col("user_id") + F.lit(4000000000000000)).cast("string"),
            )
        )
    )


def logs_from_events(events: DataFrame) -> DataFrame:
    """Log entries over ``events``: half carry a structured payload, half a text payload.

    Only expressions over the scanned columns, so filters and pruning reach the Parquet reader.
    """
    message = event_message()
    structured = (F.col("event_id") % 4).isin(0, 3)
    payload = F.try_parse_json(
        F.to_json(F.struct(message.alias("message"), props_k().alias("error_code")))
    )
    labels = F.create_map(
        F.lit("service_name"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")),
        F.lit("location"),
        F.concat(F.lit("zone-"), (F.col("user_id") % 3).cast("string")),
    )
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").cast("string").alias("insert_id"),
        F.concat(F.lit("projects/demo/logs/"), F.col("event_type")).alias("log_name"),
        ts.alias("ts"),
        ts.alias("receive_ts"),
        event_severity().alias("severity"),
        F.struct(F.lit("cloud_run_revision").alias("type"), labels.alias("labels")).alias("resource"),
        F.when(~structured, message).alias("text_payload"),
        F.when(structured, payload).alias("json_payload"),
    )


def logs(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> DataFrame:
    """The view over the ``events`` table. Severity and log name are derived from the event type, so a
    caller whose filter implies one names it: that predicate reaches the Parquet reader."""
    events = read_table(spark, sf_dir, "events")
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    return logs_from_events(events)
