"""Event envelopes: a log entry as base64 JSON inside a delivery message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.display import ISO_MICROS, iso_utc
from faultfold.functions.jsontext import opens_object, parse_whole
from faultfold.functions.once import compute_once
from faultfold.schemas import LABELS

# Reasons a delivery cannot be processed, in the order they are found out.
BAD_BASE64 = "bad_base64"
BAD_UTF8 = "bad_utf8"
BAD_JSON = "bad_json"
NOT_AN_OBJECT = "not_an_object"
MISSING_INSERT_ID = "missing_insert_id"


def entry_json() -> Column:
    """A log row as the JSON text that travels in an envelope; absent fields are left out."""
    return F.to_json(
        F.struct(
            F.col("insert_id").alias("insertId"),
            F.col("log_name").alias("logName"),
            iso_utc(F.col("ts")).alias("timestamp"),
            iso_utc(F.col("receive_ts")).alias("receiveTimestamp"),
            F.col("severity"),
            F.col("resource"),
            F.col("text_payload").alias("textPayload"),
            F.col("json_payload").alias("jsonPayload"),
        )
    )


def wrap(data: Column, subscription: str = "projects/demo/subscriptions/events") -> list[Column]:
    """Envelope columns around already encoded ``data``."""
    message = F.struct(
        data.alias("data"),
        F.concat(F.lit("m-"), F.col("insert_id")).alias("messageId"),
        iso_utc(F.col("receive_ts")).alias("publishTime"),
        F.create_map(F.lit("timestamp"), iso_utc(F.col("ts"))).alias("attributes"),
    )
    return [F.lit(subscription).alias("subscription"), message.alias("message")]


def encode(logs: DataFrame) -> DataFrame:
    written = compute_once(logs, _json=entry_json())
    return written.select(*wrap(F.base64(F.col("_json").cast("binary"))))


def decode(envelopes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Envelopes to log rows plus ``raw`` and ``reason``; ``reason`` is null for a good entry.

    Each step yields null instead of an error, so that one bad delivery cannot stop a batch.
    """
    step = envelopes.select(*keep, F.col("message.data").alias("raw"))
    step = compute_once(step, _bytes=F.try_to_binary("raw", F.lit("base64")))
    step = compute_once(step, _text=F.try_validate_utf8(F.col("_bytes").cast("string")))
    return _entries(step, keep)


def decode_json(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for entries that come as bare JSON text, as from ``spark.read.text``."""
    raw = F.col(column)
    step = texts.select(*keep, raw.alias("raw"), raw.cast("binary").alias("_bytes"))
    return _entries(compute_once(step, _text=F.try_validate_utf8("raw")), keep)


def _entries(step: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    step = parse_whole(step, "_text", "_entry")
    is_object = opens_object(F.col("_text"))
    insert_id = _get("$.insertId")
    reason = (
        F.when(F.col("_bytes").isNull(), BAD_BASE64)
        .when(F.col("_text").isNull(), BAD_UTF8)
        .when(F.col("_entry").isNull(), BAD_JSON)
        .when(~is_object, NOT_AN_OBJECT)
        .when(F.coalesce(insert_id, F.lit("")) == "", MISSING_INSERT_ID)
    )
    return step.select(
        *keep,
        "raw",
        reason.alias("reason"),
        insert_id.alias("insert_id"),
        _get("$.logName").alias("log_name"),
        _time("$.timestamp").alias("ts"),
        _time("$.receiveTimestamp").alias("receive_ts"),
        _get("$.severity").alias("severity"),
        F.when(
            F.try_variant_get("_entry", "$.resource", "variant").isNotNull(),
            F.struct(
                _get("$.resource.type").alias("type"),
                F.try_variant_get("_entry", "$.resource.labels", LABELS).alias("labels"),
            ),
        ).alias("resource"),
        _get("$.textPayload").alias("text_payload"),
        F.try_variant_get("_entry", "$.jsonPayload", "variant").alias("json_payload"),
    )


def _get(path: str) -> Column:
    return F.try_variant_get("_entry", path, "string")


def _time(path: str) -> Column:
    return F.coalesce(
        F.try_to_timestamp(_get(path), F.lit(ISO_MICROS)), F.try_to_timestamp(_get(path))
    )


def good(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNull()).drop("raw", "reason")


def objects_only(texts: DataFrame, column: str) -> DataFrame:
    """Keep rows whose JSON text is an object; other values are skipped, not errors."""
    parsed = parse_whole(texts, column, "_value")
    is_object = F.col("_value").isNotNull() & opens_object(F.col(column))
    return parsed.where(is_object).drop("_value")
