"""The signature of an error: what makes two log entries the same fault."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultfold.functions.severity import upper_severity


def canonical_labels(labels: Column) -> Column:
    """Labels as JSON with sorted keys, so that key order never splits a fault."""
    ordered = F.to_json(F.map_from_entries(F.sort_array(F.map_entries(labels))))
    return F.coalesce(ordered, F.lit("{}"))


def signature(labels: Column, severity: Column, redacted_message: Column) -> Column:
    return F.md5(
        F.concat_ws(
            "|",
            canonical_labels(labels),
            upper_severity(severity),
            F.coalesce(redacted_message, F.lit("")),
        )
    )


def report_id(signature_: Column, first_insert_id: Column) -> Column:
    """Deterministic, so that a replayed batch writes the same report again."""
    return F.md5(F.concat(signature_, F.lit("|"), F.coalesce(first_insert_id, F.lit(""))))
