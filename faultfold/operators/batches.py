"""On-demand analysis: entries in batches, one call per batch, one row per incident."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultfold.operators.analysis import rule_analyzer, usable_instruction, with_incidents
from faultfold.operators.answers import incidents_of
from faultfold.operators.limits import MAX_BYTES, MAX_ENTRIES, batch_limits
from faultfold.operators.rollup import fault_totals
from faultfold.schemas import INCIDENT_COLUMNS

INCIDENT, NOTHING, REJECTED, ERROR = "incident", "nothing", "rejected", "error"

# (accepted entries, batch key, instruction) -> rows of the key, analysis_error and INCIDENT_COLUMNS.
BatchAnalyzer = Callable[[DataFrame, str, str | None], DataFrame]


def rule_batches(entries: DataFrame, batch: str, instruction: str | None) -> DataFrame:
    """The rule analyzer over every fault of a batch. Rules take no instruction."""
    faults = entries.groupBy(batch, "signature").agg(*fault_totals())
    return rule_analyzer(faults).select(
        batch, F.lit(None).cast("string").alias("analysis_error"), *INCIDENT_COLUMNS
    )


def model_batches(call: Callable[[list[dict], str | None], str]) -> BatchAnalyzer:
    """``call(entries, instruction) -> JSON of an incident list``, once per batch, in the workers.

    Entries come in order of time. A raised error and a malformed answer become the batch's
    ``analysis_error``.
    """

    def analyze(entries: DataFrame, batch: str, instruction: str | None) -> DataFrame:
        row = F.to_json(F.struct("insert_id", "ts", "severity", "service_name", "log_message"))
        # A list has no more rows and bytes than the caps let an accepted batch have.
        listed = entries.groupBy(batch).agg(
            F.sort_array(F.collect_list(F.struct("ts", "insert_id", row.alias("row"))))["row"].alias("_rows")
        )

        def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                answers, errors = [], []
                for rows in part.column("_rows"):
                    answer, error = incidents_of(call, [json.loads(r.as_py()) for r in rows], instruction)
                    answers.append(answer)
                    errors.append(error)
                columns = [part.column(batch), pa.array(answers, pa.string()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [batch, "_answer", "analysis_error"])

        asked = listed.mapInArrow(
            ask,
            T.StructType(
                [
                    T.StructField(batch, entries.schema[batch].dataType),
                    T.StructField("_answer", T.StringType()),
                    T.StructField("analysis_error", T.StringType()),
                ]
            ),
        )
        return with_incidents(asked).select(batch, "analysis_error", *INCIDENT_COLUMNS)

    return analyze


def analyze_batches(
    entries: DataFrame,
    batch: str,
    analyzer: BatchAnalyzer = rule_batches,
    instruction: str | None = None,
    judge: Callable[[str], dict] | None = None,
    max_entries: int = MAX_ENTRIES,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Every batch with its incidents, one row each.

    ``entries`` carry the batch key, ``bytes``, insert_id, ts, severity, service_name, log_message and
    signature. A batch over the caps is not analysed; it is one row with the reason, as is one whose
    call failed; one without an incident is a row of nulls. An unsafe ``instruction`` raises before
    anything is analysed. A null batch key is a batch like any other.
    """
    usable = usable_instruction(entries.sparkSession, instruction, judge)
    limits = batch_limits(entries, [batch], max_entries, max_bytes)
    kept = limits.where("accepted").select(F.col(batch).alias("_batch"))
    accepted = entries.join(kept, F.col(batch).eqNullSafe(F.col("_batch")), "left_semi")
    answered = analyzer(accepted, batch, usable).select(
        F.col(batch).alias("_batch"), "analysis_error", *INCIDENT_COLUMNS
    )
    joined = limits.join(answered, F.col(batch).eqNullSafe(F.col("_batch")), "left")
    outcome = (
        F.when(~F.col("accepted"), REJECTED)
        .when(F.col("analysis_error").isNotNull(), ERROR)
        .when(F.col("operational_summary").isNull(), NOTHING)
        .otherwise(INCIDENT)
    )
    return joined.select(
        batch,
        "entries",
        outcome.alias("outcome"),
        F.coalesce("reason", "analysis_error").alias("reason"),
        *INCIDENT_COLUMNS,
    )
