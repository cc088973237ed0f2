"""Turning faults into incidents: a deterministic rule analyzer and the hook for a model.

Analysis is the dear step, so callers pass one row per signature, never raw entries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultfold.functions.display import iso_utc
from faultfold.functions.prompts import prompt_verdict
from faultfold.operators.answers import PROMPT_VERDICT, incidents_of, read_verdict
from faultfold.schemas import ACTION_PLAN, INCIDENT_COLUMNS, INCIDENT_FIELDS

# Topic of a message, the words that tell it, and what the rule analyzer says about it.
RULES = [
    ("storage", "write failed", "HIGH", "DevOps error: the store rejects writes",
     "Start at the storage cluster", ["Check disk and quota", "Restart the writer"]),
    ("duplicate", "already exists", "LOW", "User error: the record is there already",
     "Start at the sign-up form", ["Tell the user to sign in"]),
    ("access", "token", "MEDIUM", "User error: the credential was rejected",
     "Start at the identity provider", ["Rotate the credential", "Check the clock"]),
    ("latency", "timeout", "MEDIUM", "DevOps error: an upstream answers too late",
     "Start at the upstream service", ["Check upstream health", "Raise the timeout"]),
]
UNKNOWN_CAUSE = "The log does not hold enough context to tell the cause"
UNKNOWN_ADVICE = "Collect more context before acting"


def _by_topic(message: Column, values: list, otherwise: Column) -> Column:
    chosen = otherwise
    for (_, words, *_), value in reversed(list(zip(RULES, values, strict=True))):
        chosen = F.when(F.contains(message, F.lit(words)), value).otherwise(chosen)
    return chosen


def _steps(actions: list[str]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(action).alias("action"),
                F.lit("Watch the error rate" if i else "").alias("warning"),
            )
            for i, action in enumerate(actions)
        ]
    )


def rule_analyzer(faults: DataFrame) -> DataFrame:
    """Add the incident columns by fixed rules; native expressions only.

    Needs severity, service_name, log_message, first_seen and last_seen.
    """
    text = F.lower("log_message")
    impact = F.when(F.col("severity") == "CRITICAL", "CRITICAL").otherwise(
        _by_topic(text, [F.lit(r[2]) for r in RULES], F.lit("LOW"))
    )
    summary = F.concat_ws(
        " ", "severity", F.lit("in"), F.coalesce("service_name", F.lit("unknown service")),
        F.lit("-"), "log_message",
    )
    added = {
        "operational_summary": summary,
        "business_impact": impact,
        "root_cause": _by_topic(text, [F.lit(r[3]) for r in RULES], F.lit(UNKNOWN_CAUSE)),
        "ai_suggestion": _by_topic(text, [F.lit(r[4]) for r in RULES], F.lit(UNKNOWN_ADVICE)),
        "first_seen_timestamp": iso_utc(F.col("first_seen")),
        "last_seen_timestamp": iso_utc(F.col("last_seen")),
        "action_plan": _by_topic(
            text, [_steps(r[5]) for r in RULES], F.array().cast(ACTION_PLAN)
        ).cast(ACTION_PLAN),
    }
    kept = [c for c in faults.columns if c not in added]
    return faults.select(*kept, *[v.alias(n) for n, v in added.items()])


def with_incidents(asked: DataFrame) -> DataFrame:
    """``_answer``, a checked list, as incident columns: a row for each incident and its number from 0.

    A row without an answer and one with an empty list keep one row of nulls; ``analysis_error`` tells
    them apart.
    """
    parsed = F.from_json("_answer", f"array<struct<{INCIDENT_FIELDS}>>")
    kept = [c for c in asked.columns if c not in ("_answer", *INCIDENT_COLUMNS)]
    return asked.select(*kept, F.posexplode_outer(parsed).alias("incident_no", "_incident")).select(
        *kept, "incident_no", "_incident.*"
    )


def model_analyzer(
    call: Callable[[list[dict], str | None], str],
    instruction: str | None = None,
    judge: Callable[[str], dict] | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """An analyzer around ``call(entries, instruction) -> JSON of an incident list``.

    ``call`` runs in the Python workers, once per fault row. A raised error and an answer that has not
    the agreed shape become the row's ``analysis_error``; an empty list leaves the incident columns
    null, a longer one makes a row of each. Each entry carries its signature, which serves as idempotency key
    when Spark repeats a task. The instruction has to pass :func:`usable_instruction`.
    """

    def analyze(faults: DataFrame) -> DataFrame:
        usable = usable_instruction(faults.sparkSession, instruction, judge)
        entry = F.to_json(F.struct("signature", "severity", "service_name", "log_message",
                                   "first_seen", "last_seen"))
        rows = faults.withColumn("_entry", entry)
        text = T.StringType()
        added = [T.StructField("_answer", text), T.StructField("analysis_error", text)]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    incidents_of(call, [json.loads(e.as_py())], usable) for e in batch.column("_entry")
                ]
                answers = pa.array([a for a, _ in found], pa.string())
                errors = pa.array([e for _, e in found], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, answers, errors], [*batch.schema.names, "_answer", "analysis_error"]
                )

        # The columns of a fault go through the worker beside its answer, so nothing is joined back.
        asked = rows.mapInArrow(ask, T.StructType([*rows.schema.fields, *added]))
        return with_incidents(asked.drop("_entry"))

    return analyze


_ANALYZERS: dict[str, Callable[[DataFrame], DataFrame]] = {"rules": rule_analyzer}


def add_analyzer(name: str, analyzer: Callable[[DataFrame], DataFrame]) -> None:
    _ANALYZERS[name.lower()] = analyzer


def get_analyzer(name: str) -> Callable[[DataFrame], DataFrame]:
    """Look an analyzer up by name, in any case."""
    try:
        return _ANALYZERS[name.lower()]
    except KeyError:
        raise ValueError(f"Unsupported analyzer: {name!r}") from None


def _judged(judge: Callable[[str], dict], prompt: str) -> dict:
    """The verdict on a prompt; a judge that fails lets nothing pass."""
    try:
        return read_verdict(judge(prompt), PROMPT_VERDICT)
    except Exception as problem:
        reason = f"judge failed: {type(problem).__name__}: {problem}"
        return {"is_safe": False, "reason": reason, "refined_instruction": None}


def check_prompts(
    prompts: DataFrame,
    judge: Callable[[str], dict] | None = None,
    column: str = "prompt",
) -> DataFrame:
    """Add is_safe, rule, reason and refined_instruction to a table of prompts.

    The deny rules run first; only prompts that pass them reach ``judge``, which returns is_safe,
    reason and refined_instruction. Without a judge a passing prompt is safe as it stands.
    """
    rule, reason = prompt_verdict(F.col(column))
    ruled = prompts.withColumns({"rule": rule, "reason": reason})
    if judge is None:
        safe = F.col("rule").isNull()
        return ruled.withColumns(
            {"is_safe": safe, "refined_instruction": F.when(safe, F.col(column))}
        )

    def second_look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            verdicts = [_judged(judge, p) for p in batch[column]]
            yield pd.DataFrame(
                {
                    column: batch[column],
                    "is_safe": [bool(v["is_safe"]) for v in verdicts],
                    "_reason": pd.Series([v["reason"] for v in verdicts], dtype="object"),
                    "refined_instruction": pd.Series(
                        [v["refined_instruction"] if v["is_safe"] else None for v in verdicts],
                        dtype="object",
                    ),
                }
            )

    asked = (
        ruled.where(F.col("rule").isNull())
        .select(column)
        .distinct()
        .mapInPandas(
            second_look,
            f"{column} string, is_safe boolean, _reason string, refined_instruction string",
        )
    )
    return ruled.join(asked, column, "left").select(
        *prompts.columns,
        "rule",
        F.coalesce("reason", "_reason").alias("reason"),
        F.coalesce("is_safe", F.lit(False)).alias("is_safe"),
        "refined_instruction",
    )


def usable_instruction(spark, instruction: str | None, judge=None) -> str | None:
    """The refined instruction to append to the analyzer's rules; an unsafe one rejects the call."""
    if not instruction:
        return None
    row = check_prompts(spark.createDataFrame([(instruction,)], "prompt string"), judge).first()
    if not row["is_safe"]:
        raise ValueError(f"unsafe instruction: {row['reason']}")
    return row["refined_instruction"]
