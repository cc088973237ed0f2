"""Answers of models: what passes, what is an error, and that an error is never taken for silence."""

import json

import pytest
from pyspark.sql import functions as F

from faultfold.operators import analysis, batches
from faultfold.operators.answers import MalformedAnswer, incidents_of, read_answer, read_verdict
from faultfold.plans.hooks import ERRORS, incident, mixed_call

ENTRY = {"severity": "ERROR", "log_message": "boom", "service_name": "api", "signature": "f0"}
GOOD = incident(ENTRY)
STEP = {"step": 1, "action": "a", "warning": "w"}


def plan(**change):
    return {"incidents": [{**GOOD, "action_plan": [{**STEP, **change}]}]}


BAD = [
    ("not json", "not JSON"),
    ("", "not JSON"),
    ("[]", "a list, not an object"),
    ("null", "null, not an object"),
    ("{}", "incidents is missing"),
    ('{"incidents": null}', "incidents is null, not a list"),
    ('{"incidents": "disk is full"}', "incidents is a text, not a list"),
    ('{"incidents": {"operational_summary": "x"}}', "incidents is an object, not a list"),
    ('{"incidents": [[]]}', r"incidents\[0\] is a list, not an object"),
    ('{"incidents": [{"summary": "x"}]}', "operational_summary is missing"),
    (json.dumps({"incidents": [GOOD, {**GOOD, "root_cause": None}]}), r"incidents\[1\].root_cause is null"),
    (json.dumps({"incidents": [{**GOOD, "business_impact": 3}]}), "business_impact is a number"),
    (json.dumps({"incidents": [{**GOOD, "service_name": True}]}), "service_name is a truth value"),
    (json.dumps({"incidents": [{k: v for k, v in GOOD.items() if k != "service_name"}]}), "service_name is missing"),
    (json.dumps({"incidents": [{**GOOD, "action_plan": "restart"}]}), "action_plan is a text, not a list"),
    (json.dumps({"incidents": [{**GOOD, "action_plan": ["restart"]}]}), r"action_plan\[0\] is a text, not an object"),
    (json.dumps(plan(step="one")), "step is a text"),
    (json.dumps(plan(step=1.5)), "step is a number, not a whole number"),
    (json.dumps(plan(step=True)), "step is a truth value"),
    (json.dumps(plan(step=1 << 40)), "out of range"),
    (json.dumps(plan(warning=None)), "warning is null"),
    (None, "NoneType, not a text"),
    ({"incidents": []}, "dict, not a text"),
]


@pytest.mark.parametrize("answer, problem", BAD)
def test_malformed_answers(answer, problem):
    with pytest.raises(MalformedAnswer, match=problem):
        read_answer(answer)
    found, error = incidents_of(lambda e, i: answer, [ENTRY], None)
    assert found is None and error.startswith("MalformedAnswer: ")


def test_good_answers():
    assert read_answer('{"incidents": []}') == []
    assert read_answer(json.dumps({"incidents": [GOOD], "model": "m"})) == [GOOD]
    assert read_answer(json.dumps({"incidents": [{**GOOD, "service_name": None, "mood": 1}]})) == [{**GOOD, "service_name": None}]
    for step in (2, 2.0, "2", " 2 "):
        assert read_answer(json.dumps(plan(step=step)))[0]["action_plan"] == [{**STEP, "step": 2}]


def test_errors_can_be_stored():
    def call(entries, instruction):
        raise RuntimeError("half a character \ud800")

    assert incidents_of(call, [ENTRY], None) == (None, "RuntimeError: half a character ?")
    found, _ = incidents_of(lambda e, i: json.dumps({"incidents": [{**GOOD, "root_cause": "\ud800é"}]}), [ENTRY], None)
    assert found.isascii()


def test_verdicts():
    fields = {"is_safe": (bool,), "reason": (str, type(None))}
    assert read_verdict({"is_safe": True, "reason": None, "x": 1}, fields) == {"is_safe": True, "reason": None}
    for bad in (None, "yes", {"is_safe": "true", "reason": "r"}, {"is_safe": True}, {"is_safe": 1, "reason": "r"}):
        with pytest.raises(MalformedAnswer):
            read_verdict(bad, fields)


def test_shapes_through_both_analyzers(spark):
    """Each letter of a signature is a shape; a malformed answer is an error in both, never silence."""
    letters = "0123456789abcdef"
    rows = [(f"{c}1", "ERROR", "api", f"text {c}", 1) for c in letters]
    faults = spark.createDataFrame(rows, "signature string, severity string, service_name string, log_message string, incident_count long")
    faults = faults.withColumns({c: F.lit("2024-05-01 00:00:00").cast("timestamp") for c in ("first_seen", "last_seen")})
    found = {}
    for r in analysis.model_analyzer(mixed_call)(faults).collect():
        found.setdefault(r["signature"][0], []).append(r)
    assert {c: r[0]["analysis_error"] for c, r in found.items() if r[0]["analysis_error"]} == ERRORS
    assert all(r["operational_summary"] is None for c in ERRORS for r in found[c])
    assert [(r["incident_no"], r["operational_summary"], r["analysis_error"]) for r in found["7"]] == [(None, None, None)]
    assert [r["business_impact"] for r in found["8"]] == ["HIGH", "LOW"] and found["a"][0]["service_name"] is None
    assert found["b"][0]["action_plan"][1]["warning"] == "slowly"

    entries = faults.selectExpr("signature as batch", "signature as insert_id", "first_seen as ts", "severity", "service_name", "log_message", "signature", "10 as bytes")

    def call(rows_, instruction):
        return mixed_call([{**rows_[0], "signature": rows_[0]["insert_id"]}], instruction)

    outcome = {}
    for r in batches.analyze_batches(entries, "batch", batches.model_batches(call)).collect():
        outcome.setdefault(r["batch"][0], []).append((r["outcome"], r["reason"]))
    assert {c: o[0][1] for c, o in outcome.items() if o[0][0] == "error"} == ERRORS
    assert outcome["7"] == [("nothing", None)] and len(outcome["8"]) == 2 and outcome["f"] == [("incident", None)]


@pytest.mark.parametrize("verdict", [{"is_safe": "no", "reason": "r", "refined_instruction": "x"}, {"is_safe": True}, "safe", None])
def test_malformed_verdicts_let_nothing_pass(spark, verdict):
    with pytest.raises(ValueError, match="judge failed: MalformedAnswer"):
        analysis.usable_instruction(spark, "sort by zone", lambda p: verdict)
