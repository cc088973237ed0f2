"""Callers and judges that the queries use in place of a model: deterministic, and often wrong.

Every way in which an answer may fail has its share, so that the queries show what becomes of it.
"""

from __future__ import annotations

import json

GOOD_PARTS = {"business_impact": "HIGH", "root_cause": "code", "ai_suggestion": "look", "first_seen_timestamp": "f", "last_seen_timestamp": "l"}


def incident(entry: dict, **changes) -> dict:
    made = {"operational_summary": f"{entry['severity']}: {entry['log_message']}", "service_name": entry.get("service_name"), **GOOD_PARTS}
    made["action_plan"] = [{"step": 1, "action": "look", "warning": ""}, {"step": 2, "action": "act", "warning": "slowly"}]
    return {**made, **changes}


def mixed_call(entries: list[dict], instruction: str | None) -> str:
    """An answer whose shape follows from the first letter of the signature."""
    entry = entries[0]
    good = incident(entry)
    shape = int(entry["signature"][0], 16)
    if shape == 0:
        raise RuntimeError("model is down")
    answers = {
        1: "no incident found",
        2: json.dumps({"incidents": "disk is full"}),
        3: json.dumps({"incidents": [{"summary": "x"}]}),
        4: json.dumps({"incidents": [good, {**good, "operational_summary": {"a": 1}}]}),
        5: json.dumps({"incidents": [{**good, "action_plan": [{"step": "one", "action": "a", "warning": "w"}]}]}),
        6: json.dumps({"incidents": [{k: v for k, v in good.items() if k != "service_name"}]}),
        7: json.dumps({"incidents": []}),
        8: json.dumps({"incidents": [good, {**good, "business_impact": "LOW", "action_plan": []}]}),
        9: json.dumps([good]),
        10: json.dumps({"incidents": [{**good, "service_name": None, "more": [1]}]}),
    }
    return answers.get(shape, json.dumps({"incidents": [good]}))


def calm_call(entries: list[dict], instruction: str | None) -> str:
    """An answer in the right shape: the impact follows from the signature, some have no service."""
    entry = entries[0]
    letter = int(entry["signature"][0], 16)
    impact = ["CRITICAL", "high", "Medium impact", "LOW", "none"][letter % 5]
    return json.dumps({"incidents": [incident(entry, business_impact=impact, service_name=entry["service_name"] if letter else None)]})


#: The error of each failing shape, by the first letter of the signature.
ERRORS = {
    "0": "RuntimeError: model is down",
    "1": "MalformedAnswer: the answer is not JSON",
    "2": "MalformedAnswer: incidents is a text, not a list",
    "3": "MalformedAnswer: incidents[0].operational_summary is missing",
    "4": "MalformedAnswer: incidents[1].operational_summary is an object, not a text",
    "5": "MalformedAnswer: incidents[0].action_plan[0].step is a text, not a whole number",
    "6": "MalformedAnswer: incidents[0].service_name is missing",
    "9": "MalformedAnswer: the answer is a list, not an object",
}


def repeat_judge(found: dict, candidates: list[dict]) -> dict:
    """The newest candidate with the same summary; fails or answers badly for some impacts."""
    if found["business_impact"] == "CRITICAL":
        raise RuntimeError("judge is down")
    if found["business_impact"] == "LOW":
        return {"is_repetitive": "true", "matching_report_id": None, "reason": "r"}
    same = [c["id"] for c in candidates if c["operational_summary"] == found["operational_summary"]]
    return {"is_repetitive": bool(same), "matching_report_id": same[-1] if same else None, "reason": "same summary" if same else "none"}


def prompt_judge(prompt: str) -> dict:
    """Safe, unsafe, failing and malformed by the length of the prompt."""
    kind = len(prompt) % 4
    if kind == 2:
        raise RuntimeError("judge is down")
    if kind == 3:
        return {"is_safe": "yes", "reason": "r", "refined_instruction": prompt}
    return {"is_safe": kind == 0, "reason": "fine" if kind == 0 else "vague", "refined_instruction": f"Rule: {prompt}"}
