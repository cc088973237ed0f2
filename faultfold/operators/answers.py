"""Answers of models are checked before anything is done with them.

A malformed answer is a failed call: it becomes an error text, and whoever asked may try again. Only an
answer with an empty list says that there is no incident.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from faultfold.schemas import INCIDENT_COLUMNS

NULLABLE = {"service_name"}


class MalformedAnswer(ValueError):
    """An answer that does not have the agreed shape; the text names the place."""


def _kind(value: Any) -> str:
    names = {bool: "a truth value", int: "a number", float: "a number", str: "a text", list: "a list", dict: "an object"}
    return "null" if value is None else names[type(value)]


def _text(found: dict, field: str, place: str, nullable: bool = False) -> str | None:
    if field not in found:
        raise MalformedAnswer(f"{place}{field} is missing")
    value = found[field]
    if not isinstance(value, str) and not (nullable and value is None):
        raise MalformedAnswer(f"{place}{field} is {_kind(value)}, not a text")
    return value


def _step(found: dict, place: str) -> int:
    """A whole number; 2.0 and "2" are taken for one, as usual readers of such answers do."""
    if "step" not in found:
        raise MalformedAnswer(f"{place}step is missing")
    value = found["step"]
    if isinstance(value, str) and value.strip().removeprefix("-").isdecimal():
        value = int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int):
        raise MalformedAnswer(f"{place}step is {_kind(value)}, not a whole number")
    if not -(1 << 31) <= value < 1 << 31:
        raise MalformedAnswer(f"{place}step is out of range")
    return value


def _objects(found: dict, field: str, place: str) -> list[dict]:
    if field not in found:
        raise MalformedAnswer(f"{place}{field} is missing")
    values = found[field]
    if not isinstance(values, list):
        raise MalformedAnswer(f"{place}{field} is {_kind(values)}, not a list")
    for i, value in enumerate(values):
        if not isinstance(value, dict):
            raise MalformedAnswer(f"{place}{field}[{i}] is {_kind(value)}, not an object")
    return values


def _incident(found: dict, place: str) -> dict:
    made: dict[str, Any] = {
        c: _text(found, c, place, c in NULLABLE) for c in INCIDENT_COLUMNS if c != "action_plan"
    }
    made["action_plan"] = [
        {"step": _step(s, at), "action": _text(s, "action", at), "warning": _text(s, "warning", at)}
        for i, s in enumerate(_objects(found, "action_plan", place))
        for at in [f"{place}action_plan[{i}]."]
    ]
    return made


def read_answer(answer: Any) -> list[dict]:
    """The incidents of an answer, ``{"incidents": [...]}`` as JSON text; fields beyond those agreed go."""
    if not isinstance(answer, str):
        raise MalformedAnswer(f"the answer is {type(answer).__name__}, not a text")
    try:
        found = json.loads(answer)
    except ValueError:
        raise MalformedAnswer("the answer is not JSON") from None
    if not isinstance(found, dict):
        raise MalformedAnswer(f"the answer is {_kind(found)}, not an object")
    return [_incident(x, f"incidents[{i}].") for i, x in enumerate(_objects(found, "incidents", ""))]


def _error(problem: Exception) -> str:
    """The problem as text that every system can store; a lone surrogate cannot be."""
    text = f"{type(problem).__name__}: {problem}"
    return text.encode(errors="replace").decode()


def incidents_of(
    call: Callable[[list[dict], str | None], str], entries: list[dict], instruction: str | None
) -> tuple[str | None, str | None]:
    """The checked incidents of one call as a JSON list, or why there are none: a failed call is data."""
    try:
        return json.dumps(read_answer(call(entries, instruction))), None
    except Exception as problem:
        return None, _error(problem)


def read_verdict(answer: Any, fields: dict[str, tuple[type, ...]]) -> dict:
    """The ``fields`` of a judge's answer, each of one of its types; anything else is malformed."""
    if not isinstance(answer, dict):
        raise MalformedAnswer(f"the verdict is {type(answer).__name__}, not an object")
    for field, kinds in fields.items():
        if field not in answer:
            raise MalformedAnswer(f"{field} is missing")
        if not isinstance(answer[field], kinds):
            raise MalformedAnswer(f"{field} is {type(answer[field]).__name__}")
    return {f: answer[f] for f in fields}


#: What a judge of prompts and a judge of repeats answer with.
PROMPT_VERDICT = {"is_safe": (bool,), "reason": (str,), "refined_instruction": (str,)}
REPEAT_VERDICT = {"is_repetitive": (bool,), "matching_report_id": (str, type(None)), "reason": (str,)}
