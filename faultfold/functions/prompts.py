"""Deny rules for custom instructions; the first rule that hits gives the verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultfold.functions.text import strip_space

# The length limit and the two checks before the patterns.
MAX_PROMPT_CHARS = 200
TOO_LONG = "Maximum prompt character limit is 200"
EMPTY = "Instruction cannot be empty."

# Rule, pattern, whether a dot crosses lines, reason; in matching order.
DENY_RULES = [
    (
        "ignore_rules",
        r"\b(?:ignore|disregard|forget)\b.{0,40}\b(?:previous|prior|above|earlier|system)\b.{0,20}\b(?:instructions?|rules?|prompts?)\b",
        True,
        "Instruction attempts to override system rules.",
    ),
    (
        "override_system",
        r"\boverride\b.{0,20}\b(?:system|previous)\b.{0,20}\b(?:prompt|instructions?|rules?)\b",
        True,
        "Instruction attempts to override system rules.",
    ),
    (
        "do_not_follow",
        r"\b(?:do\s*n'?t|do\s+not)\s+follow\b.{0,20}\b(?:rules?|instructions?|prompt)\b",
        True,
        "Instruction attempts to override system rules.",
    ),
    (
        "reveal_prompt",
        r"\b(?:reveal|show|display|print|expose|repeat)\b.{0,30}\b(?:system|original|hidden|full)\b.{0,20}\b(?:prompt|instructions?)\b",
        True,
        "Instruction attempts to expose system prompt content.",
    ),
    (
        "raw_output",
        r"\b(?:output|dump|return|export|include)\b.{0,20}\b(?:raw|full|complete|unredacted|original)\b.{0,20}\b(?:logs?|payloads?|entries?|data)\b",
        True,
        "Instruction requests raw or unredacted log output.",
    ),
    (
        "credential_output",
        r"\b(?:output|dump|return|export)\b.{0,20}\b(?:all\s+)?(?:raw\s+)?(?:pii|passwords?|tokens?|secrets?|credentials?|api\s*keys?)\b",
        True,
        "Instruction requests sensitive credential output.",
    ),
    (
        "role_change",
        r"\b(?:act\s+as|you\s+are\s+now|pretend\s+(?:to\s+be|you\s+are)|roleplay\s+as)\b",
        False,
        "Instruction attempts to change the assistant role.",
    ),
    (
        "format_change",
        r"\b(?:respond|output|return)\s+(?:in|as|with)\s+(?:csv|xml|html|markdown|yaml|plain\s+text|a\s+poem)\b",
        False,
        "Instruction attempts to change the required JSON output format.",
    ),
    (
        "no_json",
        r"\b(?:no|without|not|skip|avoid)\s+json\b",
        False,
        "Instruction attempts to change the required JSON output format.",
    ),
    (
        "disable_safety",
        r"\b(?:bypass|disable|turn\s+off)\b.{0,20}\b(?:guardrails?|safety|filters?|validation)\b",
        True,
        "Instruction attempts to disable safety guardrails.",
    ),
]


def prompt_verdict(prompt: Column) -> tuple[Column, Column]:
    """(rule, reason) of the first rule that rejects ``prompt``; both null when it passes."""
    stripped = strip_space(prompt)
    checks = [
        ("too_long", F.char_length(prompt) > MAX_PROMPT_CHARS, TOO_LONG),
        ("empty", (stripped == "") | prompt.isNull(), EMPTY),
    ]
    for name, pattern, across_lines, reason in DENY_RULES:
        flags = "(?isU)" if across_lines else "(?iU)"
        checks.append((name, stripped.rlike(flags + pattern), reason))
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, hit, _ in checks:
        rule = rule.when(hit, name)
    reasons = {name: reason for name, _, reason in checks}
    return rule, reasons_of(rule, reasons)


def reasons_of(rule: Column, reasons: dict[str, str]) -> Column:
    pairs = [F.lit(part) for pair in reasons.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), rule)
