"""Log severity and business impact levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from least to most severe.
SEVERITIES = [
    "DEBUG",
    "INFO",
    "NOTICE",
    "WARNING",
    "ERROR",
    "CRITICAL",
    "ALERT",
    "EMERGENCY",
]

# Business impact from most to least severe; the order is also the matching order.
IMPACTS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def severity_rank(severity: Column) -> Column:
    """1 for DEBUG up to 8 for EMERGENCY; 0 for anything else."""
    levels = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.coalesce(F.array_position(levels, severity), F.lit(0)).cast("int")


def at_least(severity: Column, floor: str) -> Column:
    """Severity at or above ``floor``, as an IN list so that a Parquet scan can skip row groups."""
    return severity.isin(SEVERITIES[SEVERITIES.index(floor):])


def upper_severity(severity: Column) -> Column:
    return F.upper(F.coalesce(severity, F.lit("")))


def normalize_impact(impact: Column) -> Column:
    """First level whose name occurs in the text; UNKNOWN when none does."""
    raw = F.upper(impact)
    level = F.when(F.contains(raw, F.lit(IMPACTS[0])), IMPACTS[0])
    for name in IMPACTS[1:]:
        level = level.when(F.contains(raw, F.lit(name)), name)
    return level.otherwise("UNKNOWN")


def count_or_one(count: Column) -> Column:
    """A missing, zero or non-numeric counter stands for one occurrence."""
    number = count.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (number != 0)
    return F.when(usable, number).otherwise(F.lit(1.0))
