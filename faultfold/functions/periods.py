"""Look-back periods such as ``5min`` or ``1 day``, and the default time window."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultfold.functions.text import SPACE_CLASS

# Accepted unit spellings and the seconds each stands for.
UNIT_SPELLINGS = {
    1: ["s", "sec", "secs", "second", "seconds"],
    60: ["m", "min", "mins", "minute", "minutes"],
    3600: ["h", "hr", "hrs", "hour", "hours"],
    86400: ["d", "day", "days"],
}

_UNITS = "|".join(name for names in UNIT_SPELLINGS.values() for name in names)
_SECONDS = {name: size for size, names in UNIT_SPELLINGS.items() for name in names}
PERIOD_PATTERN = f"(?i)^[{SPACE_CLASS}]*([0-9]+)[{SPACE_CLASS}]*({_UNITS})[{SPACE_CLASS}]*$"


def period_seconds(period: Column) -> Column:
    """Length of a period in seconds; null when it is malformed or below one unit."""
    amount = F.regexp_extract(period, PERIOD_PATTERN, 1).try_cast("bigint")
    unit = F.lower(F.substring(F.regexp_extract(period, PERIOD_PATTERN, 2), 1, 1))
    size = (
        F.when(unit == "s", F.lit(1))
        .when(unit == "m", F.lit(60))
        .when(unit == "h", F.lit(3600))
        .when(unit == "d", F.lit(86400))
        .cast("bigint")
    )
    return F.when(amount >= 1, F.try_multiply(amount, size))


def period_problem(period: Column) -> Column:
    """Why a period is unusable: ``format``, ``minimum`` or null when it is fine."""
    fits = F.coalesce(period.rlike(PERIOD_PATTERN), F.lit(False))
    return F.when(~fits, "format").when(period_seconds(period).isNull(), "minimum")


def parse_period(period: str) -> dt.timedelta:
    """Driver-side form, for arguments."""
    found = re.fullmatch(rf"\s*(\d+)\s*({_UNITS})\s*", period, re.IGNORECASE)
    if not found:
        raise ValueError(f"not a period: {period!r}; write for example '5min', '2h' or '1 day'")
    amount = int(found.group(1))
    if amount < 1:
        raise ValueError("a period is at least 1")
    return dt.timedelta(seconds=amount * _SECONDS[found.group(2).lower()])


def default_window(start: Column, end: Column, as_of: Column) -> tuple[Column, Column]:
    """Parse ``yyyy-MM-dd HH:mm:ss`` bounds; a missing one gives the day that ends at ``as_of``."""
    fmt = F.lit("yyyy-MM-dd HH:mm:ss")
    lower = F.coalesce(
        F.try_to_timestamp(F.nullif(start, F.lit("")), fmt), as_of - F.expr("INTERVAL 1 DAY")
    )
    upper = F.coalesce(F.try_to_timestamp(F.nullif(end, F.lit("")), fmt), as_of)
    return lower, upper
