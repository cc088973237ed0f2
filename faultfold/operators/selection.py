"""Log selection and the filters it is made of."""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.severity import SEVERITIES, at_least
from faultfold.functions.text import first_message, redacted

DEFAULT_LIMIT = 100


def service_of(resource: str = "resource") -> Column:
    return F.col(f"{resource}.labels").getItem("service_name")


def message_of() -> Column:
    return first_message(F.col("json_payload"), F.col("text_payload"))


def all_of(predicates: list[Column]) -> Column:
    return functools.reduce(operator.and_, predicates, F.lit(True))


def log_name_is(log_name: str, project: str = "demo") -> Column:
    return F.col("log_name") == f"projects/{project}/logs/{log_name}"


def time_between(start, end, column: str = "ts") -> Column:
    """Both ends inclusive; an end that is no datetime is ignored."""
    ts = F.col(column)
    bounds = []
    if isinstance(start, dt.datetime):
        bounds.append(ts >= F.lit(start.isoformat(sep=" ")).cast("timestamp"))
    if isinstance(end, dt.datetime):
        bounds.append(ts <= F.lit(end.isoformat(sep=" ")).cast("timestamp"))
    return all_of(bounds)


def mentions(keywords: list[str], mode: str = "any", text: Column | None = None) -> Column:
    """Case-insensitive search for any (or all) of the keywords in the message."""
    lowered = F.lower(message_of() if text is None else text)
    hits = [F.contains(lowered, F.lit(word.lower())) for word in keywords]
    if mode == "any":
        return functools.reduce(operator.or_, hits, F.lit(False))
    if mode == "all":
        return all_of(hits)
    raise ValueError("mode is 'any' or 'all'")


def severity_floor(floor: str | None, strict: bool = False) -> Column:
    """An unknown level name gives no filter, unless ``strict``."""
    if not floor:
        return F.lit(True)
    if floor not in SEVERITIES:
        if strict:
            raise ValueError(f"unknown severity: {floor!r}")
        return F.lit(True)
    return at_least(F.col("severity"), floor)


def exportable(self_service: str) -> Column:
    """Errors of every other service; the engine's own errors would feed back into it."""
    return ~service_of().eqNullSafe(F.lit(self_service)) & at_least(F.col("severity"), "ERROR")


def log_predicate(
    log_name: str | None = None,
    severity: str | None = None,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    keywords: list[str] | None = None,
    project: str = "demo",
    mode: str = "any",
    strict: bool = False,
) -> Column:
    predicates = [severity_floor(severity, strict), time_between(start, end)]
    if log_name:
        predicates.insert(0, log_name_is(log_name, project))
    if keywords:
        predicates.append(mentions(keywords, mode))
    return all_of(predicates)


def select_logs(logs: DataFrame, limit: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    """The newest ``limit`` entries that pass every given filter (a distributed top-k)."""
    chosen = logs.where(log_predicate(**filters))
    return chosen.orderBy(F.desc("ts"), "insert_id").limit(limit)


def sanitize(logs: DataFrame, strict: bool = False, keep: tuple[str, ...] = ("insert_id",)) -> DataFrame:
    """Prune entries to the analysed fields and redact the message."""
    masked = redacted(logs, message_of(), "message", strict)
    return masked.select(*keep, "ts", "severity", "resource", "message")
