"""What becomes of a delivery that failed: another attempt, the dead letters, or nothing more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Deliveries of an entry before it is a dead letter, and how long those are kept.
MAX_ATTEMPTS = 5
RETENTION_SECONDS = 7 * 86400

RETRY, DEAD_LETTER, EXPIRED = "retry", "dead_letter", "expired"


def retained(as_of: Column, seconds: int = RETENTION_SECONDS) -> Column:
    """True while a dead letter that failed at ``failed_at`` is kept; one without a time is kept."""
    since = as_of - F.make_dt_interval(secs=F.lit(seconds))
    return F.coalesce(F.col("failed_at") >= since, F.lit(True))


def with_route(
    failed: DataFrame,
    as_of: Column,
    max_attempts: int = MAX_ATTEMPTS,
    seconds: int = RETENTION_SECONDS,
) -> DataFrame:
    """Add ``route`` to failed deliveries, which carry ``attempts`` and ``failed_at``."""
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    exhausted = F.coalesce("attempts", F.lit(0)) >= max_attempts
    route = (
        F.when(~exhausted, RETRY).when(retained(as_of, seconds), DEAD_LETTER).otherwise(EXPIRED)
    )
    return failed.withColumn("route", route)
