"""Size limits of an analysis batch, and packing entries into batches that keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.operators.packing import next_fit

# The caps of one analysis and the texts of their errors.
MAX_ENTRIES = 500
MAX_BYTES = 512 * 1024
TOO_MANY = "Log batch exceeds the maximum number of entries allowed for analysis."
TOO_LARGE = "Redacted log payload exceeds the maximum byte size allowed for analysis."


def _check_caps(max_entries: int, max_bytes: int) -> None:
    if max_entries < 1:
        raise ValueError("max_entries must be at least 1")
    if max_bytes < 1:
        raise ValueError("max_bytes must be at least 1")


def batch_limits(
    entries: DataFrame,
    batch: list[str],
    max_entries: int = MAX_ENTRIES,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Entry count, payload bytes and the reason for rejection of each batch.

    ``entries`` carries ``bytes`` per entry. A JSON array adds a comma between entries and two
    brackets. The count is checked first; reaching a cap is allowed.
    """
    _check_caps(max_entries, max_bytes)
    sized = entries.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("entries"),
        (F.sum("bytes") + F.count(F.lit(1)) - 1 + 2).alias("payload_bytes"),
    )
    many = F.format_string(f"{TOO_MANY} (entries: %d, limit: {max_entries})", "entries")
    large = F.format_string(
        f"{TOO_LARGE} (payload: %d bytes, limit: {max_bytes} bytes)", "payload_bytes"
    )
    reason = F.when(F.col("entries") > max_entries, many).when(
        F.col("payload_bytes") > max_bytes, large
    )
    return sized.select("*", reason.isNull().alias("accepted"), reason.alias("reason"))


def pack_batches(
    entries: DataFrame,
    group: list[str],
    order: list[str],
    max_entries: int = MAX_ENTRIES,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Split every group into batches that keep both caps, in order, as few as a pass in order makes.

    Adds ``batch_no`` (from 0 in its group) and ``oversize``: a row that alone breaks the cap is a
    batch of its own. ``entries`` carries ``bytes`` per entry; a JSON array adds a comma between
    entries and two brackets.
    """
    _check_caps(max_entries, max_bytes)
    room = max_bytes - 1
    packed = next_fit(entries, group, order, F.col("bytes") + 1, max_entries, room)
    return packed.withColumn("oversize", F.col("bytes") + 1 > room)
