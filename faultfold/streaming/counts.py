"""Each entry once, and occurrences per signature as they arrive.

The insert ids seen so far lie in a :class:`BatchTable` by day of the entry, not in the state of the
stream: a watermark would have to drop what arrives late. A redelivered entry keeps its time, so a
micro-batch reads the folders with days of its own entries only, in whatever order they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold.operators.rollup import with_signature
from faultfold.streaming.events import ONCE, ingest, run_of, unseen
from faultfold.streaming.stored import BatchTable

COUNTS_SCHEMA = "signature string, incident_count bigint, first_seen timestamp, last_seen timestamp"


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def _seen(spark: SparkSession, path: str, rows: DataFrame) -> BatchTable:
    return BatchTable(spark, path, f"{_schema(rows)}, event_date date", day="event_date")


def keep_new(batch: DataFrame, batch_id: int, path: str) -> DataFrame:
    """The entries of a micro-batch not seen before, each insert id once, as stored under ``path``.

    Needs insert_id and ts. An entry without a time belongs to the day ``null``. A repeated batch
    gives what it gave before.
    """
    spark = batch.sparkSession
    table = _seen(spark, path, batch)
    rows, _ = unseen(table, batch, run_of(spark), batch_id)
    return rows.select(*batch.columns)


def start_deduplicated(entries: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Write each insert id of ``entries`` once under ``out``; see :func:`read_deduplicated`."""

    def save(batch: DataFrame, batch_id: int) -> None:
        keep_new(batch, batch_id, out)

    return (
        entries.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def read_deduplicated(spark: SparkSession, out: str, entries: DataFrame) -> DataFrame:
    """What :func:`start_deduplicated` wrote for the stream ``entries``."""
    return _seen(spark, out, entries).read().select(*entries.columns)


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("signature").agg(
        F.sum("incident_count").alias("incident_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def _counts(spark: SparkSession, out: str) -> BatchTable:
    return BatchTable(spark, f"{out}/counts", COUNTS_SCHEMA, fold=_added_up)


def start_counts(
    envelopes: DataFrame, self_service: str, out: str, checkpoint: str, trigger: dict | None = None
):
    """Count every entry once: its id goes to ``<out>/entries``, what a batch adds to ``<out>/counts``."""
    signed = with_signature(ingest(envelopes, self_service)).select("insert_id", "ts", "signature")

    def save(batch: DataFrame, batch_id: int) -> None:
        added = keep_new(batch, batch_id, f"{out}/entries").groupBy("signature").agg(
            F.count(F.lit(1)).alias("incident_count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        spark = batch.sparkSession
        _counts(spark, out).append(added, run_of(spark), batch_id)

    return (
        signed.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """Occurrences, first and last sighting per signature over all batches so far."""
    return _added_up(_counts(spark, out).read())
