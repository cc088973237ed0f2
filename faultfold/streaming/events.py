"""The event path as two Structured Streaming queries.

*Intake* decodes deliveries, keeps each insert id once (a table by day, behind a manifest) and writes one
fault per signature and batch. *Triage* follows the faults with keyed state (:mod:`.state`): it lets the
first of a signature be analysed, counts the rest, and tries failed analyses again by timers. What it
decides goes to a table of outcomes; reports, signatures, ledger and dead letters are views of it.

Both write behind manifests and know a batch that Spark repeats; faults that are delivered twice are
known by their number. So every event counts exactly once, and a batch costs what it brings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold.functions.display import present
from faultfold.functions.jsontext import compact_json, escaped_bytes
from faultfold.functions.severity import normalize_impact
from faultfold.operators import claims, dashboard, reports, rollup
from faultfold.operators.analysis import rule_analyzer, usable_instruction
from faultfold.operators.deadletters import retained
from faultfold.operators.prefix import number_rows
from faultfold.operators.selection import exportable
from faultfold.schemas import DEAD_LETTER_SCHEMA, INCIDENT_COLUMNS, INCIDENT_FIELDS
from faultfold.sources.envelopes import decode, good
from faultfold.streaming import state
from faultfold.streaming.stored import BatchTable

# The default trigger: everything available, then stop. ``{"processingTime": "10 seconds"}`` and the
# like keep a stream on.
ONCE = {"availableNow": True}

ENTRY_SCHEMA = (
    "insert_id string, ts timestamp, severity string, service_name string, log_message string, "
    "signature string, seq bigint"
)
FAULT_SCHEMA = f"signature string, {state.FAULT}"
OUTCOME_SCHEMA = (
    f"signature string, outcome string, report_id string, {state.FAULT}, problem string, attempts int, "
    f"before bigint, {INCIDENT_FIELDS.replace('service_name', 'incident_service')}, at timestamp"
)
# A partition of the state for this many faults, but one for each core in any case: opening one takes far
# longer than a fault does.
FAULTS_A_PARTITION = 20_000
# Sums that the figures of all reports are made of: a row for each service and impact.
FIGURE_SCHEMA = "service_name string, business_impact string, reports bigint, occurrences bigint"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(envelopes: DataFrame, self_service: str) -> DataFrame:
    """Decoded entries that pass the export filter; works on streams and tables alike."""
    return good(decode(envelopes)).where(exportable(self_service))


def run_of(spark: SparkSession) -> str:
    """The id of the running stream, which its checkpoint keeps."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


# --- tables --------------------------------------------------------------------------------------


def entry_table(spark: SparkSession, root: str) -> BatchTable:
    return BatchTable(spark, f"{root}/entries", f"{ENTRY_SCHEMA}, event_date date", day="event_date")


def unreadable_table(spark: SparkSession, root: str) -> BatchTable:
    return BatchTable(spark, f"{root}/unreadable", DEAD_LETTER_SCHEMA)


def outcome_table(spark: SparkSession, root: str) -> BatchTable:
    return BatchTable(spark, f"{root}/outcomes", OUTCOME_SCHEMA, fold=merge_followers)


def figure_table(spark: SparkSession, root: str) -> BatchTable:
    return BatchTable(spark, f"{root}/figures", FIGURE_SCHEMA, fold=_added_up)


def _added_up(figures: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("reports", "occurrences")]
    return figures.groupBy("service_name", "business_impact").agg(*sums)


def merge_followers(outcomes: DataFrame) -> DataFrame:
    """Followers of a report become one row, with its counts, sightings and batches; the rest stays,
    but for attempts that another one has followed."""
    columns = outcomes.columns
    follows = F.col("outcome") == state.FOLLOWS
    merged = outcomes.where(follows).groupBy("signature", "outcome", "report_id").agg(
        F.sum("incident_count").alias("incident_count"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.min(F.struct("first_us", "first_insert_id"))["first_insert_id"].alias("first_insert_id"),
        F.max(F.struct("last_us", "last_insert_id"))["last_insert_id"].alias("last_insert_id"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.max("incident_service").alias("incident_service"),
        F.max("business_impact").alias("business_impact"),
        F.max("at").alias("at"),
    )
    rest = outcomes.where(~follows & (F.col("outcome") != state.WAITING))
    return rest.unionByName(merged, allowMissingColumns=True).select(*columns)


# --- intake --------------------------------------------------------------------------------------


def unseen(table: BatchTable, batch: DataFrame, run: str, batch_id: int, number: bool = False) -> tuple[DataFrame, int]:
    """Rows of ``batch`` whose insert id is not in ``table`` yet, committed there, and their number.

    ``table`` has the columns of the batch and event_date, and seq where ``number`` is set. A
    repeated batch gives the rows it gave before.
    """
    there = table.own(run, batch_id)
    if there is not None:
        return there
    once = batch.dropDuplicates(["insert_id"]).withColumn("event_date", F.to_date("ts")).persist()
    try:
        # As many values as calendar days, however many rows.
        days = [r[0] and r[0].isoformat() for r in once.select("event_date").distinct().collect()]
        fresh = once.join(table.read(days).select("insert_id"), "insert_id", "left_anti")
        columns = list(once.columns)
        if number:
            fresh = fresh.withColumn("seq", F.lit(table.next_number()).cast("bigint"))
            columns.insert(-1, "seq")
        # One file a day, several for a large one.
        table.append(fresh.select(*columns).hint("rebalance", "event_date"), run, batch_id, days)
    finally:
        once.unpersist()
    return table.own(run, batch_id)


def faults_of(entries: DataFrame) -> DataFrame:
    """One row per signature of a batch, with the bytes that its entry takes in a JSON payload."""
    row = F.struct("severity", "service_name", "log_message")
    size = escaped_bytes(compact_json(row)) + 2
    rolled = entries.groupBy("signature").agg(*rollup.fault_totals(), F.min("seq").alias("seq"))
    return rolled.select(
        "signature", "severity", "service_name", "log_message", size.cast("bigint").alias("bytes"),
        "incident_count",
        F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"),
        "first_insert_id", "last_insert_id",
        F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"),
    )


def wanted_rows(batch: DataFrame, self_service: str) -> DataFrame:
    """Signed entries that pass the export filter, and unreadable deliveries with a ``reason``. Only these
    have ``raw``: the delivery of an entry is longer than the entry, and not needed again."""
    wanted = F.col("reason").isNotNull() | exportable(self_service)
    rows = rollup.with_signature(decode(batch).where(wanted), keep=("raw", "reason"))
    return rows.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))


def intake_batch(root: str, self_service: str) -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``; ``root`` must lie in storage all executors share."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = run_of(spark)
        rows = wanted_rows(batch, self_service).persist()
        try:
            unreadable = rows.where(F.col("reason").isNotNull()).select(
                "raw", "reason", F.lit(1).alias("attempts"), F.current_timestamp().alias("failed_at")
            )
            if not unreadable.isEmpty():
                unreadable_table(spark, root).append(unreadable, stream, batch_id)
            entries = rows.where(F.col("reason").isNull()).drop("raw", "reason")
            fresh, _ = unseen(entry_table(spark, root), entries, stream, batch_id, number=True)
        finally:
            rows.unpersist()
        # Written last: a batch that is repeated writes them again, and triage knows them by their number.
        faults_of(fresh).write.mode("append").parquet(f"{root}/faults")

    return run


def start_intake(
    envelopes: DataFrame, root: str, self_service: str, checkpoint: str, trigger: dict | None = None
):
    """Start the first query of the path; by default it takes everything available and stops."""
    spark = envelopes.sparkSession
    # A stream needs the folder to be there.
    spark.createDataFrame([], FAULT_SCHEMA).write.mode("append").parquet(f"{root}/faults")
    return (
        envelopes.writeStream.foreachBatch(intake_batch(root, self_service))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


# --- triage --------------------------------------------------------------------------------------


def _with_incident(rows: DataFrame, ruled: bool) -> DataFrame:
    """Outcomes with the columns of the first incident of their answer, or by the rules; followers have
    the service and the impact of their report."""
    reported, follows = (F.col("outcome") == o for o in (state.REPORTED, state.FOLLOWS))
    own = [c for c in INCIDENT_COLUMNS if c != "service_name"]
    if ruled:
        made = rule_analyzer(_times(rows))
        values = {c: F.col(c) for c in own} | {"incident_service": F.col("service_name")}
        known = {c: values[c] for c in ("business_impact", "incident_service")}
    else:
        first = F.element_at(F.from_json("incidents", f"array<struct<{INCIDENT_FIELDS}>>"), 1)
        made = rows.withColumn("_incident", first)
        values = {c: F.col("_incident")[c] for c in own} | {"incident_service": F.col("_incident")["service_name"]}
        known = {"business_impact": F.col("known_impact"), "incident_service": F.col("known_service")}
    kept = [c for c in rows.columns if c not in ("incidents", "known_service", "known_impact")]
    return made.select(
        *kept,
        *[F.when(reported, v).when(follows, known.get(c, F.lit(None))).alias(c) for c, v in values.items()],
        F.current_timestamp().alias("at"),
    )


def _figures(outcomes: DataFrame) -> DataFrame:
    """What outcomes add to the figures."""
    rows = outcomes.where(F.col("outcome").isin(state.REPORTED, state.FOLLOWS)).select(
        F.col("incident_service").alias("service_name"), "business_impact",
        (F.col("outcome") == state.REPORTED).cast("bigint").alias("reports"),
        F.col("incident_count").alias("occurrences"),
    )
    return _added_up(rows)


def start_triage(
    spark: SparkSession,
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
    call: Callable[[list[dict], str | None], str] | None = None,
    instruction: str | None = None,
    judge: Callable[[str], dict] | None = None,
    partitions: int | None = None,
    **options,
):
    """Start the second query of the path. ``options`` go to :class:`~.state.SignatureState`.

    ``partitions`` is the number of partitions of the state, by default that of the session's shuffles; a
    checkpoint keeps the number it began with. Without ``call`` the rules analyse. Waiting signatures are tried again when they are due, with or
    without new data, as long as the query is on; one that stops goes on with them at its next start.
    """
    usable = usable_instruction(spark, instruction, judge)
    processor = state.SignatureState(call, usable, **options)
    # A session of its own, since the kind of state store is a setting of the session.
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    if partitions is not None:
        session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    if trigger is None or "availableNow" in trigger:
        # Timers would ask for another batch without end.
        session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    # Faults that have been processed are deleted, so their folder does not grow.
    faults = session.readStream.schema(FAULT_SCHEMA).option("cleanSource", "delete").parquet(f"{root}/faults")
    outcomes = faults.groupBy("signature").transformWithState(processor, state.OUTCOME, "update", "processingTime")
    target = session.createDataFrame([], OUTCOME_SCHEMA).columns

    def save(batch: DataFrame, batch_id: int) -> None:
        here, run = batch.sparkSession, run_of(batch.sparkSession)
        rows = _with_incident(batch, call is None).select(*target)
        # A batch that is repeated has to be computed again, or its state would be missing, and its
        # outcomes are those of the state. Timers make batches without rows, too.
        table = outcome_table(here, root)
        table.append(rows, run, batch_id, skip_empty=True, replace=True)
        there = table.own(run, batch_id)
        if there is not None:
            figure_table(here, root).append(_figures(there[0]), run, batch_id, replace=True)

    return (
        outcomes.writeStream.foreachBatch(save)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def state_partitions(spark: SparkSession, root: str) -> int:
    """As many partitions as the faults that wait under ``root`` need, up to what the session shuffles into."""
    faults = spark.read.schema(FAULT_SCHEMA).parquet(f"{root}/faults").count()
    needed = max(spark.sparkContext.defaultParallelism, math.ceil(faults / FAULTS_A_PARTITION))
    return min(needed, int(spark.conf.get("spark.sql.shuffle.partitions")))


def run_triage(envelopes: DataFrame, root: str, self_service: str, checkpoint: str, **options) -> None:
    """Both queries, one after the other, over everything available."""
    spark = envelopes.sparkSession

    def triage():
        known = {"partitions": state_partitions(spark, root), **options}
        return start_triage(spark, root, f"{checkpoint}/triage", **known)

    for query in (lambda: start_intake(envelopes, root, self_service, f"{checkpoint}/intake"), triage):
        running = query()
        try:
            running.awaitTermination()
        finally:
            running.stop()


# --- views ---------------------------------------------------------------------------------------


def _times(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumns(
        {"first_seen": F.timestamp_micros("first_us"), "last_seen": F.timestamp_micros("last_us")}
    )


def current_reports(spark: SparkSession, root: str) -> DataFrame:
    """Reports with all followers of committed batches counted in."""
    rows = _times(outcome_table(spark, root).read())
    made = rows.where(F.col("outcome") == state.REPORTED).drop("service_name")
    made = reports.make_reports(made.withColumnRenamed("incident_service", "service_name"))
    # A new report adds nothing but its last sighting, so that entries which arrive later but happened
    # earlier do not take its place.
    seen = rows.where(F.col("outcome").isin(state.REPORTED, state.FOLLOWS)).groupBy("report_id").agg(
        F.sum(F.when(F.col("outcome") == state.FOLLOWS, F.col("incident_count")).otherwise(0)).alias("more"),
        F.max("last_seen").alias("last_seen"),
        F.max(F.struct("last_seen", "last_insert_id"))["last_insert_id"].alias("last_insert_id"),
    )
    return reports.apply_deltas(made, seen)


def current_signatures(spark: SparkSession, root: str) -> DataFrame:
    """The signature table: every reported signature with its count, of several reports the newest."""
    rows = current_reports(spark, root)
    newest = F.max(F.struct("created_at", "id", "incident_count"))
    return rows.groupBy("signature").agg(newest.alias("r")).select(
        "signature",
        F.lit(claims.READY).alias("status"),
        F.col("r.incident_count").alias("count"),
        F.col("r.id").alias("report_id"),
    )


def current_numbers(spark: SparkSession, root: str) -> DataFrame:
    """insert_id, signature and running_count of every entry: k for the k-th that was accepted.

    Needs ``carry`` in :func:`start_triage`. Entries count in the order of their batches and, within one,
    of time and insert id. The state brings what was before a batch, so an entry is numbered among
    those of its own batch only.
    """
    entries = entry_table(spark, root).read().select("insert_id", "ts", "signature", "seq")
    placed = number_rows(entries, ["signature", "seq"], rollup.EVENT_ORDER)
    carried = outcome_table(spark, root).read().where(F.col("outcome") == state.CARRY)
    carried = carried.select("signature", F.col("first_seq").alias("seq"), "before")
    return placed.join(carried, ["signature", "seq"]).select(
        "insert_id", "signature", (F.col("before") + F.col("position")).alias("running_count")
    )


def current_figures(spark: SparkSession, root: str) -> DataFrame:
    """Reports and occurrences per service and impact, from what each batch added: no report is read.

    A row stands for many reports: ``incident_count`` is their occurrences, for :func:`current_kpis`.
    """
    return _added_up(figure_table(spark, root).read())


def current_kpis(spark: SparkSession, root: str) -> DataFrame:
    """What ``dashboard.report_kpis`` says of all reports."""
    impact = normalize_impact(F.col("business_impact"))
    reports_ = F.col("reports")
    return current_figures(spark, root).agg(
        F.coalesce(F.sum(reports_), F.lit(0)).cast("bigint").alias("reports"),
        F.coalesce(F.sum("occurrences").cast("double"), F.lit(0.0)).alias("occurrences"),
        F.coalesce(F.sum(F.when(impact == "CRITICAL", reports_)), F.lit(0)).cast("bigint").alias("critical"),
        F.coalesce(F.sum(F.when(impact == "HIGH", reports_)), F.lit(0)).cast("bigint").alias("high"),
        F.count_distinct(present(F.col("service_name"))).alias("services"),
    )


def current_impacts(spark: SparkSession, root: str) -> DataFrame:
    """What ``dashboard.impact_rollup`` says of all reports."""
    rows = current_figures(spark, root).withColumnRenamed("occurrences", "incident_count")
    return dashboard.impact_rollup(rows)


def current_ledger(spark: SparkSession, root: str) -> DataFrame:
    """insert_id, status and processed_timestamp of every entry whose signature has been settled.

    Batches of a signature are settled in order, so an outcome covers a range of them.
    """
    status = F.when(F.col("outcome") == state.REJECTED, claims.FAILED).otherwise(claims.COMPLETED)
    settled = outcome_table(spark, root).read()
    settled = settled.where(F.col("outcome").isin(state.REPORTED, state.FOLLOWS, state.NOTHING, state.REJECTED))
    settled = settled.select(
        F.col("signature").alias("_signature"), "first_seq", "last_seq", status.alias("status"),
        F.col("at").alias("processed_timestamp"),
    )
    entries = entry_table(spark, root).read().select("insert_id", "signature", "seq")
    same = (F.col("signature") == F.col("_signature")) & F.col("seq").between(F.col("first_seq"), F.col("last_seq"))
    return entries.join(settled, same).select("insert_id", "status", "processed_timestamp")


def current_dead_letters(spark: SparkSession, root: str, as_of=None) -> DataFrame:
    """Unreadable deliveries and entries of signatures that were given up, while they are retained."""
    dead = outcome_table(spark, root).read().where(F.col("outcome") == state.DEAD)
    dead = dead.select(
        F.col("signature").alias("_signature"), "first_seq", "last_seq", F.col("problem").alias("reason"),
        "attempts", F.col("at").alias("failed_at"),
    )
    entries = entry_table(spark, root).read()
    same = (F.col("signature") == F.col("_signature")) & F.col("seq").between(F.col("first_seq"), F.col("last_seq"))
    raw = F.to_json(F.struct("insert_id", "ts", "severity", "service_name", "log_message")).alias("raw")
    given_up = entries.join(dead, same).select(raw, "reason", "attempts", "failed_at")
    rows = given_up.unionByName(unreadable_table(spark, root).read())
    return rows.where(retained(F.current_timestamp() if as_of is None else as_of))
