"""The event path: redelivery, several micro-batches, restart, failures."""

import datetime as dt
import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultfold.operators.rollup import incident_rollup
from faultfold.operators import dashboard
from faultfold.plans import fixtures, hooks
from faultfold.schemas import ENVELOPE_SCHEMA
from faultfold.sources import envelopes
from faultfold.sources.tables import logs
from faultfold.streaming import counts, events


@pytest.fixture(scope="module")
def expected(spark, sf_dir):
    rows = incident_rollup(fixtures.signed(spark, sf_dir)).collect()
    return {r["signature"]: (r["incident_count"], r["last_insert_id"]) for r in rows}


def deliver(spark, sf_dir, folder, files):
    sent = envelopes.encode(logs(spark, sf_dir)).repartition(files)
    sent.write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(ENVELOPE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, folder, root, **options):
    events.run_triage(stream(spark, folder), f"{root}/state", fixtures.SELF_SERVICE, f"{root}/cp", **options)
    return f"{root}/state"


def counted(spark, state):
    rows = events.current_reports(spark, state).collect()
    return {r["signature"]: (r["incident_count"], r["last_insert_id"]) for r in rows}


def statuses(spark, state):
    return {r["insert_id"]: r["status"] for r in events.current_ledger(spark, state).collect()}


def test_batches_redelivery_and_restart(spark, sf_dir, tmp_path, expected):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, sf_dir, folder, 3)
    state = run(spark, folder, root)
    assert counted(spark, state) == expected
    assert events.entry_table(spark, state).manifest()["number"] == 3
    # Everything once more, to queries that restart from their checkpoints.
    deliver(spark, sf_dir, folder, 2)
    run(spark, folder, root)
    assert counted(spark, state) == expected
    errors = sum(n for n, _ in expected.values())
    ledger = events.current_ledger(spark, state)
    assert ledger.count() == errors == ledger.select("insert_id").distinct().count()
    # A new checkpoint of the intake goes behind what is committed.
    query = events.start_intake(stream(spark, folder), state, fixtures.SELF_SERVICE, f"{root}/second")
    query.awaitTermination()
    events.start_triage(spark, state, f"{root}/cp/triage").awaitTermination()
    assert counted(spark, state) == expected
    assert events.entry_table(spark, state).manifest()["number"] > 5
    # What has been processed does not pile up.
    assert spark.read.schema(events.FAULT_SCHEMA).parquet(f"{state}/faults").count() < 3 * errors


def one_entry(insert_id, message="boom"):
    return (
        f'{{"insertId":"{insert_id}","timestamp":"2024-05-01T00:00:0{insert_id[-1]}Z","severity":"ERROR",'
        f'"resource":{{"type":"run","labels":{{"service_name":"api"}}}},"textPayload":"{message}"}}'
    )


def batch_of(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    data = F.base64(F.col("t").cast("binary"))
    return rows.select(
        F.lit("sub").alias("subscription"),
        F.struct(data.alias("data"), F.lit("m").alias("messageId"), F.lit("p").alias("publishTime"),
                 F.create_map(F.lit("a"), F.lit("b")).alias("attributes")).alias("message"),
    )


def intake(spark, state, batch_id, *texts):
    events.intake_batch(state, "self")(batch_of(spark, *texts), batch_id)


def triage(spark, state, root, **options):
    events.start_triage(spark, state, f"{root}/triage", **options).awaitTermination()


def test_repeated_batches_count_once(spark, tmp_path, monkeypatch):
    """A batch with rows is repeated wholly, and after a crash between its entries and its faults."""
    state = str(tmp_path / "state")
    spark.createDataFrame([], events.FAULT_SCHEMA).write.parquet(f"{state}/faults")
    first = (one_entry("e1"), one_entry("e2"), one_entry("e3", "other"), "not json")
    for _ in range(2):
        intake(spark, state, 0, *first)
    triage(spark, state, tmp_path)

    def crash(entries):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(events, "faults_of", crash)
        with pytest.raises(RuntimeError, match="killed"):
            intake(spark, state, 1, one_entry("e2"), one_entry("e4"), one_entry("e5", "third"))
    assert events.entry_table(spark, state).manifest()["number"] == 2
    triage(spark, state, tmp_path)
    intake(spark, state, 1, one_entry("e2"), one_entry("e4"), one_entry("e5", "third"))
    intake(spark, state, 2, one_entry("e1"), one_entry("e6"))
    for _ in range(2):
        triage(spark, state, tmp_path)
    got = {r["log_message"]: r["incident_count"] for r in events.current_reports(spark, state).collect()}
    assert got == {"boom": 4, "other": 1, "third": 1}
    assert statuses(spark, state) == {f"e{i}": "COMPLETED" for i in range(1, 7)}
    dead = [(r["reason"], r["attempts"]) for r in events.current_dead_letters(spark, state).collect()]
    assert dead == [("bad_json", 1)]
    later = F.current_timestamp() + F.make_dt_interval(days=F.lit(8))
    assert events.current_dead_letters(spark, state, later).count() == 0


def test_a_triage_batch_that_is_repeated(spark, tmp_path, monkeypatch):
    """The query dies when outcomes are committed and Spark does not know; the answers differ the next time."""
    state = str(tmp_path / "state")
    spark.createDataFrame([], events.FAULT_SCHEMA).write.parquet(f"{state}/faults")
    intake(spark, state, 0, one_entry("e1"), one_entry("e2"))
    original = events.BatchTable.append

    def dying(self, *args, **kwargs):
        original(self, *args, **kwargs)
        raise RuntimeError("killed after the commit")

    with monkeypatch.context() as patch:
        patch.setattr(events.BatchTable, "append", dying)
        with pytest.raises(Exception, match="killed after the commit"):
            triage(spark, state, tmp_path)
    assert events.current_reports(spark, state).count() == 1
    # The batch again, now with a model that finds nothing: its outcomes replace those of the first time.
    triage(spark, state, tmp_path, call=lambda e, i: '{"incidents": []}')
    assert events.current_reports(spark, state).count() == 0 and len(statuses(spark, state)) == 2
    intake(spark, state, 1, one_entry("e3"))
    triage(spark, state, tmp_path)
    assert [r["incident_count"] for r in events.current_reports(spark, state).collect()] == [1]
    assert tuple(events.current_kpis(spark, state).first())[:2] == (1, 1.0)


def test_figures_equal_the_full_pass(spark, sf_dir, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, sf_dir, folder, 2)
    for _ in range(2):
        state = run(spark, folder, root, call=hooks.calm_call)
        deliver(spark, sf_dir, folder, 1)
    reports = events.current_reports(spark, state)
    assert events.current_kpis(spark, state).collect() == dashboard.report_kpis(reports).collect()
    assert events.current_impacts(spark, state).collect() == dashboard.impact_rollup(reports).collect()


def test_failures_are_tried_again_without_new_data(spark, tmp_path):
    state, calls = str(tmp_path / "state"), str(tmp_path / "calls")
    spark.createDataFrame([], events.FAULT_SCHEMA).write.parquet(f"{state}/faults")
    intake(spark, state, 0, one_entry("e1"), one_entry("e2"), one_entry("e3", "hopeless"), one_entry("e4", "quiet"))

    def call(entries, instruction):
        """Fails twice for one signature, always for another; says nothing of the third."""
        import os

        text = entries[0]["log_message"]
        os.makedirs(calls, exist_ok=True)
        before = len([n for n in os.listdir(calls) if n.startswith(text)])
        open(f"{calls}/{text}-{before}", "w").close()
        if text == "quiet":
            return '{"incidents": []}'
        if text == "hopeless" or before < 2:
            return json.dumps({"incidents": "disk is full"})
        return json.dumps({"incidents": [hooks.incident(entries[0])]})

    query = events.start_triage(
        spark, state, f"{tmp_path}/triage", {"processingTime": "300 milliseconds"}, call,
        max_attempts=3, first_wait=0.5, longest_wait=1.0,
    )
    try:
        end = time.time() + 90
        while time.time() < end and len(statuses(spark, state)) + events.current_dead_letters(spark, state).count() < 4:
            time.sleep(1)
    finally:
        query.stop()
    assert statuses(spark, state) == {"e1": "COMPLETED", "e2": "COMPLETED", "e4": "COMPLETED"}
    report, = events.current_reports(spark, state).collect()
    assert (report["incident_count"], report["operational_summary"], report["last_insert_id"]) == (2, "ERROR: boom", "e2")
    dead, = events.current_dead_letters(spark, state).collect()
    assert dead["attempts"] == 3 and "incidents is a text" in dead["reason"] and json.loads(dead["raw"])["insert_id"] == "e3"
    # Batches that timers made without rows left nothing.
    assert events.outcome_table(spark, state).manifest()["number"] <= 6


def test_waiting_signatures_survive_a_restart(spark, tmp_path):
    state = str(tmp_path / "state")
    spark.createDataFrame([], events.FAULT_SCHEMA).write.parquet(f"{state}/faults")
    intake(spark, state, 0, one_entry("e1"))

    def down(entries, instruction):
        raise RuntimeError("model is down")

    triage(spark, state, tmp_path, call=down, first_wait=0.1, longest_wait=0.1)
    assert statuses(spark, state) == {} and events.current_reports(spark, state).count() == 0
    # A redelivered copy of a waiting entry is the same entry; another one waits with it.
    intake(spark, state, 1, one_entry("e1"), one_entry("e2"))
    triage(spark, state, tmp_path)
    if not statuses(spark, state):  # the timer was due after the batch had begun
        intake(spark, state, 2, one_entry("e9", "another"))
        triage(spark, state, tmp_path)
    got = {r["log_message"]: r["incident_count"] for r in events.current_reports(spark, state).collect()}
    assert got["boom"] == 2 and statuses(spark, state)["e2"] == "COMPLETED"


def test_rejected_entries_and_expired_reports(spark, tmp_path):
    state = str(tmp_path / "state")
    spark.createDataFrame([], events.FAULT_SCHEMA).write.parquet(f"{state}/faults")
    options = {"max_bytes": 200, "expire_after": 1.0}
    intake(spark, state, 0, one_entry("e1", "x" * 300), one_entry("e2"))
    triage(spark, state, tmp_path, **options)
    assert statuses(spark, state) == {"e1": "FAILED", "e2": "COMPLETED"}
    time.sleep(1.5)
    intake(spark, state, 1, one_entry("e3"))
    triage(spark, state, tmp_path, **options)
    assert events.current_reports(spark, state).count() == 2
    assert events.current_signatures(spark, state).count() == 1


def test_live_counts_over_batches(spark, sf_dir, tmp_path, expected):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, sf_dir, folder, 2)
    deliver(spark, sf_dir, folder, 2)
    query = counts.start_counts(
        stream(spark, folder), fixtures.SELF_SERVICE, f"{root}/rows", f"{root}/cp"
    )
    query.awaitTermination()
    got = {r["signature"]: r["incident_count"] for r in counts.latest_counts(spark, f"{root}/rows").collect()}
    assert got == {k: n for k, (n, _) in expected.items()}


def test_entries_of_any_day_in_any_order(spark, tmp_path):
    """Files that go back in time lose nothing; repeats, a repeated batch and a new run add nothing."""
    out = str(tmp_path / "out")
    schema = "insert_id string, ts timestamp"
    days = ["2024-01-20", "2024-01-05", "2024-01-12", None]
    given = [[(f"{d}-{i}", d and dt.datetime.fromisoformat(d)) for i in range(5)] for d in days]
    for number, rows in enumerate(given):
        batch = spark.createDataFrame(rows * 2 + given[0], schema)
        for _ in range(2):
            new = counts.keep_new(batch, number, out)
            assert new.count() == 5
    stored = counts.read_deduplicated(spark, out, new)
    assert sorted(r["insert_id"] for r in stored.collect()) == sorted(i for g in given for i, _ in g)
    assert counts.keep_new(spark.createDataFrame([], schema), 9, out).count() == 0


def test_counts_of_a_new_checkpoint(spark, sf_dir, tmp_path, expected):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, sf_dir, folder, 2)
    for checkpoint in ("one", "two"):
        counts.start_counts(
            stream(spark, folder), fixtures.SELF_SERVICE, f"{root}/rows", f"{root}/{checkpoint}"
        ).awaitTermination()
    got = {r["signature"]: r["incident_count"] for r in counts.latest_counts(spark, f"{root}/rows").collect()}
    assert got == {k: n for k, (n, _) in expected.items()}


def test_shared_folder_is_the_one_named(spark):
    from faultfold.session import shared_dir, sweep, work_dir

    assert work_dir(spark, "x").startswith(shared_dir(spark))
    made = work_dir(spark, "swept")
    spark.range(3).write.parquet(made)
    sweep(spark)
    assert not Path(made.removeprefix("file:")).exists() and work_dir(spark, "x") != work_dir(spark, "x")
