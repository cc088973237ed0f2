"""How the events table is delivered to the streams."""

from pathlib import Path

from pyspark.sql import functions as F

from faultfold.plans import catalog
from faultfold.streaming import events


def test_a_delivery_of_many_files_is_one_micro_batch(spark, tmp_path, monkeypatch):
    """However many files the table and its deliveries have, the stream takes a delivery at a time."""
    monkeypatch.setattr(catalog, "ROWS_A_FILE", 20)
    source, here = f"{tmp_path}/tables/events.parquet", f"{tmp_path}/here"
    rows = spark.range(300).select(
        F.col("id").alias("event_id"), F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, cast(id AS int))").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"),
        F.lit('{"k": 1}').alias("props"),
    )
    rows.repartition(6).write.parquet(source)
    stream = catalog.event_stream(spark, f"{tmp_path}/tables", here)
    assert len([n for n in Path(f"{here}/delivered").iterdir() if n.suffix == ".parquet"]) == 20
    sizes = []
    query = stream.writeStream.foreachBatch(lambda batch, n: sizes.append(batch.count()))
    query.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sizes == [100] * 4
    monkeypatch.setattr(catalog, "ROWS_A_FILE", 1_000)
    counted = catalog.QUERIES["stream_counts"](spark, f"{tmp_path}/tables")
    assert counted.agg(F.sum("incident_count")).first()[0] == 300


def test_state_has_the_partitions_its_faults_need(spark, tmp_path, monkeypatch):
    """A session that shuffles into many partitions does not open a state store for each."""
    entries = [(f"i-{n}", f"svc-{n % 3}", f"disk {'abc'[n % 3]} is full") for n in range(9)]
    body = F.to_json(F.struct(
        F.col("id").alias("insertId"), F.lit("ERROR").alias("severity"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
        F.struct(F.lit("run").alias("type"), F.create_map(F.lit("service_name"), "service").alias("labels")).alias("resource"),
        F.col("message").alias("textPayload"),
    ))
    rows = spark.createDataFrame(entries, "id string, service string, message string")
    rows = rows.select(F.struct(F.base64(body.cast("binary")).alias("data")).alias("message"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * cores))
    try:
        for name, size, expected in (("few", 20_000, cores), ("many", 3 / (cores + 2), cores + 2), ("most", 0.001, 3 * cores)):
            monkeypatch.setattr(events, "FAULTS_A_PARTITION", size)
            root, checkpoint = f"{tmp_path}/{name}", f"{tmp_path}/cp-{name}"
            stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
            events.run_triage(stream, root, "faultfold", checkpoint)
            found = [n for n in Path(f"{checkpoint}/triage/state/0").iterdir() if n.name.isdigit()]
            assert len(found) == expected
            assert sorted(r["incident_count"] for r in events.current_reports(spark, root).collect()) == [3, 3, 3]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_only_an_unreadable_delivery_is_kept_as_it_came(spark):
    good = spark.range(1).select(F.to_json(F.struct(F.lit("a").alias("insertId"), F.lit("ERROR").alias("severity"))).alias("t"))
    data = [r["d"] for r in good.select(F.base64(F.col("t").cast("binary")).alias("d")).collect()] + ["%%%"]
    rows = spark.createDataFrame([((d,),) for d in data], "message struct<data: string>")
    found = {r["reason"]: (r["insert_id"], r["raw"]) for r in events.wanted_rows(rows, "own").collect()}
    assert found == {None: ("a", None), "bad_base64": (None, "%%%")}
