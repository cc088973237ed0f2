"""The table of micro-batches: what counts, what a repeated batch does, and how many folders there are."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from faultfold.streaming.stored import FANOUT, BatchTable, days_of, next_fold


def test_thousand_batches_leave_few_folders():
    files, most, written = [], 0, 0
    for i in range(1000):
        files.append({"level": 0, "rows": {i}})
        while some := next_fold(files):
            files = [f for f in files if f not in some]
            rows = set().union(*(f["rows"] for f in some))
            written += len(rows)
            files.append({"level": some[0]["level"] + 1, "rows": rows})
        most = max(most, len(files))
    assert most <= 4 * FANOUT and written <= 4 * 1000
    assert sorted(r for f in files for r in f["rows"]) == list(range(1000))


def test_days():
    assert days_of([["2024-01-02"], ["2024-01-01", None]]) == [None, "2024-01-01", "2024-01-02"]
    assert days_of([["2024-01-02"], None]) is None
    assert days_of([[str(i)] for i in range(101)]) is None


def rows_of(table, **options):
    return sorted(tuple(r) for r in table.read(**options).collect())


def batch(spark, i):
    return spark.createDataFrame([(i, dt.date(2024, 1, 1 + i % 3))], "n long, day date")


def test_folding_repeats_and_leftovers(spark, tmp_path):
    path = str(tmp_path / "table")
    table = BatchTable(spark, path, "n long, day date", day="day", fanout=3)
    assert rows_of(table) == [] and table.own("a", 0) is None
    before = None
    for i in range(20):
        day = f"2024-01-0{1 + i % 3}"
        assert table.next_number() == i + 1
        assert table.append(batch(spark, i), "a", i, [day]) == i + 1
        # The same batch again, with other rows: what is committed stays.
        assert table.append(batch(spark, 99), "a", i, [day]) == i + 1
        own, number = table.own("a", i)
        assert [r["n"] for r in own.collect()] == [i] and number == i + 1
        live = table.manifest()["files"]
        assert len(live) <= 8 and len(table.folder.names("data")) <= 24
        assert len(table.folder.names("manifest")) <= 3
        if before is not None:
            # A reader that began before the last commit still finds its files.
            assert before.count() == i
        before = table.read()
    assert [n for n, _ in rows_of(table)] == list(range(20))
    some = table.read(days=["2024-01-02"])
    assert sorted(r["n"] for r in some.collect()) == [1, 4, 7, 10, 13, 16, 19]
    # A writer that failed before its commit left a folder; it does not count and goes with the next commit.
    batch(spark, 77).write.parquet(f"{path}/data/left")
    assert 77 not in [n for n, _ in rows_of(table)]
    again = BatchTable(spark, path, "n long, day date", day="day", fanout=3)
    assert again.append(batch(spark, 50), "b", 0, [None]) == 21
    assert "left" not in os.listdir(f"{path}/data")
    with pytest.raises(RuntimeError, match="comes after"):
        again.append(batch(spark, 5), "a", 5)
    # The last batch of the first run can still be repeated.
    assert [r["n"] for r in again.own("a", 19)[0].collect()] == [19]


def test_days_open_few_folders(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "table"), "n long, day date", day="day", fanout=50)
    for i in range(6):
        table.append(batch(spark, i), "a", i, [f"2024-01-0{1 + i % 3}"])
    table.append(spark.createDataFrame([(9, None)], "n long, day date"), "a", 6, [None])
    opened = {f.split("/")[-2] for f in table.read(days=["2024-01-01"]).inputFiles()}
    assert len(opened) == 2 and rows_of(table, days=[None]) == [(9, None)]
    assert len(rows_of(table, days=["2024-01-01", None])) == 3 and rows_of(table, days=[]) == []


def test_rows_are_merged_and_empty_batches_skipped(spark, tmp_path):
    fold = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    table = BatchTable(spark, str(tmp_path / "table"), "k string, n long", fold=fold, fanout=4)
    for i in range(17):
        table.append(spark.createDataFrame([("x", 1), (f"y{i % 2}", i)], "k string, n long"), "a", i)
    assert table.read().count() < 24
    assert sorted(tuple(r) for r in fold(table.read()).collect()) == [("x", 17), ("y0", 72), ("y1", 64)]
    number, names = table.manifest()["number"], set(table.folder.names("data"))
    table.append(spark.createDataFrame([], "k string, n long"), "a", 17, skip_empty=True)
    assert table.manifest()["number"] == number and table.own("a", 17) is None
    # A batch may be replaced while it is the last, and be taken away by an empty one.
    for rows in ([("z", 5)], [("z", 7), ("x", 1)]):
        assert table.append(spark.createDataFrame(rows, "k string, n long"), "a", 18, replace=True) == number + 1
    assert [r["n"] for r in fold(table.read()).where("k = 'z'").collect()] == [7] and names
    table.append(spark.createDataFrame([], "k string, n long"), "a", 18, skip_empty=True, replace=True)
    assert fold(table.read()).where("k = 'z'").count() == 0


def test_a_second_writer_fails(spark, tmp_path):
    one = BatchTable(spark, str(tmp_path / "table"), "n long, day date")
    two = BatchTable(spark, str(tmp_path / "table"), "n long, day date")
    stale = two.manifest()
    one.append(batch(spark, 1), "a", 0)
    two.manifest = lambda: stale
    with pytest.raises(RuntimeError, match="another writer"):
        two.append(batch(spark, 2), "b", 0)
    assert [n for n, _ in rows_of(one)] == [1]
