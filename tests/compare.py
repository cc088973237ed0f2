"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if type(value).__name__ == "Decimal":
        return repr(int(value)) if value == int(value) else repr(round(float(value), 9))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(table, key=lambda r: tuple((v is not None, v or "") for v in r))


def compare(spark, db, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, frame.collect())
    answer = db.sql(sql)
    theirs = rows_of(answer.columns, answer.fetchall())
    return ours, theirs


def difference(ours, theirs) -> str | None:
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    for left, right in zip(ours[1], theirs[1], strict=True):
        if left != right:
            return f"{left} != {right}"
    return None
