"""Run a registered query and its SQL on the same files and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

LOOSE = {"TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "int"}
SPARK = {"tinyint": "int", "smallint": "int", "bigint": "int", "int": "int"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, run, sql) -> str | None:
    """None when both agree, else what differs."""
    df = run(spark, folder)
    got_names = df.columns
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want_rows = cursor.fetchall()
    got_rows = [tuple(r) for r in df.collect()]
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} vs {sorted(want_names)}"
    got, want = rows_of(got_names, got_rows), rows_of(want_names, want_rows)
    if len(got_rows) != len(want_rows) or got != want:
        extra, lost = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {len(got_rows)} vs {len(want_rows)}\n  only spark {extra}\n  only sql {lost}"
    odd = []
    for field in df.schema.fields:
        mine = SPARK.get(field.dataType.simpleString(), field.dataType.simpleString())
        his = want_types[field.name]
        his = {"VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean",
               "STRING": "string", "NUMBER": "?"}.get(his, LOOSE.get(his, his))
        if mine != his and his != "?":
            odd.append((field.name, mine, his))
    if odd:
        return f"types {odd}"
    return None if got_rows else "both empty"
