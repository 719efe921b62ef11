"""Stored attendance and the months that corrections rewrite."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rollbook.operators.corrections import correct_flags
from rollbook.sources import attendance


def table(spark):
    rows = [
        (f"0{k % 29}" if k % 17 else None, dt.date(2015 + k % 2, 1 + k // 2 % 12, 1 + k % 28), k % 5 == 0, 1 + k % 2) for k in range(2000)
    ] + [("03", None, True, 1)]
    return spark.createDataFrame(rows, "combined_number string, date date, absent boolean, phase int")


def days(spark):
    fixes = [("03", 3, [1, 2]), ("04", 3, []), ("05", 9, [9]), ("99", 5, [1]), ("03", None, [1])]
    return spark.createDataFrame(fixes, "combined_number string, month int, days array<int>")


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("phase", [1, None])
def test_corrections_rewrite_touched_months_only(spark, rows, tmp_path, phase):
    path = str(tmp_path / "attendance")
    assert rows(attendance.write(table(spark), path)) == rows(table(spark))
    before = files(path)
    touched = attendance.touched_months(spark, path, days(spark), phase=phase)
    assert touched == [(2015, 3), (2015, 9)] + ([] if phase else [(2016, 3), (2016, 9)])
    got = attendance.correct(spark, path, days(spark), phase=phase)
    want = rows(correct_flags(table(spark), days(spark), phase=phase))
    assert rows(got) == want and want != rows(table(spark))
    folders = {f"{attendance.YEAR}={y}/{attendance.MONTH}={m}" for y, m in touched}
    kept = {f for f in before if os.path.dirname(f) not in folders}
    assert {f for f in files(path) if os.path.dirname(f) not in folders} == kept and kept
    assert not before & files(path) - kept
    assert rows(attendance.correct(spark, path, days(spark), phase=phase)) == want


def test_a_failed_change_leaves_the_table(spark, rows, tmp_path):
    path = str(tmp_path / "attendance")
    attendance.write(table(spark), path, files=1)
    before = files(path)
    fails = lambda r: r.withColumn("absent", F.when(F.dayofmonth("date") > 2, F.raise_error("lost")).otherwise(F.col("absent")))
    with pytest.raises(Exception, match="lost"):
        attendance.rewrite(spark, path, fails, [(2015, 3)])
    with pytest.raises(ValueError, match="another month"):
        attendance.rewrite(spark, path, lambda r: r.withColumn("date", F.add_months("date", 1)), [(2015, 3)])
    assert files(path) == before and rows(attendance.read(spark, path)) == rows(table(spark))


def test_nothing_to_correct(spark, tmp_path):
    path = str(tmp_path / "attendance")
    attendance.write(table(spark), path)
    before = files(path)
    attendance.correct(spark, path, days(spark).filter("false"))
    assert files(path) == before
