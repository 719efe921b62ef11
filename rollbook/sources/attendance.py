"""Attendance stored by month, and corrections that rewrite only the months they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollbook import session
from rollbook.operators.corrections import correct_flags

#: Partition columns of a stored attendance table, beside its own columns.
YEAR, MONTH = "in_year", "in_month"


def _by_month(rows: DataFrame, entity: str, date: str, files: int) -> DataFrame:
    """Rows with their month; each month's rows come to at most ``files`` tasks."""
    share = F.pmod(F.xxhash64(entity, date), F.lit(files))
    return rows.withColumns({YEAR: F.year(date), MONTH: F.month(date)}).repartition(YEAR, MONTH, share)


def write(attendance: DataFrame, path: str, entity: str = "combined_number", date: str = "date", files: int = 8) -> DataFrame:
    """Store attendance in a folder for each month; returns :func:`read`.

    Rows without a date go to a folder of their own. ``files`` bounds the files of a month.
    """
    _by_month(attendance, entity, date, files).write.partitionBy(YEAR, MONTH).parquet(path)
    return read(attendance.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(YEAR, MONTH)


def touched_months(spark: SparkSession, path: str, days: DataFrame, entity: str = "combined_number", phase: int | None = 1) -> list[tuple[int, int]]:
    """The stored months that hold a row of a corrected person's corrected month.

    Only folders of corrected month numbers are read, and of them two columns.
    """
    numbers = [r.month for r in days.select("month").dropna().distinct().collect()]  # twelve at most
    rows = spark.read.parquet(path).filter(F.col(MONTH).isin(numbers))
    if phase is not None:
        rows = rows.filter(F.col("phase") == phase)
    fixed = days.select(F.col(entity).alias("__entity"), F.col("month").alias("__month")).distinct()
    hit = rows.join(fixed, (F.col(entity) == F.col("__entity")) & (F.col(MONTH) == F.col("__month")), "left_semi")
    return sorted((r[0], r[1]) for r in hit.select(YEAR, MONTH).distinct().collect())


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], months: list[tuple[int, int]], entity: str = "combined_number", date: str = "date", files: int = 8) -> None:
    """Replace the rows of some months by what ``change`` makes of them.

    The new rows are stored elsewhere first, so a failure on the way leaves the table as it
    was; then the folders of these months are exchanged, and no other is looked at. A
    ``change`` must keep every row in its month.
    """
    if not months:
        return
    wanted: Column = F.lit(False)
    for year, month in months:
        wanted = wanted | ((F.col(YEAR) == year) & (F.col(MONTH) == month))
    before = spark.read.parquet(path).filter(wanted).drop(YEAR, MONTH)
    with session.stores(spark):
        after = session.materialize(change(before), "rewritten-months")
        strays = after.filter(~F.struct(F.year(date), F.month(date)).isin(*(F.struct(F.lit(y), F.lit(m)) for y, m in months)))
        if not strays.isEmpty():
            raise ValueError("a change may not move rows to another month")
        exchanged = _by_month(after, entity, date, files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        exchanged.partitionBy(YEAR, MONTH).parquet(path)


def correct(spark: SparkSession, path: str, days: DataFrame, entity: str = "combined_number", flag: str = "absent", date: str = "date", phase: int | None = 1, files: int = 8) -> DataFrame:
    """Apply corrections to stored attendance and return it read anew.

    ``days`` come from :func:`rollbook.operators.corrections.correction_days`. Months without
    a corrected row keep their files; applying the same corrections again changes nothing.
    """
    months = touched_months(spark, path, days, entity, phase)
    rewrite(spark, path, lambda rows: correct_flags(rows, days, entity, flag, date, phase), months, entity, date, files)
    return read(spark, path)
