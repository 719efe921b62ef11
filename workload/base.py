"""Query registry and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollbook import session

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The generated tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}
        session.tune(spark)

    def __call__(self, name: str) -> DataFrame:
        # One footer read per table and query; the plan decides what is scanned.
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables)`` under ``name`` with the SQL that must agree."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def day(column: str) -> Column:
    return F.col(column).cast("date")


def pad(expression: str, width: int) -> str:
    """SQL text: zero-pad without cutting, NULL as '0'."""
    text = f"coalesce(CAST({expression} AS VARCHAR), '0')"
    return f"(CASE WHEN length({text}) < {width} THEN lpad({text}, {width}, '0') ELSE {text} END)"


def sunday_week(expression: str) -> str:
    return f"strftime({expression}, '%Y-%U')"
