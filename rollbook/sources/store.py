"""Snapshots and result files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table and return it read back, with its lineage cut."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ENTRIES = "identity string, folder string, written timestamp"


def identity(spark: SparkSession, inputs: Sequence[str] = (), parameters: Mapping[str, object] | None = None) -> str:
    """What a result depends on: names, sizes and times of its input files, and parameters.

    Files are listed, not read. Order among them does not matter.
    """
    parts = ["0", "0"]
    if inputs:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
        mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        parts = [str(v) for v in files.agg(F.count(F.lit(1)), F.sum(mark)).first()]
    held = json.dumps([parts, {k: repr(v) for k, v in (parameters or {}).items()}], sort_keys=True)
    return hashlib.sha256(held.encode()).hexdigest()[:32]


def cached(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame],
    partition_by: Sequence[str] = (), inputs: Sequence[str] = (),
    parameters: Mapping[str, object] | None = None,
) -> DataFrame:
    """The saved table of this identity if there is one, else the computed one, saved.

    A table goes to a folder of its own below ``path``; when it is complete, one row that
    names it is added to ``entries``. So a broken write, or one still under way, is never
    served, a changed input or parameter asks for a new table, and readers of an earlier
    table keep it. Of two tables of one identity the later counts.
    """
    key, base = identity(spark, inputs, parameters), path.rstrip("/")
    folder = _entry(spark, base, key)
    if folder is None:
        folder = f"table-{uuid.uuid4().hex}"
        out = compute()
        out.write.partitionBy(*partition_by).parquet(f"{base}/{folder}")
        entry = spark.range(1).select(F.lit(key).alias("identity"), F.lit(folder).alias("folder"), F.current_timestamp().alias("written"))
        entry.coalesce(1).write.mode("append").parquet(f"{base}/entries")
    return load_snapshot(spark, f"{base}/{folder}")


def _entry(spark: SparkSession, base: str, key: str) -> str | None:
    """The folder of the complete table of an identity."""
    try:
        entries = spark.read.schema(_ENTRIES).parquet(f"{base}/entries")
        return entries.filter(F.col("identity") == key).agg(F.max_by("folder", F.struct("written", "folder"))).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_csv(df: DataFrame, path: str) -> None:
    """Write a report as CSV with a header; a quote inside a cell is doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Write several result tables, one CSV folder each."""
    for name, df in tables.items():
        write_csv(df, f"{folder.rstrip('/')}/{name}")
