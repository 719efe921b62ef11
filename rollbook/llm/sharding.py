"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollbook.llm.prefix import beside, in_order, prefix_sums, unfold


def shard(df: DataFrame, size: Column, order: list[Column], shards: int) -> DataFrame:
    """Cut ``df`` into ``shards`` contiguous runs of nearly equal total ``size``.

    Rows are sorted by the ``order`` columns, ascending, nulls first; a row belongs to the shard in which the middle of
    its byte range falls, so no shard misses its target by more than one row's size.
    Adds ``size``, ``shard`` (from 0) and ``slot``, the gapless place in the shard.

    Rows equal in all ordering columns stay in an unspecified order; include enough
    columns to make them interchangeable. A null size
    counts as 0, an empty table gives no rows, and a shard stays empty if one row is
    larger than a target or there are fewer rows than shards.
    """
    rows = beside(df, size=F.coalesce(size.cast("long"), F.lit(0)), **{f"o{i}": c for i, c in enumerate(order)})
    keys = [F.col(f"o{i}").asc_nulls_first() for i in range(len(order))]
    ordered = in_order(rows, keys, "shard-order").select("row", "size", "at")
    summed = prefix_sums(ordered, size=F.col("size"), place=F.lit(1))
    total, n = ordered.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # A table of empty rows has no bytes to cut by: its rows are cut by number.
    middle, whole = (2 * F.col("size_before") + F.col("size"), total) if total else (2 * F.col("place_before") + 1, max(n, 1))
    cut = F.floor(middle.cast("decimal(38,0)") * shards / (2 * whole))
    placed = summed.withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
    # One row for each shard.
    begins = placed.groupBy("shard").agg(F.min("place_before").alias("begins"))
    placed = placed.join(F.broadcast(begins), "shard").withColumn("slot", F.col("place_before") - F.col("begins"))
    return unfold(placed, "size", "shard", "slot")

