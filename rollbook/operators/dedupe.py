"""De-duplication and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook import session
from rollbook.functions import keys


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under an explicit order; NULL keys form one group.

    Spark prunes each map task to one row per key before the shuffle
    (window group limit), so a hot key costs no more than a rare one.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).filter("__row = 1").drop("__row")


def drop_repeats(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication."""
    return df.distinct()


def number_entities(
    df: DataFrame, group: str, order: Sequence[str],
    group_number: str = "school_number", number: str = "student_number",
) -> DataFrame:
    """Number groups by sorted name and rows within each group by ``order``.

    ``order`` should be unique within a group. A window over the whole group
    would put a hot group into one task, so the rows are range-partitioned and
    checkpointed with their partition number; rows are then counted within a
    partition and shifted by the rows of the same group in earlier partitions.
    A NULL group gets no group number.
    """
    placed = session.cut_lineage(
        df.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id())
    )
    # At most one row per group and partition it reaches into.
    blocks = placed.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__block")).agg(
        F.count(F.lit(1)).alias("__rows")
    )
    up_to_here = Window.partitionBy("__group").orderBy("__block")
    offsets = blocks.select(
        "__group", "__block", (F.sum("__rows").over(up_to_here) - F.col("__rows")).alias("__before")
    ).join(
        _group_ranks(blocks, group_number).withColumnRenamed("__group", "__named"),
        F.col("__group") == F.col("__named"), "left",
    ).drop("__named")
    local = Window.partitionBy("__part", group).orderBy(*order)
    same_block = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__block"))
    return (
        placed.withColumn("__local", F.row_number().over(local))
        .join(offsets, same_block)
        .withColumn(number, (F.col("__before") + F.col("__local")).cast("bigint"))
        .select(*df.columns, group_number, number)
    )


def _group_ranks(blocks: DataFrame, number: str) -> DataFrame:
    """Rank of each non-null group by name, from where the sorted groups begin."""
    starts = (
        blocks.filter(F.col("__group").isNotNull())
        .groupBy("__group").agg(F.min("__block").alias("__start"))
    )
    # One row per range partition, so the running sum is short.
    up_to_here = Window.orderBy("__start")
    shifts = starts.groupBy("__start").agg(F.count(F.lit(1)).alias("__n")).select(
        "__start", (F.sum("__n").over(up_to_here) - F.col("__n")).alias("__shift")
    )
    local = Window.partitionBy("__start").orderBy("__group")
    ranked = starts.withColumn("__rank", F.row_number().over(local)).join(shifts, "__start")
    return ranked.select(
        "__group", (F.col("__shift") + F.col("__rank")).cast("bigint").alias(number)
    )


def numbered_ids(df: DataFrame, district_number: str, school: str, order: Sequence[str]) -> DataFrame:
    """Number schools and students and build the combined id."""
    numbered = number_entities(df, school, order)
    return numbered.withColumn(
        "combined_number",
        keys.join_id(F.col(district_number), F.col("school_number"), F.col("student_number")),
    )
