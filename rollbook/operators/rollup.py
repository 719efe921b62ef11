"""Counts of days and distinct students that roll up from class-months to any level.

Sums add up, distinct students do not: a student of two months is one of the year. So every
cell holds the set of its students as bitmaps over their numbers, 32,768 students each, and
a coarser level unites the bitmaps of equal stretches. Students are numbered class by class,
so the set of a class lies in one or two stretches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import session
from rollbook.operators import rates

COUNTS = ("absences", "presences", "eligibles")


def numbered(rows: DataFrame, entity: str, near: Sequence[str]) -> DataFrame:
    """(entity, ``__number``) with numbers from 1 that follow ``near``; NULL is an entity.

    Numbers are unique and rise without gaps within a range of entities; stored, because a
    second evaluation might cut the ranges elsewhere.
    """
    first = rows.groupBy(entity).agg(F.min(F.struct(*near)).alias("__near"))
    first = session.materialize(first, "rollup-entities")
    ranged = first.repartitionByRange("__near", entity).sortWithinPartitions("__near", entity)
    return session.materialize(ranged.select(entity, (F.monotonically_increasing_id() + 1).alias("__number")), "rollup-numbers")


def cells(days: DataFrame, by: Sequence[str], entity: str, flag: str = "absent", near: Sequence[str] | None = None) -> DataFrame:
    """Day counts and student bitmaps of the finest groups, stored for :func:`roll_up`."""
    return cells_of_counts(rates.day_counts(days, [*by, entity], flag), by, entity, near)


def cells_of_counts(counts: DataFrame, by: Sequence[str], entity: str, near: Sequence[str] | None = None) -> DataFrame:
    """The same from day counts with one row for each group and student."""
    single = session.materialize(counts.select(*by, entity, *COUNTS), "rollup-students")
    keys = numbered(single, entity, near or by).withColumnRenamed(entity, "__entity")
    joined = single.join(keys, F.col(entity).eqNullSafe(F.col("__entity")))
    stretch = F.bitmap_bucket_number("__number").alias("__stretch")
    grouped = joined.groupBy(*by, stretch).agg(
        *(F.sum(c).alias(c) for c in COUNTS), F.bitmap_construct_agg(F.bitmap_bit_position("__number")).alias("__students")
    )
    return session.materialize(grouped, "rollup-cells")


def roll_up(held: DataFrame, by: Mapping[str, Column], students: str = "students", scale: float = 100.0) -> DataFrame:
    """Counts, distinct students and the rate of the groups that ``by`` names."""
    stretches = held.groupBy(*(c.alias(n) for n, c in by.items()), "__stretch").agg(
        *(F.sum(c).alias(c) for c in COUNTS), F.bitmap_or_agg("__students").alias("__students")
    )
    whole = stretches.groupBy(*by).agg(*(F.sum(c).alias(c) for c in COUNTS), F.sum(F.bitmap_count("__students")).alias(students))
    return rates.with_rate(whole, scale)
