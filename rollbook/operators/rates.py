"""Rates from flagged entity-days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook import constants as K


def distinct_with_null(column: Column) -> Column:
    """Distinct values, NULL counting as one value."""
    return F.count_distinct(column) + F.max(F.when(column.isNull(), 1).otherwise(0))


def day_counts(df: DataFrame, by: Sequence[str], flag: str = "absent") -> DataFrame:
    """``absences``, ``presences`` and ``eligibles`` (all rows) of a nullable flag per group."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(flag)).alias("absences"), F.count_if(~F.col(flag)).alias("presences"),
        F.count(F.lit(1)).alias("eligibles"),
    )


def sum_counts(
    counts: DataFrame, by: Sequence[str], distinct: Mapping[str, str] | None = None,
    unique: str | None = None, scale: float = 100.0,
) -> DataFrame:
    """Day counts summed to coarser groups, with the rate.

    ``distinct`` maps output names to columns whose distinct values are counted,
    NULL as one value. ``unique`` names a column that does not repeat within a
    group of ``by``: its values are simply the rows.
    """
    numbers = []
    for name, column in (distinct or {}).items():
        if column in by:
            number = F.lit(1).cast("bigint")
        elif column == unique:
            number = F.count(F.lit(1))
        else:
            number = distinct_with_null(F.col(column))
        numbers.append(number.alias(name))
    sums = [F.sum(c).alias(c) for c in ("absences", "presences", "eligibles")]
    return with_rate(counts.groupBy(*by).agg(*numbers, *sums), scale)


def with_rate(counts: DataFrame, scale: float = 100.0) -> DataFrame:
    return counts.withColumn(
        "absenteeism_rate", F.try_divide(F.col("absences") * F.lit(scale), F.col("eligibles"))
    )


def rate_by(
    df: DataFrame, by: Sequence[str], flag: str = "absent",
    distinct: Mapping[str, str] | None = None, scale: float = 100.0,
) -> DataFrame:
    """Day counts per group with ``absenteeism_rate`` = absences / eligibles x ``scale``.

    With ``distinct`` (see :func:`sum_counts`) rows are first reduced to one per
    group and counted value, so neither a hot group nor the fan-out of several
    distinct counts meets the raw rows.
    """
    if not distinct:
        return with_rate(day_counts(df, by, flag), scale)
    counted = [c for c in dict.fromkeys(distinct.values()) if c not in by]
    unique = counted[0] if len(counted) == 1 else None
    return sum_counts(day_counts(df, [*by, *counted], flag), by, distinct, unique, scale)


def overall_rate(flag: str = "absent") -> Column:
    """Share of TRUE flags among all rows, as an aggregate."""
    return F.try_divide(F.count_if(F.col(flag)), F.count(F.lit(1)))


def pair_ratio(
    daily: DataFrame, group: str, first: object, second: object, date: str = "date",
    rate: str = "absenteeism_rate", count: str = "eligibles",
) -> DataFrame:
    """Two groups' series side by side, every date of either, and their ratio.

    ``ratio`` is ``second`` as a percentage of ``first``. The outer join of the
    two series is written as one conditional aggregate over the daily rows.
    """

    def pick(value: str, which: object) -> Column:
        return F.max(F.when(F.col(group) == F.lit(which), F.col(value)))

    wide = (
        daily.filter(F.col(group).isin(first, second))
        .groupBy(date)
        .agg(
            pick(rate, first).alias("first_rate"), pick(count, first).alias("first_students"),
            pick(rate, second).alias("second_rate"), pick(count, second).alias("second_students"),
        )
    )
    total = F.col("first_students") + F.col("second_students")
    return wide.withColumns({
        "ratio": F.try_divide(F.col("second_rate"), F.col("first_rate")) * 100,
        "total_students": total,
        "avg_students": total / 2,
    })


def outer_pair(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join of two series that are separate tables."""
    return left.join(right, list(on), "full")


def rolling_ratio(
    pair: DataFrame, date: str = "date", days: int = K.ROLLING_DAYS, by: Sequence[str] = (),
) -> DataFrame:
    """Ratio of the two mean rates over the last ``days`` calendar days, inclusive.

    Works on the daily pair series, one row per date: the ordered window holds
    as many rows as the calendar has days.
    """
    w = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(F.unix_date(F.col(date)))
        .rangeBetween(-days, 0)
    )
    mean = {c: F.avg(c).over(w) for c in ("first_rate", "second_rate")}
    return pair.withColumn(
        "rolling_mean", F.try_divide(mean["second_rate"], mean["first_rate"]) * 100
    )


def sample_filter(
    pair: DataFrame, min_sample: int = K.MIN_STUDENTS,
    bounds: tuple[float, float] = K.RATIO_BOUNDS,
) -> DataFrame:
    """Dates with enough students on both sides and a ratio within bounds."""
    return pair.filter(
        F.col("avg_students").isNotNull()
        & (F.col("first_students") >= min_sample)
        & (F.col("second_students") >= min_sample)
        & F.col("rolling_mean").between(*bounds)
    )


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted mean; rows with a NULL value weigh nothing."""
    known = F.col(value).isNotNull()
    return F.try_divide(
        F.sum(F.col(value) * F.col(weight)), F.sum(F.when(known, F.col(weight)))
    )


def weighted_monthly(pair: DataFrame, date: str = "date") -> DataFrame:
    """Monthly means weighted by students, and their ratio."""
    monthly = pair.groupBy(F.trunc(date, "MM").alias("year_month")).agg(
        weighted_mean("first_rate", "first_students").alias("first_rate"),
        weighted_mean("second_rate", "second_students").alias("second_rate"),
    )
    return monthly.withColumn(
        "ratio", F.try_divide(F.col("second_rate"), F.col("first_rate")) * 100
    )
