"""Joins. No broadcast is forced: Spark broadcasts a side whose size it has
checked against ``spark.sql.autoBroadcastJoinThreshold`` (again at run time
with adaptive execution) and otherwise shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import session


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in set(right.columns)]


def left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Enriching left join; with ``null_safe`` a NULL key matches a NULL key."""
    if not null_safe:
        return left.join(right, list(on), "left")
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in on})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in on]
    )
    return left.join(renamed, same, "left").drop(*[f"__right_{k}" for k in on])


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = False) -> DataFrame:
    """Left join on all columns the two sides share."""
    on = shared_columns(left, right)
    if not on:
        raise ValueError("the two sides share no column")
    return left_join(left, right, on, null_safe)


def parent_child(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str,
    how: str = "inner", drop: Sequence[str] = (),
) -> DataFrame:
    """Join a form to its child form; columns named in ``drop`` leave the parent."""
    kept = parent.drop(*drop)
    return kept.join(child, kept[parent_key] == child[child_key], how).drop(child_key)


def flag_join(
    panel: DataFrame, events: DataFrame, on: Sequence[str], flag: str = "absent"
) -> DataFrame:
    """Panel rows flagged TRUE where an event with the same keys exists.

    Events are reduced to distinct keys first, so repeats add no panel rows.
    """
    marks = events.select(*on).distinct().withColumn(flag, F.lit(True))
    return panel.join(marks, list(on), "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def conflicts(facts: DataFrame, days_off: DataFrame, on: Sequence[str]) -> DataFrame:
    """Facts that fall on a reported day off."""
    return facts.join(days_off.select(*on), list(on), "left_semi")


def exclude_listed(df: DataFrame, listing: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the list (rows with a NULL key stay)."""
    return df.join(listing.select(*on), list(on), "left_anti")


def keep_listed(df: DataFrame, listing: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the list."""
    return df.join(listing.select(*on), list(on), "left_semi")


def cumulative_snapshots(series: DataFrame, date: str = "date") -> DataFrame:
    """For every observed date, all rows of the series up to it.

    The series must be aggregated to days already. Each row is expanded over
    the later calendar days and kept where the day was observed: an equi-join,
    not a theta join.
    """
    # Small (a row for each day and group) and read three times: stored once.
    series = session.materialize(series, "daily-series")
    observed = series.select(F.col(date).alias("observation_date")).distinct()
    last = series.select(F.max(date)).scalar()
    expanded = series.filter(F.col(date).isNotNull()).withColumn(
        "observation_date", F.explode(F.sequence(F.col(date), last))
    )
    return expanded.join(observed, "observation_date", "left_semi").withColumn(
        "today", F.col(date) == F.col("observation_date")
    )


def tag_union(slices: dict[object, DataFrame], tag: str) -> DataFrame:
    """Union of same-schema slices, each tagged with its dict key."""
    return union_all([df.withColumn(tag, F.lit(k)) for k, df in slices.items()])


def union_all(frames: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    """Union by name; ``fill_missing`` fills columns a frame lacks with NULL."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), frames
    )


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which all the named columns are non-null."""
    return df.dropna(subset=list(columns))


def without_value(df: DataFrame, column: str, value: object) -> DataFrame:
    """Drop rows holding one literal value; NULL rows stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def ordered(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.orderBy(*by)
