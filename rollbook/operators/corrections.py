"""Bulk corrections of students and of their attendance, as single joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import constants as K
from rollbook.operators.dedupe import keep_first

SLOT_DAYS = ("first_months", "second_months", "third_months")
SLOT_MONTHS = ("month_1", "month_2", "month_3")
ATTRIBUTES = {
    "name_schools": "SCHOOL_NAME",
    "dobs": "DOB",
    "grades": "GRADE",
    "class_names": "CLASS_NAME",
}


def _order(order: str) -> list[Column]:
    return [F.col(order).asc_nulls_last()]


def _corrected(rows: DataFrame, corrections: DataFrame, person: str, name: str) -> DataFrame:
    """The few rows of persons that a correction names: pruned before anything is sorted."""
    persons = corrections.select(F.col("permids").alias(person), F.col("NAME").alias(name)).dropna().distinct()
    return rows.join(persons, [person, name], "left_semi")


def match_corrections(
    corrections: DataFrame, students: DataFrame, student_order: str,
    entity: str = "combined_number",
) -> DataFrame:
    """Corrections with the combined id of the first student of that permid and name.

    A correction without name, permid or matching id is dropped.
    """
    known = _corrected(students, corrections, "PERMID", "NAME")
    first = keep_first(known, ["PERMID", "NAME"], _order(student_order)).select(
        F.col("PERMID").alias("permids"), "NAME", F.col(entity)
    )
    return corrections.join(first, ["permids", "NAME"], "inner").filter(F.col(entity).isNotNull())


def correct_entities(
    students: DataFrame, corrections: DataFrame, order: str, student_order: str,
    attributes: Mapping[str, str] = ATTRIBUTES, entity: str = "combined_number",
) -> DataFrame:
    """Replace student attributes by the last non-null correction of each field.

    Corrected students are reduced to their first row (by ``student_order``);
    students without a correction stay as they are.
    """
    last = corrections.groupBy(
        F.col("permids").alias("PERMID"), "NAME"
    ).agg(*[
        F.max_by(F.col(new), F.when(F.col(new).isNotNull(), F.col(order))).alias(f"__new_{old}")
        for new, old in attributes.items()
    ])
    # Only persons whose first row carries an id can be corrected.
    known = _corrected(students, corrections, "PERMID", "NAME")
    first = keep_first(known, ["PERMID", "NAME"], _order(student_order))
    fixed = first.filter(F.col(entity).isNotNull()).join(last, ["PERMID", "NAME"], "inner")
    replaced = fixed.withColumns({
        old: F.coalesce(F.col(f"__new_{old}"), F.col(old)) for old in attributes.values()
    }).select(*students.columns)
    untouched = students.join(fixed.select("PERMID", "NAME"), ["PERMID", "NAME"], "left_anti")
    return untouched.select(*students.columns).unionByName(replaced)


def with_reference_months(
    corrections: DataFrame, reference: DataFrame, reference_order: str,
    months: Sequence[str] = SLOT_MONTHS,
) -> DataFrame:
    """Add a person's reference months, found by permid and name, else by name alone.

    ``reference`` holds ``permid``, ``name`` and the month columns; the first
    row by ``reference_order`` counts.
    """
    order = _order(reference_order)
    payload = F.struct(*months).alias("__months")
    own = _corrected(reference, corrections, "permid", "name")
    named = corrections.select(F.col("NAME").alias("name")).dropna().distinct()
    namesakes = reference.join(named, "name", "left_semi")
    person = keep_first(own, ["permid", "name"], order).select(
        F.col("permid").alias("permids"), F.col("name").alias("NAME"), payload
    )
    by_name = keep_first(namesakes, ["name"], order).select(
        F.col("name").alias("NAME"), payload.alias("__fallback")
    )
    joined = corrections.join(person, ["permids", "NAME"], "left").join(by_name, "NAME", "left")
    found = F.coalesce(F.col("__months"), F.col("__fallback"))
    return joined.withColumn("__found", found).select(
        *corrections.columns, *[F.col(f"__found.{m}").alias(m) for m in months]
    )


def day_list(text: Column) -> Column:
    """Day numbers of a cell such as ``3|14|15``; other text is left out, NULL gives none."""
    numbers = F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\|"),
        lambda t: F.trim(t).try_cast("double").cast("int"),
    )
    return F.filter(numbers, lambda d: d.isNotNull())


def correction_days(
    corrections: DataFrame, order: str, entity: str = "combined_number",
    months: Sequence[str] = SLOT_MONTHS, days: Sequence[str] = SLOT_DAYS,
) -> DataFrame:
    """Per entity and month the corrected absence days; the last correction wins."""
    slots = F.array(*[
        F.struct(
            F.col(m).cast("int").alias("month"), F.lit(i).alias("slot"),
            day_list(F.col(d)).alias("days"),
        )
        for i, (m, d) in enumerate(zip(months, days))
    ])
    listed = (
        corrections.select(entity, F.col(order).alias("__order"), F.explode(slots).alias("s"))
        .select(entity, "__order", "s.*")
        .filter(F.col("month").isNotNull())
    )
    latest = keep_first(listed, [entity, "month"], [F.desc("__order"), F.desc("slot")])
    return latest.select(entity, "month", "days")


def correct_flags(
    attendance: DataFrame, days: DataFrame, entity: str = "combined_number",
    flag: str = "absent", date: str = "date", phase: int | None = 1,
) -> DataFrame:
    """Reset corrected months to present and set the listed days absent.

    ``phase`` limits the effect to the phase the corrections belong to; None
    applies a month number in every year. Days outside the panel are ignored.
    """
    fixes = days.select(
        F.col(entity).alias("__entity"), F.col("month").alias("__month"), F.col("days").alias("__days")
    )
    hit = (F.col(entity) == F.col("__entity")) & (F.month(date) == F.col("__month"))
    if phase is not None:
        hit = hit & (F.col("phase") == phase)
    corrected = F.when(
        F.col("__days").isNotNull(), F.array_contains(F.col("__days"), F.dayofmonth(date))
    ).otherwise(F.col(flag))
    return attendance.join(fixes, hit, "left").withColumn(flag, corrected).select(
        *attendance.columns
    )
