"""The whole study: forms in, result tables out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from rollbook import session
from rollbook.functions import recode
from rollbook.operators import corrections as fix
from rollbook.operators import linkage, panel, quality, reshape
from rollbook.plans import phase_one, phase_two


def phase_one_tables(forms: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Panel and roster of the first phase from its forms.

    Needs ``form_a_core``, ``form_b_core``, ``form_c_core``,
    ``form_c_days_first`` / ``_second`` / ``_third``, ``school_names`` and ``ids``.
    """
    schools = recode.standardise_names(
        phase_one.pick(forms["form_a_core"], phase_one.SCHOOL_COLUMNS),
        forms["school_names"], "SCHOOL_NAME", "School names…", "Correct name",
    )
    classes = phase_one.pick(forms["form_b_core"], phase_one.CLASS_COLUMNS)
    students = phase_one.pick(forms["form_c_core"], phase_one.STUDENT_COLUMNS)
    slots = {
        1: forms["form_c_days_first"], 2: forms["form_c_days_second"],
        3: forms["form_c_days_third"],
    }
    absences = phase_one.slot_absences(slots, students, classes)
    eligible = phase_one.eligible_students(
        students, phase_one.eligible_classes(classes, schools)
    )
    roster = phase_one.roster(eligible, forms["ids"])
    # The combined id is put on the students before they are stored: phases meet by it.
    numbers = roster.select(F.col("student_id").alias("_URI"), "combined_number").distinct()
    calendars = phase_one.phase_one_calendars(
        students.join(numbers, "_URI", "left"), classes, schools, absences, number="combined_number"
    )
    return {
        "panel": panel.expand_calendars(phase_one.describe(calendars.drop("combined_number"))),
        "students": roster,
        "calendars": calendars.select("student_id", "store_key", "combined_number", "days", "marks"),
        "school_locations": phase_one.school_locations(schools),
        "reference": students.join(
            classes.select("CLASS_UUID", *[
                F.col(c).cast("int").alias(n) for c, n in zip(phase_one.MONTHS, fix.SLOT_MONTHS)
            ]),
            "CLASS_UUID", "left",
        ).select(
            F.col("PERMID").alias("permid"), F.col("NAME").alias("name"), *fix.SLOT_MONTHS,
            F.col("_URI").alias("reference_order"),
        ),
    }


def performance(form_b2: DataFrame, form_b2b: DataFrame) -> DataFrame:
    """Marks of both evaluation forms as one long table."""
    first = recode.suffix_columns(form_b2, "avaliation", "_2015")
    second = recode.suffix_columns(form_b2b, "avaliation", "_2016")
    clash = [c for c in second.columns if c in set(first.columns)]
    joined = first.join(
        second.drop(*clash), first["uri"] == second["parent_auri"], "inner"
    )
    wide = recode.rename_ethics(joined)
    return reshape.marks_long(wide, ["combined_number"], reshape.mark_columns(wide))


def corrected(
    calendars: DataFrame, students: DataFrame, corrections: DataFrame, reference: DataFrame,
    student_order: str = "student_id",
) -> tuple[DataFrame, DataFrame]:
    """Attendance from two-phase calendars and students, after all corrections."""
    matched = fix.match_corrections(corrections, students, student_order)
    monthed = fix.with_reference_months(matched, reference, "reference_order")
    days = fix.correction_days(monthed, "correction_order")
    return (
        panel.attendance_rows(calendars, days),
        fix.correct_entities(students, corrections, "correction_order", student_order),
    )


def census_students(students: DataFrame, census: DataFrame) -> DataFrame:
    """Students with census attributes, positions also by the nearest name; the name
    column in lower case. A position by exact linkage is a perfect match.
    """
    linked = linkage.link_nearest(linkage.link_exact(students, census), census)
    return linked.withColumnRenamed("NAME", "name")


def schools(students: DataFrame, locations: DataFrame) -> DataFrame:
    order = [F.col(c) for c in ("district_number", "school_number", "lat", "lng")]
    return quality.school_dimension(students, locations, order)


def both_phases(
    forms: Mapping[str, DataFrame], form_b2: DataFrame, form_b3: DataFrame,
    tables: list[phase_two.MonthTable], calendar: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """:func:`phase_one_tables` and :func:`second_phase`, their stores written at the same time."""
    first, second = session.together(
        lambda: phase_one_tables(forms), lambda: second_phase(form_b2, form_b3, tables, calendar, store=True)
    )
    return first, second


def study(
    first: Mapping[str, DataFrame], second: Mapping[str, DataFrame], corrections: DataFrame,
    census: DataFrame, marks: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Result tables from the phases' tables, corrections and census."""
    # Second-phase students all have an id, so nobody without one is seen in both.
    both = panel.two_phase_calendars(first["calendars"], second["calendars"], null_is_entity=False)
    attendance, students = corrected(both, first["students"], corrections, first["reference"])
    linked = census_students(students, census)
    tables = {
        "attendance": attendance.withColumns(
            {"day": F.dayofmonth("date"), "month": F.month("date")}
        ),
        "students": linked,
        "schools": schools(linked, first["school_locations"]),
    }
    return tables if marks is None else {**tables, "performance": marks}


def second_phase(
    form_b2: DataFrame, form_b3: DataFrame, tables: list[phase_two.MonthTable],
    calendar: DataFrame | None = None, store: bool = False,
) -> dict[str, DataFrame]:
    """Classes, absences, attendance and reconciliation of the second phase."""
    classes = phase_two.student_classes(form_b2, form_b3)
    absences = phase_two.class_absences(phase_two.dated_months(tables), classes)
    calendars = phase_two.phase_two_calendars(classes, absences, calendar=calendar, store=store)
    attendance = panel.expand_calendars(calendars)
    return {
        "classes": classes,
        "absences": absences,
        "calendars": calendars,
        "attendance": attendance,
        "reconciliation": panel.reconcile_calendars(calendars, "combined_number"),
    }
