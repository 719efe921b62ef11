"""Second phase: dated absences of named months, classes, and attendance."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from rollbook import constants as K
from rollbook.functions import dates, keys
from rollbook.operators import joins, panel, rates
from rollbook.operators.dedupe import keep_first

CLASS_KEYS = ["school_number", "grade", "class"]


@dataclass(frozen=True)
class MonthTable:
    """One month's absence table with its parent form.

    ``parent`` has ``uri`` and ``combined_number``; ``days`` has ``parent_auri``
    and the day of month in ``day_column``.
    """

    month: str
    year: int
    source: str
    days: DataFrame
    parent: DataFrame
    day_column: str = "day"


def form_b2_ids(form: DataFrame) -> DataFrame:
    """Second-phase students with their normalised id."""
    return form.withColumn("combined_number", keys.composite_id(F.col("student_number")))


def form_b3_ids(form: DataFrame) -> DataFrame:
    """Third-form students, whose ids have lost a leading zero."""
    return form.withColumn(
        "combined_number", keys.repair_leading_zero(F.col("students_student_number"))
    )


def dated_months(tables: Sequence[MonthTable]) -> DataFrame:
    """``(combined_number, date, absent, src)`` of all month tables.

    Tables of one parent form are united before they meet the parent, so each
    parent is joined once.
    """
    by_parent: dict[int, list[MonthTable]] = {}
    for t in tables:
        by_parent.setdefault(id(t.parent), []).append(t)
    parts = []
    for group in by_parent.values():
        rows = joins.union_all([
            t.days.select(
                F.col("parent_auri").alias("uri"), F.col(t.day_column).alias("day"),
                F.lit(t.month).alias("month"), F.lit(t.year).alias("year"),
                F.lit(t.source).alias("src"),
            )
            for t in group
        ])
        parts.append(rows.join(group[0].parent.select("uri", "combined_number"), "uri", "left"))
    date = dates.named_month_date(F.col("month"), F.col("day"), F.col("year"))
    return (
        joins.union_all(parts)
        .filter(F.col("combined_number").isNotNull())
        .select("combined_number", date.alias("date"), F.lit(True).alias("absent"), "src")
    )


def student_classes(form_b2: DataFrame, form_b3: DataFrame, order: str | None = None) -> DataFrame:
    """One class per student: the third form first, then the second.

    Of a student filed twice in a form the first row counts, by the forms' column
    ``order`` if given, then by the class.

    The school number is the second part of the id in both.
    """
    b3 = form_b3.select(
        "combined_number", F.col("students_grade").try_cast("double").cast("int").alias("grade"),
        F.col("students_class").alias("class"), F.lit(0).alias("__rank"),
        (F.col(order) if order else F.lit(0)).alias("__order"),
    )
    b2 = form_b2.select(
        "combined_number", F.col("grade").try_cast("double").cast("int").alias("grade"), "class",
        F.lit(1).alias("__rank"), (F.col(order) if order else F.lit(0)).alias("__order"),
    )
    number = F.split_part("combined_number", F.lit("-"), F.lit(2)).try_cast("int")
    both = b3.unionByName(b2).withColumn("school_number", number)
    known = joins.require(both, CLASS_KEYS)
    order = [F.col(c) for c in ("__rank", "__order", *CLASS_KEYS)]
    return keep_first(known, ["combined_number"], order).select("combined_number", *CLASS_KEYS)


def class_absences(
    absences: DataFrame, classes: DataFrame, holidays: Iterable[str] = K.HOLIDAYS
) -> DataFrame:
    """Absences with the student's class, weekends and holidays removed.

    Absences without a date stay: they count in the reconciliation.
    """
    skipped = [F.to_date(F.lit(h)) for h in holidays]
    open_day = dates.is_weekday(F.col("date"))
    if skipped:
        open_day = open_day & ~F.col("date").isin(*skipped)
    kept = absences.filter(F.col("date").isNull() | open_day)
    return joins.left_join(kept, classes, ["combined_number"])


def phase_two_calendars(
    classes: DataFrame, absences: DataFrame, start: str = K.PHASE_2_START,
    end: str = K.PHASE_2_END, calendar: DataFrame | None = None,
    missing_is_unreliable: bool = True, on_unreliable: str = "drop", store: bool = False,
) -> DataFrame:
    """Students with their class's believable days and their absence dates.

    ``absences`` come from :func:`class_absences`. School days are the weekdays
    from ``start`` to ``end``, or those of a class ``calendar``. With ``store`` the
    calendars are stored for the join of both phases.
    """
    given = None
    if calendar is not None:
        given = panel.dates_per_entity(calendar, CLASS_KEYS, name="days", start=start, end=end)
    known = classes.select(*CLASS_KEYS).distinct() if given is None else given.drop("days")
    in_class = panel.marked_students(
        classes, known, CLASS_KEYS, absences, "combined_number", "phase-two"
    )
    weekdays = dates.weekday_array(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    observable = in_class.select(*CLASS_KEYS).distinct().withColumn("days", weekdays) if given is None else given
    believed = panel.believed_days(
        observable, panel.marks_weekly_rate(in_class, CLASS_KEYS, "combined_number"), CLASS_KEYS,
        missing_is_unreliable=missing_is_unreliable, on_unreliable=on_unreliable,
    )
    calendars = panel.class_calendars(in_class, believed, CLASS_KEYS)
    if not store:
        return calendars
    return panel.stored_calendars(calendars, "combined_number", "combined_number", "calendars-two")


def phase_two_attendance(classes: DataFrame, absences: DataFrame, **options) -> DataFrame:
    """Student-days of the second phase; options as in :func:`phase_two_calendars`."""
    return panel.expand_calendars(phase_two_calendars(classes, absences, **options))


def class_label_column(school: str = "school_number", grade: str = "grade", name: str = "class"):
    return keys.class_label(F.col(school), F.col(grade), F.col(name))


def monthly_class_report(attendance: DataFrame, classes: DataFrame) -> DataFrame:
    """Monthly students, classes, absences, presences and rate per class."""
    return _monthly_report(student_months(attendance, classes), "class_number")


def monthly_district_report(attendance: DataFrame, classes: DataFrame) -> DataFrame:
    """The same per district."""
    counts = student_months(attendance, classes).withColumn(
        "district", keys.district_of(F.col("combined_number"))
    )
    return _monthly_report(counts, "district")


def student_months(attendance: DataFrame, classes: DataFrame) -> DataFrame:
    """Day counts per student and month with the class label.

    Student-days are reduced to student-months before the class is joined.
    """
    monthly = attendance.withColumn("month_start", dates.month_start(F.col("date")))
    counts = rates.day_counts(monthly, ["combined_number", "month_start"])
    named = classes.select("combined_number", class_label_column().alias("class_number"))
    return joins.left_join(counts, named, ["combined_number"])


def _monthly_report(counts: DataFrame, by: str) -> DataFrame:
    # A student has one row a month, and one class and district.
    report = rates.sum_counts(
        counts, ["month_start", by],
        {"students": "combined_number", "classes": "class_number"}, "combined_number",
    )
    return report.withColumn("year_month", dates.year_month(F.col("month_start"), " ")).drop(
        "month_start"
    ).withColumnRenamed("eligibles", "student_school_days")
