"""First phase: absences by month slot, the student-day panel, and the roster."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import constants as K
from rollbook.functions import dates, geo, recode
from rollbook.operators import joins, panel
from rollbook.operators.dedupe import keep_first

SCHOOL_COLUMNS = (
    "SCHOOL_UUID", "GPS_ALT", "GPS_ACC", "DISTRICT", "TYPE_OF_LATRINE", "SCHOOL_CONDITIONS",
    "SCHOOL_NAME", "GPS_LAT", "GPS_LNG", "LUNCH", "NUMBER_OF_CLASSES",
)
MONTHS = ("FIRST_MONTH_OF_REFERENCE", "SECOND_MONTH_OF_REFERENCE", "THIRD_MONTH_OF_REFERENCE")
CLASS_COLUMNS = ("_URI", "SCHOOL_UUID", "CLASS_UUID", "CLASS_NAME", "GRADE", *MONTHS)
STUDENT_COLUMNS = (
    "_URI", "NAME", "PERMID", "SCHOOL_UUID", "CLASS_UUID", "DOB", "HOUSEHOLD_NUMBER", "GENDER",
)
CLASS_UUIDS = ["SCHOOL_UUID", "CLASS_UUID"]
CLASS_KEYS = ["DISTRICT", "SCHOOL_NAME", "GRADE", "CLASS_NAME"]
SLOT_COLUMNS = {
    1: "DAYS_OF_ABSENCE_FIRST_MONTH",
    2: "DAYS_OF_ABSENCE_SECOND_MONTH",
    3: "DAYS_OF_ABSENCE_THIRD_MONTH",
}
HOLIDAY_COLUMNS = {1: "DAYS_ONE", 2: "DAYS_TWO", 3: "DAYS_THREE"}


def pick(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The named columns a form has; the scan reads no others."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def slot_rows(
    slots: Mapping[int, DataFrame], columns: Mapping[int, str] = SLOT_COLUMNS,
    parent: str = "_PARENT_AURI",
) -> DataFrame:
    """The three month tables as one: parent key, slot 1-3, day of month."""
    tagged = {
        slot: df.select(F.col(f"`{parent}`").alias("parent"), F.col(columns[slot]).alias("day"))
        for slot, df in slots.items()
    }
    return joins.tag_union(tagged, "slot")


def slot_absences(
    slots: Mapping[int, DataFrame], students: DataFrame, classes: DataFrame,
    year: int = K.PHASE_1_YEAR,
) -> DataFrame:
    """Dated absences ``(student_id, date)``; days that do not exist are dropped.

    Reference months are put on the students first, so the absence rows are
    joined once.
    """
    months = students.select("_URI", "CLASS_UUID").join(
        classes.select("CLASS_UUID", *MONTHS), "CLASS_UUID", "left"
    ).select(F.col("_URI").alias("parent"), *MONTHS)
    dated = slot_rows(slots).join(months, "parent", "left").select(
        F.col("parent").alias("student_id"),
        dates.slot_date(F.col("slot"), F.col("day"), *[F.col(m) for m in MONTHS], year=year)
        .alias("date"),
    )
    return dated.filter(F.col("date").isNotNull())


def school_locations(schools: DataFrame, scale: bool = True) -> DataFrame:
    """School attributes with labels; coordinates scaled to degrees once, here."""
    lng, lat = F.col("GPS_LNG"), F.col("GPS_LAT")
    return schools.select(
        "SCHOOL_NAME",
        (geo.scale_degrees(lat) if scale else lat).alias("lat"),
        (geo.scale_degrees(lng) if scale else lng).alias("lng"),
        *[label.alias(name) for name, label in school_labels().items()],
    )


def school_labels() -> dict[str, Column]:
    codes = {
        "TYPE_OF_LATRINE": K.TYPE_OF_LATRINE,
        "SCHOOL_CONDITIONS": K.SCHOOL_CONDITIONS,
        "LUNCH": K.LUNCH,
    }
    return {c: recode.recode(F.col(c), labels) for c, labels in codes.items()}


def eligible_classes(
    classes: DataFrame, schools: DataFrame,
    start: str = K.PHASE_1_START, end: str = K.PHASE_1_END,
    school_order: Sequence[Column] = (),
) -> DataFrame:
    """Classes with their school and the array of observable ``days``.

    Of a school filed twice the first row counts, by ``school_order``, then by its values.
    Only weekdays in one of the class's reference months count; classes without
    any are left out.
    """
    single = keep_first(schools, ["SCHOOL_UUID"], [*school_order, *[F.col(c) for c in schools.columns]])
    placed = classes.select(
        "SCHOOL_UUID", "CLASS_UUID", "CLASS_NAME", "GRADE", *MONTHS
    ).join(single, "SCHOOL_UUID", "left")
    return placed.withColumn("days", observable_days(start, end)).filter(F.size("days") > 0)


def observable_days(start: str, end: str) -> Column:
    """Weekdays in one of the reference months of a class."""
    wanted = F.array(*[F.col(m).cast("int") for m in MONTHS])
    return F.filter(
        dates.weekday_array(F.to_date(F.lit(start)), F.to_date(F.lit(end))),
        lambda d: F.coalesce(F.array_contains(wanted, F.month(d)), F.lit(False)),
    )


def eligible_students(students: DataFrame, classes: DataFrame) -> DataFrame:
    """Students of the eligible classes, without the days."""
    named = students.withColumnRenamed("_URI", "student_id")
    return joins.left_join(
        named, classes.withColumnRenamed("days", "__days"), CLASS_UUIDS, null_safe=True
    ).filter(F.col("__days").isNotNull()).drop("__days")


def phase_one_calendars(
    students: DataFrame, classes: DataFrame, schools: DataFrame, absences: DataFrame,
    start: str = K.PHASE_1_START, end: str = K.PHASE_1_END,
    missing_is_unreliable: bool = True, on_unreliable: str = "drop", number: str | None = None,
) -> DataFrame:
    """Students with class and school attributes, their days and absence dates.

    With ``number``, the students' column by which the phases will be joined, the
    calendars are stored for that join.
    """
    observable = eligible_classes(classes, schools, start, end)
    named = students.withColumnRenamed("_URI", "student_id")
    in_class = panel.marked_students(
        named, observable.drop("days"), CLASS_UUIDS, absences, "student_id", "phase-one"
    )
    # Classes and rates are read from the stored students: no form is joined twice.
    held = in_class.select(*dict.fromkeys([*CLASS_UUIDS, *CLASS_KEYS, *MONTHS])).distinct()
    believed = panel.believed_days(
        held.withColumn("days", observable_days(start, end)).drop(*MONTHS),
        panel.marks_weekly_rate(in_class, CLASS_KEYS, "student_id"), CLASS_KEYS,
        missing_is_unreliable=missing_is_unreliable, on_unreliable=on_unreliable,
    )
    calendars = panel.class_calendars(in_class, believed, CLASS_UUIDS)
    if number is None:
        return calendars
    return panel.stored_calendars(calendars, "student_id", number, "calendars-one")


def phase_one_panel(
    students: DataFrame, classes: DataFrame, schools: DataFrame, absences: DataFrame,
    start: str = K.PHASE_1_START, end: str = K.PHASE_1_END,
    missing_is_unreliable: bool = True, on_unreliable: str = "drop",
) -> DataFrame:
    """Student-day panel of the first phase with labels and absence flag."""
    calendars = phase_one_calendars(
        students, classes, schools, absences, start, end, missing_is_unreliable, on_unreliable
    )
    # Labels are put on the students, before their days are expanded.
    return panel.expand_calendars(describe(calendars)).withColumns({
        "year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date"),
    })


def describe(rows: DataFrame) -> DataFrame:
    """Codes to labels, text to dates, coordinates to degrees."""
    return recode.fill_default(
        rows.withColumns({
            "district": recode.recode(F.col("DISTRICT"), K.DISTRICT),
            "gender": recode.recode(F.col("GENDER"), K.GENDER),
            "DOB": dates.day_month_name_date(F.col("DOB")),
            "GPS_LAT": geo.scale_degrees(F.col("GPS_LAT")),
            "GPS_LNG": geo.scale_degrees(F.col("GPS_LNG")),
            **school_labels(),
        }),
        {"SCHOOL_NAME": K.MISSING_SCHOOL_NAME},
    )


ROSTER = (
    "district", "student_id", "SCHOOL_NAME", "NAME", "gender", "GRADE", "CLASS_NAME", "DOB",
    "PERMID",
)


def roster(eligible: DataFrame, ids: DataFrame) -> DataFrame:
    """Students of the panel with the id numbers that match them in every attribute.

    A missing attribute matches a missing attribute. Of ``ids`` that repeat in the
    shared attributes the first counts, by their other columns.
    """
    students = describe(eligible).select(*ROSTER).distinct()
    shared = joins.shared_columns(students, ids)
    ids = keep_first(ids, shared, [F.col(c) for c in ids.columns if c not in shared] or [F.lit(0)])
    return joins.natural_left_join(students, ids, null_safe=True)
