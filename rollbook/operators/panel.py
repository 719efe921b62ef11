"""Entity-day panels: expansion, reliability of class-weeks, phases."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import constants as K, session
from rollbook.functions import dates
from rollbook.operators import joins, rates
from rollbook.operators.corrections import correct_flags


def expand_days(
    df: DataFrame, start: str | Column, end: str | Column,
    months: Sequence[str] = (), holidays: Iterable[str] = (), date: str = "date",
) -> DataFrame:
    """One row per entity and weekday from ``start`` to ``end``.

    With ``months`` (names of reference-month columns) only days of those
    months are kept; entities without any give no rows. The days are generated
    and filtered inside each task: no Cartesian grid and no shuffle.
    """
    first = F.to_date(F.lit(start)) if isinstance(start, str) else start
    last = F.to_date(F.lit(end)) if isinstance(end, str) else end
    days = df.withColumn(date, F.explode(F.sequence(first, last)))
    if months:
        days = eligible_months(days, months, date)
    return school_days(days, holidays, date)


def eligible_months(df: DataFrame, months: Sequence[str], date: str = "date") -> DataFrame:
    """Rows whose month is one of the row's reference months; none known drops the row."""
    hit = F.lit(False)
    for m in months:
        hit = hit | F.coalesce(F.month(date) == F.col(m).cast("int"), F.lit(False))
    return df.filter(hit)


def school_days(
    df: DataFrame, holidays: DataFrame | Iterable[str] = K.HOLIDAYS, date: str = "date"
) -> DataFrame:
    """Rows on weekdays that are no holiday.

    A list of dates becomes a literal filter that reaches the scan; a table is
    anti-joined.
    """
    weekdays = df.filter(dates.is_weekday(F.col(date)))
    if isinstance(holidays, DataFrame):
        return joins.exclude_listed(weekdays, holidays, [date])
    skipped = [F.to_date(F.lit(h)) for h in holidays]
    return weekdays.filter(~F.col(date).isin(*skipped)) if skipped else weekdays


def enrolment(df: DataFrame, class_keys: Sequence[str], entity: str = "student_id") -> DataFrame:
    """Distinct students per class."""
    return df.groupBy(*class_keys).agg(
        rates.distinct_with_null(F.col(entity)).alias("n_students")
    )


def enrolment_rows(df: DataFrame, class_keys: Sequence[str]) -> DataFrame:
    """Roster rows per class."""
    return df.groupBy(*class_keys).agg(F.count(F.lit(1)).alias("n_students"))


def weekly_rate(
    absences: DataFrame, enrolled: DataFrame, class_keys: Sequence[str],
    date: str = "date", days_per_week: int = K.DAYS_PER_WEEK,
) -> DataFrame:
    """Absences per class and Sunday-week, as a percentage of student-days."""
    weekly = absences.groupBy(
        *class_keys, dates.sunday_week(F.col(date)).alias("year_week")
    ).agg(F.count(F.lit(1)).alias("absences"))
    return with_rate(weekly, enrolled, class_keys, days_per_week)


def with_rate(
    weekly: DataFrame, enrolled: DataFrame, class_keys: Sequence[str], days_per_week: int
) -> DataFrame:
    joined = joins.left_join(weekly, enrolled, class_keys, null_safe=True)
    return joined.withColumn(
        "absenteeism_rate",
        F.try_divide(F.col("absences") * 100.0, F.col("n_students") * F.lit(days_per_week)),
    )


def unreliable_weeks(weekly: DataFrame, min_rate: float = K.MIN_WEEKLY_RATE) -> DataFrame:
    """Class-weeks whose rate is too low to be believed."""
    return weekly.filter(F.col("absenteeism_rate") < min_rate)


def mark_unreliable(
    panel: DataFrame, weekly: DataFrame, class_keys: Sequence[str], date: str = "date",
    min_rate: float = K.MIN_WEEKLY_RATE, missing_is_unreliable: bool = True,
    on_unreliable: str = "drop",
) -> DataFrame:
    """Drop (or flag as ``remove``) the panel rows of unreliable class-weeks.

    With ``missing_is_unreliable`` a class-week without any absence counts as
    unreliable too.
    """
    if on_unreliable not in ("drop", "flag"):
        raise ValueError("on_unreliable must be 'drop' or 'flag'")
    rated = weekly.select(*class_keys, "year_week", F.col("absenteeism_rate").alias("__rate"))
    keyed = panel.withColumn("year_week", dates.sunday_week(F.col(date)))
    joined = joins.left_join(keyed, rated, [*class_keys, "year_week"], null_safe=True)
    low = F.coalesce(F.col("__rate") < min_rate, F.lit(missing_is_unreliable))
    if on_unreliable == "flag":
        return joined.withColumn("remove", low).drop("__rate")
    return joined.filter(~low).drop("__rate", "year_week")


def seen_in_all(
    attendance: DataFrame, entity: str, phase: str = "phase", phases: Sequence[int] = (1, 2)
) -> DataFrame:
    """Entities observed in every listed phase, as column ``__entity``."""
    seen = attendance.groupBy(F.col(entity).alias("__entity")).agg(
        *[F.max(F.col(phase) == p).alias(f"__p{p}") for p in phases]
    )
    for p in phases:
        seen = seen.filter(F.col(f"__p{p}"))
    return seen.select("__entity")


def keep_entities(rows: DataFrame, seen: DataFrame, entity: str) -> DataFrame:
    """Rows of the entities in ``seen``; a NULL entity matches a NULL entity."""
    return rows.join(seen, F.col(entity).eqNullSafe(F.col("__entity")), "left_semi")


def both_phases(
    attendance: DataFrame, entity: str = "combined_number", phase: str = "phase",
    phases: Sequence[int] = (1, 2),
) -> DataFrame:
    """Rows of entities observed in every listed phase (a NULL entity is one entity).

    One partially aggregated flag per phase and a semi-join: unlike a window
    over the entity, a hot entity is never gathered into one task.
    """
    return keep_entities(attendance, seen_in_all(attendance, entity, phase, phases), entity)


def drop_break(df: DataFrame, date: str = "date",
               months: Iterable[int] = K.BREAK_MONTHS) -> DataFrame:
    """Rows outside the school break."""
    return df.filter(~dates.in_break(F.col(date), months))


def two_phase(
    first: DataFrame, second: DataFrame, entity: str = "combined_number"
) -> DataFrame:
    """Both phases in one table: students seen in both, no break days, no repeats.

    The phases are looked up in the raw rows, so a student known only from break
    days still counts. Repeats are removed before the semi-join: a shuffle on
    all columns spreads even one hot entity evenly.
    """
    columns = [entity, "date", "absent"]
    rows = joins.tag_union({1: first.select(*columns), 2: second.select(*columns)}, "phase")
    kept = drop_break(rows).distinct()
    return keep_entities(kept, seen_in_all(rows, entity), entity)


def reconcile(
    absences: DataFrame, panel: DataFrame, entity: str = "combined_number",
    flag: str = "absent", date: str = "date",
) -> DataFrame:
    """Entities with more reported absences than absences on lective days.

    Repeated absence rows count on both sides: a lective day counts once for each
    absence row of its date.
    """
    reported = absences.groupBy(entity, date).agg(F.count(F.lit(1)).alias("__n"))
    lective = panel.filter(F.col(flag)).groupBy(entity, date).agg(F.count(F.lit(1)).alias("__days"))
    known = panel.select(entity).distinct()
    met = reported.join(lective, [entity, date], "left").groupBy(entity).agg(
        F.sum("__n").alias("reported"),
        F.coalesce(F.sum(F.col("__n") * F.col("__days")), F.lit(0)).alias("on_lective_days"),
    )
    return met.join(known, entity, "left_semi").filter("reported > on_lective_days")


def dates_per_entity(
    events: DataFrame, keys: Sequence[str], date: str = "date", name: str = "event_dates",
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """The distinct event dates of each entity as an array.

    ``start`` and ``end`` bound the array by the days of the panel; repeats are
    merged map-side, so a hot entity is no larger than the calendar.
    """
    if start and end:
        events = events.filter(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return events.groupBy(*keys).agg(F.collect_set(date).alias(name))


def believed_days(
    classes: DataFrame, weekly: DataFrame, class_keys: Sequence[str], days: str = "days",
    min_rate: float = K.MIN_WEEKLY_RATE, missing_is_unreliable: bool = True,
    on_unreliable: str = "drop",
) -> DataFrame:
    """Reduce each class's array of days to those of believable weeks.

    ``classes`` has one row per class and an array of dates. The result's array
    holds structs with ``date`` and, when flagging, ``remove``. An array is never
    longer than the calendar.
    """
    rows = classes.withColumn("date", F.explode(days)).drop(days)
    marked = mark_unreliable(
        rows, weekly, class_keys, "date", min_rate, missing_is_unreliable, on_unreliable
    )
    fields = ["date", "remove"] if on_unreliable == "flag" else ["date"]
    by = [c for c in classes.columns if c != days]
    return marked.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias(days))


def absence_marks(absences: DataFrame, entity: str, date: str = "date") -> DataFrame:
    """Each student's absences as one array ``marks`` of dates with their number.

    Repeated rows are counted per date first, so the array is no longer than the
    calendar, whatever number of rows a student has. A missing date is one entry.
    """
    counted = absences.groupBy(entity, F.col(date).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(entity).agg(F.collect_list(F.struct("date", "n")).alias("marks"))


def marked_students(
    students: DataFrame, classes: DataFrame, on: Sequence[str], absences: DataFrame,
    entity: str, label: str,
) -> DataFrame:
    """Students with their class's attributes and their absence ``marks``, as a stored table.

    Only students of the given classes are kept. Weekly rates and the panel are
    both made from this table of one row per student.
    """
    known = classes.withColumn("__known", F.lit(True))
    placed = joins.left_join(students, known, on, null_safe=True).filter("__known").drop("__known")
    return session.materialize(
        joins.left_join(placed, absence_marks(absences, entity), [entity]), label
    )


def stored_calendars(calendars: DataFrame, entity: str, number: str, label: str) -> DataFrame:
    """Student calendars stored in buckets of ``store_key``, where phases meet.

    The key is the student's ``number``; students without one have a key of their own
    ``entity``, so they spread like others.
    """
    key = F.coalesce(F.col(number), F.concat_ws("", F.lit("\0"), F.col(entity)))
    return session.bucketed(calendars.withColumn("store_key", key), label, "store_key")


def marks_weekly_rate(
    students: DataFrame, class_keys: Sequence[str], entity: str,
    days_per_week: int = K.DAYS_PER_WEEK,
) -> DataFrame:
    """Weekly rates per class from students with ``marks``."""
    days = students.select(*class_keys, F.explode("marks").alias("m"))
    weekly = days.groupBy(*class_keys, dates.sunday_week(F.col("m.date")).alias("year_week")).agg(
        F.sum("m.n").alias("absences")
    )
    return with_rate(weekly, enrolment(students, class_keys, entity), class_keys, days_per_week)


def class_calendars(
    students: DataFrame, class_days: DataFrame, on: Sequence[str]
) -> DataFrame:
    """Students with the array ``days`` of their class; :func:`expand_calendars`
    makes the panel, the largest table of the study, out of them without a shuffle.
    """
    joined = joins.left_join(students, class_days.select(*on, "days"), on, null_safe=True)
    return joined.filter(F.size("days") > 0)


def reconcile_calendars(calendars: DataFrame, entity: str) -> DataFrame:
    """Students with more reported absences than absences on lective days.

    Counted inside each student's row; the panel is not expanded. Repeated absence
    rows count on both sides.
    """
    def total(marks: Column) -> Column:
        return F.aggregate(marks, F.lit(0).cast("bigint"), lambda n, mark: n + mark["n"])

    reported = total(F.col("marks"))
    lective = total(F.filter("marks", lambda m: F.coalesce(F.array_contains("days.date", m["date"]), F.lit(False))))
    counted = calendars.filter(F.col("marks").isNotNull()).select(
        entity, reported.alias("reported"), lective.alias("on_lective_days")
    )
    return counted.filter("reported > on_lective_days")


def expand_calendars(
    calendars: DataFrame, flag: str = "absent", fixes: str | None = None
) -> DataFrame:
    """Student-days with an absence flag from student calendars.

    ``fixes`` names a map from month number to corrected absence days; such a
    month is reset to present and its listed days set absent.
    """
    rows = calendars.withColumn("__day", F.explode("days"))
    rows = rows.select(*[c for c in calendars.columns if c != "days"], "__day.*")
    absent = F.coalesce(F.array_contains("marks.date", F.col("date")), F.lit(False))
    if fixes:
        listed = F.when(F.col(fixes).isNotNull(), F.col(fixes)[F.month("date")])
        absent = F.when(
            listed.isNotNull(), F.array_contains(listed, F.dayofmonth("date"))
        ).otherwise(absent)
    return rows.withColumn(flag, absent).drop("marks", "store_key", *([fixes] if fixes else []))


def two_phase_calendars(
    first: DataFrame, second: DataFrame, entity: str = "combined_number",
    null_is_entity: bool = True,
) -> DataFrame:
    """Student calendars of both phases, for students seen in both.

    ``repeated`` marks students who share an id with another row of their phase;
    only their days can repeat. Calendars stored in buckets (:func:`stored_calendars`) are
    counted and joined where they lie. With ``null_is_entity`` rows without an id are one
    entity, looked up apart so that they are no join key; else they are left out.
    """
    stored = "store_key" in first.columns and "store_key" in second.columns
    key = "store_key" if stored else entity
    phases = [c.select(*dict.fromkeys([key, entity]), "days", "marks", F.lit(p).alias("phase")) for p, c in ((1, first), (2, second))]
    if not stored:  # stored calendars all have days; keys are then counted without reading any
        phases = [p.filter(F.size("days") > 0) for p in phases]
    named = [p.filter(F.col(entity).isNotNull()) for p in phases]
    one, two = (p.groupBy(key).agg(F.count(F.lit(1)).alias(f"__n{k}")) for k, p in enumerate(named, 1))
    seen = one.join(two, key)
    columns = [entity, "days", "marks", "phase", "repeated"]
    parts = [
        p.join(seen.select(key, (F.col(f"__n{k}") > 1).alias("repeated")), key).select(*columns)
        for k, p in enumerate(named, 1)
    ]
    if null_is_entity:
        nameless = [p.filter(F.col(entity).isNull()) for p in phases]
        counts = [p.agg(F.count(F.lit(1))).scalar() for p in nameless]
        parts += [
            p.filter(counts[1 - k] > 0).withColumn("repeated", counts[k] > 1).select(*columns)
            for k, p in enumerate(nameless)
        ]
    return joins.union_all(parts)


def attendance_rows(
    calendars: DataFrame, corrections: DataFrame | None = None, entity: str = "combined_number",
    phase: int | None = 1,
) -> DataFrame:
    """Distinct student-days outside the break, corrected.

    A student with a single row in a phase has distinct days by construction,
    so those rows are corrected and expanded without a shuffle; only the days of
    repeated ids are compared. ``corrections`` come from
    :func:`rollbook.operators.corrections.correction_days`.
    """
    columns = [entity, "date", "absent", "phase"]
    single = calendars.filter(~F.col("repeated"))
    fixes = None
    if corrections is not None:
        fixes = "__fixes"
        by_entity = correction_maps(corrections, entity, fixes)
        if phase is None:
            single = single.join(by_entity, entity, "left")
        else:
            tagged = by_entity.withColumn("phase", F.lit(phase))
            single = single.join(tagged, [entity, "phase"], "left")
    expanded = drop_break(expand_calendars(single, fixes=fixes)).select(*columns)
    compared = drop_break(
        expand_calendars(calendars.filter(F.col("repeated")))
    ).select(*columns).distinct()
    if corrections is not None:
        compared = correct_flags(compared, corrections, entity, phase=phase)
    return expanded.unionByName(compared)


def correction_maps(corrections: DataFrame, entity: str, name: str) -> DataFrame:
    """Corrected days as one map per entity, at most one entry per month."""
    entries = F.collect_list(F.struct("month", "days"))
    return corrections.groupBy(entity).agg(F.map_from_entries(entries).alias(name))
