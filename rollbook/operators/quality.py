"""Data-quality checks and field-work reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import constants as K
from rollbook.functions import dates
from rollbook.operators import joins, rates
from rollbook.operators.dedupe import keep_first

FOUND, NOT_FOUND = "1", "2"


def _count(status: str, column: str = "student_found") -> Column:
    return F.count_if(F.col(column) == status)


def found_counts(
    students: DataFrame, school: str = "school_number", name: str = "SCHOOL_NAME",
    entity: str = "combined_number",
) -> DataFrame:
    """Students found and not found per school.

    Counted per student first, so one large school is summed map-side.
    """
    per_student = students.groupBy(school, entity).agg(
        F.min(name).alias("__name"), _count(FOUND).alias("found"),
        _count(NOT_FOUND).alias("not_found"),
    )
    return per_student.groupBy(school).agg(
        F.min("__name").alias("school_name"),
        rates.distinct_with_null(F.col(entity)).alias("n"),
        F.sum("found").alias("found"), F.sum("not_found").alias("not_found"),
    )


def collected_so_far(found: DataFrame, more_than: int = K.COLLECTED_ABOVE) -> DataFrame:
    """Schools with enough students found or not found."""
    return found.filter(F.col("found") + F.col("not_found") > more_than)


def visited(
    students: DataFrame, more_than: int = K.VISITED_ABOVE, school: str = "school_number"
) -> DataFrame:
    """Rows of schools with more than ``more_than`` found students.

    The counts are aggregated first and joined back: a window over the school
    would gather a large school in one task.
    """
    schools = (
        students.groupBy(F.col(school).alias("__school"))
        .agg(_count(FOUND).alias("__found"))
        .filter(F.col("__found") > more_than)
        .select("__school")
    )
    return students.join(schools, F.col(school).eqNullSafe(F.col("__school")), "left_semi")


def visited_missing(
    students: DataFrame, more_than: int = K.VISITED_ABOVE, school: str = "school_number"
) -> DataFrame:
    """Students not found in the schools that have been visited."""
    return visited(students, more_than, school).filter(F.col("student_found") == NOT_FOUND)


def interviewer_report(form: DataFrame, interviewer: str = "cod_inq") -> DataFrame:
    """Students found and not found per interviewer."""
    return form.groupBy(interviewer).agg(
        F.count(F.lit(1)).alias("n"), _count(FOUND).alias("found"),
        _count(NOT_FOUND).alias("not_found"),
    ).withColumns({
        "ratio_found_not_found": F.try_divide(F.col("found"), F.col("not_found")),
        "p_found": F.try_divide(F.col("found") * 100.0, F.col("n")),
    })


def absence_counts(
    students: DataFrame, absences: DataFrame, months: Mapping[str, int],
    entity: str = "combined_number", flag: str = "absent", date: str = "date",
) -> DataFrame:
    """Total and per-month absences on each student row, zero where none.

    ``months`` maps output columns to month numbers.
    """
    absent = F.col(flag)
    counts = absences.groupBy(entity).agg(
        F.count_if(absent).alias("absences"),
        *[F.count_if(absent & (F.month(date) == m)).alias(n) for n, m in months.items()],
    )
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("absences", *months)}
    return joins.left_join(students, counts, [entity]).withColumns(zeros)


def many_absences(counts: DataFrame, at_least: int = K.MANY_ABSENCES) -> DataFrame:
    return counts.filter(F.col("absences") >= at_least)


def monthly_absences(
    panel: DataFrame, entity: str, flag: str = "absent", date: str = "date"
) -> DataFrame:
    """Absences of every student in every month of the panel."""
    return panel.groupBy(F.month(date).alias("month"), entity).agg(
        F.count_if(F.col(flag)).alias("absences")
    )


def zero_absence_months(
    panel: DataFrame, entity: str, flag: str = "absent", date: str = "date"
) -> DataFrame:
    """Student-months without any absence."""
    return monthly_absences(panel, entity, flag, date).filter("absences = 0")


def month_extremes(
    panel: DataFrame, entity: str, flag: str = "absent", date: str = "date",
    more_than: int = K.MANY_ABSENCES,
) -> DataFrame:
    """Per month, how many students were never absent and how many very often."""
    return monthly_absences(panel, entity, flag, date).groupBy("month").agg(
        F.count(F.lit(1)).alias("students"),
        F.count_if(F.col("absences") == 0).alias("never_absent"),
        F.count_if(F.col("absences") > more_than).alias("often_absent"),
    )


def days_off_per_school(
    days_off: DataFrame, school: str = "school", name: str = "school_name", date: str = "date",
    expected: tuple[int, int] = K.DAYS_OFF_RANGE,
) -> DataFrame:
    """Weekday days off per school, most first, and whether the number is plausible."""
    weekdays = days_off.filter(F.col(school).isNotNull() & dates.is_weekday(F.col(date)))
    return weekdays.groupBy(school).agg(
        F.min(name).alias("school_name"), F.count(F.lit(1)).alias("n")
    ).withColumn("in_range", F.col("n").between(*expected)).orderBy(F.desc("n"), school)


def days_off_per_month(
    days_off: DataFrame, name: str = "school_name", date: str = "date"
) -> DataFrame:
    return days_off.groupBy(
        name, F.year(date).alias("year"), F.month(date).alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))


def unique_check(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def count_check(df: DataFrame, column: str, expected: int = K.EXPECTED_SCHOOLS) -> DataFrame:
    """Number of distinct values against an expected number."""
    return df.agg(F.count_distinct(column).alias("found")).select(
        "found", F.lit(expected).cast("bigint").alias("expected"),
        (F.col("found") == expected).alias("as_expected"),
    )


def range_check(
    df: DataFrame, columns: Sequence[str], bounds: tuple = K.REFERENCE_MONTHS
) -> DataFrame:
    """Rows in which a named column lies outside the bounds; NULL is not outside."""
    outside = F.lit(False)
    for c in columns:
        outside = outside | F.coalesce(~F.col(c).between(*bounds), F.lit(False))
    return df.filter(outside)


def age_check(
    people: DataFrame, on: Column, born: str = "dob", bounds: tuple[int, int] = K.TEACHER_AGES
) -> DataFrame:
    """People younger or older than the bounds on a given day, with their age."""
    aged = people.withColumn("age", dates.age_years(F.col(born), on))
    return aged.filter((F.col("age") < bounds[0]) | (F.col("age") > bounds[1]))


def missing_share(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows without a value: number and percentage."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(column).isNull()).alias("missing")
    ).withColumn("p_missing", F.try_divide(F.col("missing") * 100.0, F.col("n")))


def completeness(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Complete and missing answers of a long table per group, with percentages."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.col(value)).alias("complete")
    ).withColumns({
        "missing": F.col("n") - F.col("complete"),
        "p_complete": F.try_divide(F.col("complete") * 100.0, F.col("n")),
    })


def complete_groups(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of groups in which every named column is always answered.

    An incomplete month thus gives no rows at all.
    """
    gaps = df.filter(" OR ".join(f"`{c}` IS NULL" for c in columns)).select(
        *[F.col(k).alias(f"__{k}") for k in by]
    )
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(gaps.distinct(), same, "left_anti")


def members_per_group(df: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """Distinct members (teachers, say) per group."""
    return df.groupBy(*by).agg(F.count_distinct(member).alias("n_members"))


def date_histogram(people: DataFrame, bins: int = 100, date: str = "dob") -> DataFrame:
    """Counts of dates in equal-width bins over the observed range.

    The range is a one-row scalar subquery, not a join; the last bin is closed.
    """
    day = F.unix_date(F.col(date)).cast("double")
    known = people.filter(F.col(date).isNotNull())
    low = known.select(F.min(day)).scalar()
    high = known.select(F.max(day)).scalar()
    position = F.try_divide((day - low) * bins, high - low)
    number = F.least(F.coalesce(F.floor(position), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return known.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last")
    )


def teacher_absence_rate(
    days: DataFrame, start: str, end: str, skip_months: Sequence[int] = (5, 6),
    flag: str = "absent", date: str = "date",
) -> DataFrame:
    """Monthly rate of missed days among open days within a span of dates."""
    span = days.filter(
        F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        & ~F.month(date).isin(*skip_months)
    )
    monthly = span.withColumn("year_month", dates.year_month(F.col(date)))
    return rates.rate_by(monthly, ["year_month"], flag)


def school_dimension(
    students: DataFrame, locations: DataFrame, order: Sequence[Column],
    drop_name: str | None = K.DUPLICATE_SCHOOL_NAME,
) -> DataFrame:
    """One row per school: distinct students and the school's attributes."""
    by = ["SCHOOL_NAME", "district_number", "school_number"]
    counted = students.groupBy(*by).agg(
        rates.distinct_with_null(F.col("combined_number")).alias("n_students")
    )
    joined = joins.left_join(counted, locations, ["SCHOOL_NAME"])
    single = keep_first(joined, ["SCHOOL_NAME"], order)
    return joins.without_value(single, "SCHOOL_NAME", drop_name) if drop_name else single

