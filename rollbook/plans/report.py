"""The absenteeism report: rates by school, by day and district, and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook import constants as K
from rollbook.functions import dates, keys, recode
from rollbook.operators import joins, rates, rollup
from rollbook.plans import phase_two


def yearly_school_rates(attendance: DataFrame) -> DataFrame:
    return rates.rate_by(
        attendance.withColumns({
            "year": F.year("date"), "school": keys.school_of(F.col("combined_number")),
        }),
        ["year", "school"],
    )


def daily_district_rates(attendance: DataFrame) -> DataFrame:
    """Rate and students observed per day and district name."""
    number = keys.district_of(F.col("combined_number")).try_cast("int")
    return rates.rate_by(
        attendance.withColumn("district", recode.recode(number, K.DISTRICT)), ["date", "district"]
    )


def report(
    attendance: DataFrame, first: str = K.DISTRICT[1], second: str = K.DISTRICT[2],
    days: int = K.ROLLING_DAYS, min_sample: int = K.MIN_STUDENTS,
) -> dict[str, DataFrame]:
    """The report's tables by name. The rolling ratio is taken over all dates
    before dates with few students are left out.
    """
    daily = daily_district_rates(attendance)
    pair = rates.pair_ratio(daily, "district", first, second)
    rolling = rates.rolling_ratio(pair, days=days)
    return {
        "yearly_by_school": yearly_school_rates(attendance),
        "daily_by_district": daily,
        "daily_ratio": pair,
        "rolling_ratio": rates.sample_filter(rolling, min_sample),
        "monthly_ratio": rates.weighted_monthly(pair),
    }


#: Levels of :func:`levels`: name, period, and column of the group.
LEVELS = (
    ("class and month", "month_start", "class_number"), ("district and month", "month_start", "district"),
    ("school and year", "year_start", "school"), ("district and year", "year_start", "district"),
)


def levels(attendance: DataFrame, classes: DataFrame) -> DataFrame:
    """The rates of classes, schools and districts by month and year, from one scan.

    ``classes`` has one row per ``combined_number`` with the class's columns. Distinct
    students of a year come from the bitmaps of its months.
    """
    number = F.col("combined_number")
    named = classes.select("combined_number", phase_two.class_label_column().alias("class_number"))
    # Days are reduced to student-months before they meet the classes.
    monthly = rates.day_counts(attendance.withColumn("month_start", dates.month_start(F.col("date"))), ["combined_number", "month_start"])
    placed = joins.left_join(monthly, named, ["combined_number"]).withColumns({
        "district": keys.district_of(number), "school": keys.school_of(number),
    })
    held = rollup.cells_of_counts(placed, ["month_start", "class_number", "school", "district"], "combined_number", ["district", "school", "class_number"])
    periods = {"month_start": F.col("month_start"), "year_start": F.trunc("month_start", "YEAR")}
    parts = [
        rollup.roll_up(held, {"period": periods[period], "group": F.col(group)}).withColumn("level", F.lit(name))
        for name, period, group in LEVELS
    ]
    return joins.union_all(parts)
