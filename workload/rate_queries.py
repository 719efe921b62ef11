"""Rates by day, month, year, class, school and district; ratios of two districts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.operators import rates
from rollbook.plans import phase_two, report
from workload.base import Tables, day, query, rounded
from workload.views import EVENT_DAYS, SHIPMENTS, STUDENTS, event_days, shipments, students

RATE_SQL = """count(*) FILTER (WHERE absent) AS absences,
       count(*) FILTER (WHERE NOT absent) AS presences, count(*) AS eligibles,
       round(count(*) FILTER (WHERE absent) * 100e0 / count(*), 6) AS absenteeism_rate"""


def daily(t: Tables) -> DataFrame:
    return rates.rate_by(shipments(t), ["date", "district"])


@query("daily_rate_by_region", f"""WITH {SHIPMENTS}
SELECT date, district, {RATE_SQL} FROM shipments GROUP BY date, district""")
def daily_rate_by_region(t: Tables) -> DataFrame:
    """Daily rate per district with its denominator."""
    return rounded(daily(t), "absenteeism_rate")


@query("yearly_rate_by_nation", f"""WITH {SHIPMENTS}
SELECT CAST(year(date) AS INTEGER) AS year, school_name, {RATE_SQL}
FROM shipments GROUP BY 1, 2""")
def yearly_rate_by_nation(t: Tables) -> DataFrame:
    """Yearly rate per school."""
    yearly = shipments(t).withColumn("year", F.year("date"))
    return rounded(rates.rate_by(yearly, ["year", "school_name"]), "absenteeism_rate")


def _attendance(t: Tables) -> DataFrame:
    """Student-days under the combined id."""
    lines = t("lineitem").select(
        "l_orderkey", day("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") != 7, F.col("l_returnflag") == "R").alias("absent"),
    )
    owners = t("orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("student_id")
    )
    ids = students(t).select("student_id", "combined_number")
    return lines.join(owners, "l_orderkey").join(ids, "student_id").drop("l_orderkey", "student_id")


def _classes(t: Tables) -> DataFrame:
    return students(t).select(
        "combined_number", "school_number", "grade", F.col("class_name").alias("class")
    )


REPORT_SQL = """count(DISTINCT combined_number) AS students,
       count(DISTINCT class_number) AS classes,
       count(*) FILTER (WHERE absent) AS absences,
       count(*) FILTER (WHERE NOT absent) AS presences, count(*) AS student_school_days,
       round(count(*) FILTER (WHERE absent) * 100e0 / count(*), 6) AS absenteeism_rate"""
LABELLED = SHIPMENTS + """,
labelled AS (
  SELECT *, strftime(date, '%Y %m') AS year_month,
         'school:' || school_number || '-grade:' || grade || '-class:' || class_name AS class_number
  FROM shipments)"""


@query("monthly_rate_by_class", f"""WITH {LABELLED}
SELECT year_month, class_number, {REPORT_SQL} FROM labelled GROUP BY 1, 2""")
def monthly_rate_by_class(t: Tables) -> DataFrame:
    """Monthly report per class."""
    return rounded(phase_two.monthly_class_report(_attendance(t), _classes(t)), "absenteeism_rate")


@query("monthly_rate_by_region", f"""WITH {LABELLED}
SELECT year_month, left(combined_number, 2) AS district, {REPORT_SQL} FROM labelled GROUP BY 1, 2""")
def monthly_rate_by_region(t: Tables) -> DataFrame:
    """Monthly report per district."""
    return rounded(phase_two.monthly_district_report(_attendance(t), _classes(t)), "absenteeism_rate")


MONTH_SQL, YEAR_SQL = (f"CAST(date_trunc('{p}', date) AS DATE)" for p in ("month", "year"))
GROUP_SQL = {"class_number": "class_number", "district": "left(combined_number, 2)", "school": "substr(combined_number, 4, 2)"}


@query("report_levels", f"WITH {LABELLED} " + " UNION ALL ".join(
    f"""SELECT '{name}' AS level, {MONTH_SQL if period == 'month_start' else YEAR_SQL} AS period, {GROUP_SQL[group]} AS "group",
       count(DISTINCT combined_number) AS students, {RATE_SQL} FROM labelled GROUP BY 2, 3""" for name, period, group in report.LEVELS))
def report_levels(t: Tables) -> DataFrame:
    """Rates and distinct students of classes, schools and districts by month and year."""
    return rounded(report.levels(_attendance(t), _classes(t)), "absenteeism_rate")


MONTHLY_FACT_SQL = """facts AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS year_month, l_suppkey,
         CASE WHEN l_linenumber <> 7 THEN l_returnflag = 'R' END AS absent FROM lineitem)"""


def _monthly_facts(t: Tables) -> DataFrame:
    return t("lineitem").select(
        F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("year_month"), "l_suppkey",
        F.when(F.col("l_linenumber") != 7, F.col("l_returnflag") == "R").alias("absent"),
    )


@query("monthly_rate", f"""WITH {MONTHLY_FACT_SQL}
SELECT year_month, round(count(*) FILTER (WHERE absent) * 1e0 / count(*), 6) AS rate
FROM facts GROUP BY 1""")
def monthly_rate(t: Tables) -> DataFrame:
    """Overall monthly rate; unknown flags stay in the denominator."""
    return rounded(
        _monthly_facts(t).groupBy("year_month").agg(rates.overall_rate().alias("rate")), "rate"
    )


@query("monthly_rate_by_school", f"""WITH {MONTHLY_FACT_SQL}
SELECT year_month, s_nationkey AS school_number,
       round(count(*) FILTER (WHERE absent) * 1e0 / count(*), 6) AS rate
FROM facts JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def monthly_rate_by_school(t: Tables) -> DataFrame:
    """Monthly rate per school, the school found through a dimension."""
    schools = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("school_number"))
    joined = _monthly_facts(t).join(schools, F.col("l_suppkey") == F.col("s_suppkey"))
    grouped = joined.groupBy("year_month", "school_number").agg(rates.overall_rate().alias("rate"))
    return rounded(grouped, "rate")


FIRST, SECOND = "AFRICA", "AMERICA"
PAIR = """daily AS (
  SELECT date, district, count(*) FILTER (WHERE absent) * 100e0 / count(*) AS rate,
         count(*) AS n
  FROM {facts} GROUP BY 1, 2),
pair AS (
  SELECT date, a.rate AS first_rate, a.n AS first_students, b.rate AS second_rate,
         b.n AS second_students, b.rate / nullif(a.rate, 0) * 100 AS ratio,
         a.n + b.n AS total_students, (a.n + b.n) / 2e0 AS avg_students
  FROM (SELECT * FROM daily WHERE district = 'AFRICA') a
  FULL JOIN (SELECT * FROM daily WHERE district = 'AMERICA') b USING (date))"""
SHIPMENT_PAIR = SHIPMENTS + ",\n" + PAIR.format(facts="shipments")
PAIR_SQL = """date, round(first_rate, 6) AS first_rate, first_students,
       round(second_rate, 6) AS second_rate, second_students, round(ratio, 6) AS ratio,
       total_students, avg_students"""
ROLLING = """rolling AS (
  SELECT *, avg(second_rate) OVER w / nullif(avg(first_rate) OVER w, 0) * 100 AS rolling_mean
  FROM pair WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))"""


def _pair(daily_rates: DataFrame) -> DataFrame:
    return rates.pair_ratio(daily_rates, "district", FIRST, SECOND)


@query("region_ratio_daily", f"WITH {SHIPMENT_PAIR} SELECT {PAIR_SQL} FROM pair")
def region_ratio_daily(t: Tables) -> DataFrame:
    """Two districts' daily rates side by side with their ratio."""
    return rounded(_pair(daily(t)), "first_rate", "second_rate", "ratio")


@query("rolling_ratio_30d", f"""WITH {SHIPMENT_PAIR}, {ROLLING}
SELECT {PAIR_SQL}, round(rolling_mean, 6) AS rolling_mean FROM rolling""")
def rolling_ratio_30d(t: Tables) -> DataFrame:
    """Ratio of the two districts' mean rates over the last 30 days."""
    rolled = rates.rolling_ratio(_pair(daily(t)))
    return rounded(rolled, "first_rate", "second_rate", "ratio", "rolling_mean")


def _event_districts(t: Tables) -> DataFrame:
    people = students(t).select(F.col("student_id").alias("user_id"), "district")
    return event_days(t).join(people, "user_id")


EVENT_PAIR = EVENT_DAYS + ",\n" + STUDENTS + """,
placed AS (SELECT event_days.*, district FROM event_days JOIN students ON user_id = student_id),
""" + PAIR.format(facts="placed")


@query("rolling_ratio_sampled", f"""WITH {EVENT_PAIR}, {ROLLING}
SELECT {PAIR_SQL}, round(rolling_mean, 6) AS rolling_mean FROM rolling
WHERE avg_students IS NOT NULL AND first_students >= 10 AND second_students >= 10
  AND rolling_mean BETWEEN 20 AND 400""")
def rolling_ratio_sampled(t: Tables) -> DataFrame:
    """The rolling ratio on dates with enough students and a plausible value."""
    pair = _pair(rates.rate_by(_event_districts(t), ["date", "district"]))
    kept = rates.sample_filter(rates.rolling_ratio(pair))
    return rounded(kept, "first_rate", "second_rate", "ratio", "rolling_mean")


@query("weighted_monthly_ratio", f"""WITH {SHIPMENT_PAIR}
SELECT year_month, round(f, 6) AS first_rate, round(s, 6) AS second_rate,
       round(s / nullif(f, 0) * 100, 6) AS ratio
FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS year_month,
             sum(first_rate * first_students) /
               nullif(sum(first_students) FILTER (WHERE first_rate IS NOT NULL), 0) AS f,
             sum(second_rate * second_students) /
               nullif(sum(second_students) FILTER (WHERE second_rate IS NOT NULL), 0) AS s
      FROM pair GROUP BY 1)""")
def weighted_monthly_ratio(t: Tables) -> DataFrame:
    """Monthly means weighted by students, and their ratio."""
    return rounded(
        rates.weighted_monthly(_pair(daily(t))), "first_rate", "second_rate", "ratio"
    )


@query("outer_join_series", f"""WITH {SHIPMENTS},
daily AS (SELECT date, district, count(*) AS n FROM shipments GROUP BY 1, 2)
SELECT date, a.n AS first_students, b.n AS second_students
FROM (SELECT * FROM daily WHERE district = 'AFRICA') a
FULL JOIN (SELECT * FROM daily WHERE district = 'AMERICA') b USING (date)""")
def outer_join_series(t: Tables) -> DataFrame:
    """Full outer join of two daily series by date."""
    counts = daily(t).select("date", "district", "eligibles")
    first, second = (
        counts.filter(F.col("district") == d).select("date", F.col("eligibles").alias(n))
        for d, n in ((FIRST, "first_students"), (SECOND, "second_students"))
    )
    return rates.outer_pair(first, second, ["date"])
