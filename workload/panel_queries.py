"""Panels, reliability of weeks, phases, and the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.functions import dates
from rollbook.operators import dedupe, joins, panel
from rollbook.plans import phase_one
from workload import views
from workload.base import Tables, query, rounded
from workload.views import EVENT_DAYS, ORDER_DAYS, STUDENTS, event_days, order_days, students

USER_PANEL = EVENT_DAYS + """,
days AS (
  SELECT CAST(d AS DATE) AS date
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 6),
user_panel AS (
  SELECT u.user_id, d.date, e.user_id IS NOT NULL AS absent
  FROM (SELECT DISTINCT user_id FROM event_days) u CROSS JOIN days d
  LEFT JOIN (SELECT DISTINCT user_id, date FROM event_days WHERE absent) e
    ON e.user_id = u.user_id AND e.date = d.date)"""


def user_panel(t: Tables) -> DataFrame:
    users = event_days(t).select("user_id").distinct()
    grid = panel.expand_days(users, "2024-01-01", "2024-01-30")
    return joins.flag_join(grid, event_days(t).filter("absent"), ["user_id", "date"])


@query("user_day_panel", f"WITH {USER_PANEL} SELECT * FROM user_panel")
def user_day_panel(t: Tables) -> DataFrame:
    """Every user on every weekday of the month, flagged from sparse events."""
    return user_panel(t)


CLASS_KEYS = ["district", "class_name"]


@query("class_enrolment", f"""WITH {STUDENTS}
SELECT school_number, grade, class_name, count(DISTINCT combined_number) AS n_students
FROM students GROUP BY ALL""")
def class_enrolment(t: Tables) -> DataFrame:
    """Distinct students per class."""
    return panel.enrolment(students(t), ["school_number", "grade", "class_name"], "combined_number")


@query("class_enrolment_rows", f"""WITH {STUDENTS}
SELECT district, school_number, grade, class_name, count(*) AS n_students
FROM students GROUP BY ALL""")
def class_enrolment_rows(t: Tables) -> DataFrame:
    """Roster rows per class."""
    return panel.enrolment_rows(
        students(t), ["district", "school_number", "grade", "class_name"]
    )


WEEKLY = ORDER_DAYS + ",\n" + STUDENTS + """,
enrolled AS (
  SELECT district, class_name, count(DISTINCT student_id) AS n_students FROM students GROUP BY ALL),
weekly AS (
  SELECT district, class_name, strftime(date, '%Y-%U') AS year_week, count(*) AS absences
  FROM order_days JOIN students USING (student_id) GROUP BY ALL),
rated AS (
  SELECT weekly.*, n_students, absences * 100e0 / (n_students * 5) AS absenteeism_rate
  FROM weekly JOIN enrolled USING (district, class_name))"""


def weekly_rates(t: Tables) -> DataFrame:
    roster = students(t)
    in_class = order_days(t).join(roster.select("student_id", *CLASS_KEYS), "student_id")
    return panel.weekly_rate(in_class, panel.enrolment(roster, CLASS_KEYS), CLASS_KEYS)


RATED_SQL = """district, class_name, year_week, absences, n_students,
       round(absenteeism_rate, 6) AS absenteeism_rate FROM rated"""


@query("weekly_rate", f"WITH {WEEKLY} SELECT {RATED_SQL}")
def weekly_rate(t: Tables) -> DataFrame:
    """Absences per class and Sunday-week as a rate."""
    return rounded(weekly_rates(t), "absenteeism_rate")


@query("unreliable_weeks", f"WITH {WEEKLY} SELECT {RATED_SQL} WHERE absenteeism_rate < 1")
def unreliable_weeks(t: Tables) -> DataFrame:
    """Class-weeks with a rate below one percent."""
    return rounded(panel.unreliable_weeks(weekly_rates(t)), "absenteeism_rate")


FACT_WEEKS = WEEKLY + """,
facts AS (
  SELECT o_orderkey, student_id, date, district, class_name, strftime(date, '%Y-%U') AS year_week
  FROM order_days JOIN students USING (student_id) WHERE isodow(date) < 6)"""


def _weekday_facts(t: Tables) -> DataFrame:
    facts = order_days(t).select("o_orderkey", "student_id", "date")
    joined = facts.join(students(t).select("student_id", *CLASS_KEYS), "student_id")
    return joined.filter(dates.is_weekday(F.col("date")))


@query("reliable_rows", f"""WITH {FACT_WEEKS}
SELECT o_orderkey, student_id, date, district, class_name
FROM facts JOIN rated USING (district, class_name, year_week) WHERE absenteeism_rate >= 1""")
def reliable_rows(t: Tables) -> DataFrame:
    """Dated rows without those of unreliable class-weeks."""
    return panel.mark_unreliable(_weekday_facts(t), weekly_rates(t), CLASS_KEYS)


@query("flagged_rows", f"""WITH {FACT_WEEKS}
SELECT o_orderkey, student_id, date, district, class_name, year_week,
       coalesce(absenteeism_rate < 1, false) AS remove
FROM facts LEFT JOIN rated USING (district, class_name, year_week)""")
def flagged_rows(t: Tables) -> DataFrame:
    """Dated rows flagged where the class-week is unreliable."""
    return panel.mark_unreliable(
        _weekday_facts(t), weekly_rates(t), CLASS_KEYS,
        missing_is_unreliable=False, on_unreliable="flag",
    )


PANEL_1_SQL = """student_id, date, school_name, class_name, grade, absent"""


def reliable_panel_rows(t: Tables, **options) -> DataFrame:
    learners, classes = views.student_form(t), views.class_form(t)
    absences = phase_one.slot_absences(views.slot_tables(t), learners, classes)
    return phase_one.phase_one_panel(learners, classes, views.school_form(t), absences, **options)


@query("reliable_panel", f"""WITH {views.PHASE_ONE}
SELECT student_id, date, school_name, class_name, grade, absent, dob,
       CASE district_code WHEN 1 THEN 'Manhiça' WHEN 2 THEN 'Magude' END AS district,
       CASE gender_code WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS gender,
       round(gps_lat / 1e10, 6) AS gps_lat
FROM panel_1""")
def reliable_panel(t: Tables) -> DataFrame:
    """First-phase panel: eligible months, believable weeks, labels and flag."""
    rows = reliable_panel_rows(t)
    return rounded(rows, "GPS_LAT").select(
        "student_id", "date", F.col("SCHOOL_NAME").alias("school_name"),
        F.col("CLASS_NAME").alias("class_name"), F.col("GRADE").alias("grade"), "absent",
        F.col("DOB").alias("dob"), "district", "gender", F.col("GPS_LAT").alias("gps_lat"),
    )


@query("flagged_panel", f"""WITH {views.PHASE_ONE}
SELECT p.student_id, p.date, a.student_id IS NOT NULL AS absent, coalesce(r.rate < 1, false) AS remove
FROM eligible_days p
LEFT JOIN rated_1 r ON p.district_code = r.district_code AND p.school_name = r.school_name
  AND p.grade = r.grade AND p.class_name = r.class_name AND strftime(p.date, '%Y-%U') = r.year_week
LEFT JOIN (SELECT DISTINCT * FROM slot_absences) a ON a.student_id = p.student_id AND a.date = p.date
""")
def flagged_panel(t: Tables) -> DataFrame:
    """The panel with unreliable weeks flagged, weeks without absences kept."""
    rows = reliable_panel_rows(t, missing_is_unreliable=False, on_unreliable="flag")
    return rows.select("student_id", "date", "absent", "remove")


@query("eligible_months_panel", f"""WITH {views.CLASS_FORM}, {views.STUDENT_FORM},
days AS (
  SELECT CAST(d AS DATE) AS date
  FROM generate_series(TIMESTAMP '2015-03-01', TIMESTAMP '2015-12-31', INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 6)
SELECT f.uri AS student_id, c.class_name, d.date
FROM student_form f
JOIN class_form c ON f.school_uuid = c.school_uuid AND f.class_uuid = c.class_uuid
JOIN days d ON month(d.date) IN (m1, m2, m3)""")
def eligible_months_panel(t: Tables) -> DataFrame:
    """Student-days in the reference months of the student's class."""
    joined = joins.left_join(
        views.student_form(t), views.class_form(t).drop("_URI"), ["SCHOOL_UUID", "CLASS_UUID"]
    )
    days = panel.expand_days(joined, "2015-03-01", "2015-12-31", months=phase_one.MONTHS)
    return days.select(
        F.col("_URI").alias("student_id"), F.col("CLASS_NAME").alias("class_name"), "date"
    )


@query("eligible_month_filter", f"""WITH {views.CLASS_FORM}, {views.STUDENT_FORM}
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, class_name
FROM orders JOIN student_form f ON CAST(o_custkey AS VARCHAR) = f.uri
JOIN class_form c ON f.class_uuid = c.class_uuid
WHERE month(o_orderdate) IN (m1, m2, m3)""")
def eligible_month_filter(t: Tables) -> DataFrame:
    """Dated rows that fall in a reference month of the student's class."""
    months = views.class_form(t).select("CLASS_UUID", "CLASS_NAME", *phase_one.MONTHS)
    pupils = views.student_form(t).select("_URI", "CLASS_UUID").join(months, "CLASS_UUID")
    facts = order_days(t).select(
        "o_orderkey", "date", F.col("student_id").cast("string").alias("_URI")
    )
    kept = panel.eligible_months(facts.join(pupils, "_URI"), phase_one.MONTHS)
    return kept.select("o_orderkey", "date", F.col("CLASS_NAME").alias("class_name"))


def _phased(t: Tables) -> DataFrame:
    phase = F.when(F.year("date") <= 1995, 1).when(F.year("date") >= 2001, 2)
    return order_days(t).select("o_orderkey", "student_id", "date", phase.alias("phase"))


PHASED = ORDER_DAYS + """,
phased AS (
  SELECT o_orderkey, student_id, date,
         CAST(CASE WHEN year(date) <= 1995 THEN 1 WHEN year(date) >= 2001 THEN 2 END AS INTEGER) AS phase
  FROM order_days)"""


@query("both_phases", f"""WITH {PHASED}
SELECT * FROM phased WHERE student_id IN (
  SELECT student_id FROM phased GROUP BY 1
  HAVING count(*) FILTER (WHERE phase = 1) > 0 AND count(*) FILTER (WHERE phase = 2) > 0)""")
def both_phases(t: Tables) -> DataFrame:
    """Rows of students observed in both phases."""
    return panel.both_phases(_phased(t), "student_id")


@query("season_filter", f"""WITH {ORDER_DAYS}
SELECT o_orderkey, student_id, date FROM order_days WHERE month(date) NOT IN (12, 1)""")
def season_filter(t: Tables) -> DataFrame:
    """Rows outside the school break."""
    return panel.drop_break(order_days(t)).select("o_orderkey", "student_id", "date")


@query("distinct_rows", f"""WITH {EVENT_DAYS} SELECT DISTINCT * FROM event_days""")
def distinct_rows(t: Tables) -> DataFrame:
    """Whole-row de-duplication."""
    return dedupe.drop_repeats(event_days(t))


@query("keep_first_order", f"""WITH {ORDER_DAYS}
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY date, o_orderkey) AS rn
  FROM order_days) WHERE rn = 1""")
def keep_first_order(t: Tables) -> DataFrame:
    """The first row of each student under an explicit order."""
    return dedupe.keep_first(order_days(t), ["student_id"], [F.col("date"), F.col("o_orderkey")])


@query("entity_numbers", f"""WITH {STUDENTS}
SELECT student_id, district, school_name, n AS school_number, m AS student_number,
       lpad(CAST(district_code AS VARCHAR), 2, '0') || '-' || lpad(CAST(n AS VARCHAR), 2, '0') || '-' ||
       CASE WHEN length(CAST(m AS VARCHAR)) < 3 THEN lpad(CAST(m AS VARCHAR), 3, '0')
            ELSE CAST(m AS VARCHAR) END AS combined_number
FROM (
  SELECT student_id, district, school_name,
         CASE WHEN district = 'AFRICA' THEN 1 WHEN district = 'AMERICA' THEN 2 ELSE 0 END AS district_code,
         dense_rank() OVER (ORDER BY school_name) AS n,
         row_number() OVER (PARTITION BY school_name ORDER BY class_name, name) AS m
  FROM students)""")
def entity_numbers(t: Tables) -> DataFrame:
    """School and student numbers and the combined id built from them."""
    code = F.when(F.col("district") == "AFRICA", 1).when(F.col("district") == "AMERICA", 2)
    roster = students(t).select(
        "student_id", "district", "school_name", "class_name", "name",
        code.alias("district_number"),
    )
    numbered = dedupe.numbered_ids(roster, "district_number", "school_name", ["class_name", "name"])
    return numbered.select(
        "student_id", "district", "school_name", "school_number", "student_number",
        "combined_number",
    )


@query("school_days", f"""WITH {ORDER_DAYS}
SELECT o_orderkey, student_id, date FROM order_days
WHERE isodow(date) < 6 AND date NOT IN (DATE '1996-05-01', DATE '1996-06-25', DATE '1997-12-25')""")
def school_days(t: Tables) -> DataFrame:
    """Weekday rows that fall on no listed holiday."""
    return panel.school_days(
        order_days(t).select("o_orderkey", "student_id", "date"),
        ["1996-05-01", "1996-06-25", "1997-12-25"],
    )


@query("school_days_table", f"""WITH {ORDER_DAYS}
SELECT o_orderkey, student_id, date FROM order_days
WHERE isodow(date) < 6 AND date NOT IN (
  SELECT date FROM order_days WHERE priority = '1-URGENT' AND status = 'F')""")
def school_days_table(t: Tables) -> DataFrame:
    """Weekday rows that fall on no day of a holiday table."""
    facts = order_days(t)
    holidays = facts.filter((F.col("priority") == "1-URGENT") & (F.col("status") == "F"))
    return panel.school_days(facts.select("o_orderkey", "student_id", "date"), holidays)


@query("class_day_expansion", f"""WITH {views.PHASE_TWO}
SELECT combined_number, school_number, grade, class, date, absent FROM attendance_2""")
def class_day_expansion(t: Tables) -> DataFrame:
    """Second-phase attendance: each student over the class's believable days."""
    from workload.composite_queries import second_phase

    return second_phase(t)["attendance"]


@query("reconcile", f"""WITH {views.PHASE_TWO},
reported AS (SELECT combined_number, count(*) AS reported FROM absences_2 GROUP BY 1),
counted AS (
  SELECT combined_number, count(a.date) AS on_lective_days
  FROM attendance_2 LEFT JOIN absences_2 a USING (combined_number, date) GROUP BY 1)
SELECT combined_number, reported, on_lective_days
FROM reported JOIN counted USING (combined_number) WHERE reported > on_lective_days""")
def reconcile(t: Tables) -> DataFrame:
    """Students with more reported absences than absences on lective days."""
    from workload.composite_queries import second_phase

    return second_phase(t)["reconciliation"]
