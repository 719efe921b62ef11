"""Field-work reports and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.functions import dates
from rollbook.operators import checks, joins, quality
from workload.base import Tables, query, rounded
from workload.panel_queries import USER_PANEL, user_panel
from workload.views import ORDER_DAYS, STUDENTS, order_days, students

FOUND_ONLY = """found_rows AS (
  SELECT students.*, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'P' THEN '2' END AS student_found,
         o_orderpriority AS cod_inq
  FROM students LEFT JOIN orders ON o_custkey = student_id)"""
FOUND_ROWS = STUDENTS + ",\n" + FOUND_ONLY


def found_rows(t: Tables) -> DataFrame:
    """Students with the outcome of each visit: one order is one visit."""
    status = F.col("o_orderstatus")
    visits = t("orders").select(
        F.col("o_custkey").alias("student_id"),
        F.when(status == "F", "1").when(status == "P", "2").alias("student_found"),
        F.col("o_orderpriority").alias("cod_inq"),
    )
    return students(t).join(visits, "student_id", "left")


@query("found_by_school", f"""WITH {FOUND_ROWS}
SELECT school_number, min(school_name) AS school_name, count(DISTINCT combined_number) AS n,
       count(*) FILTER (WHERE student_found = '1') AS found,
       count(*) FILTER (WHERE student_found = '2') AS not_found
FROM found_rows GROUP BY 1""")
def found_by_school(t: Tables) -> DataFrame:
    """Students found and not found per school."""
    return quality.found_counts(found_rows(t), name="school_name")


@query("collected_so_far", f"""WITH {FOUND_ROWS},
per AS (
  SELECT school_number, grade, count(*) FILTER (WHERE student_found = '1') AS found,
         count(*) FILTER (WHERE student_found = '2') AS not_found FROM found_rows GROUP BY ALL)
SELECT school_number * 10 + grade AS class_code, found, not_found FROM per
WHERE found + not_found > 10""")
def collected_so_far(t: Tables) -> DataFrame:
    """Groups with more than ten students visited."""
    coded = found_rows(t).withColumn("class_code", F.col("school_number") * 10 + F.col("grade"))
    found = quality.found_counts(coded, "class_code", "school_name")
    return quality.collected_so_far(found).select("class_code", "found", "not_found")


@query("visited_missing", f"""WITH {FOUND_ROWS},
visited AS (
  SELECT school_number FROM found_rows GROUP BY 1
  HAVING count(*) FILTER (WHERE student_found = '1') > 5)
SELECT district, school_name, grade, class_name, name FROM found_rows
WHERE student_found = '2' AND school_number IN (SELECT school_number FROM visited)""")
def visited_missing(t: Tables) -> DataFrame:
    """Students not found in visited schools."""
    return quality.visited_missing(found_rows(t)).select(
        "district", "school_name", "grade", "class_name", "name"
    )


@query("interviewer_report", f"""WITH {FOUND_ROWS}
SELECT cod_inq, count(*) AS n, count(*) FILTER (WHERE student_found = '1') AS found,
       count(*) FILTER (WHERE student_found = '2') AS not_found,
       round(count(*) FILTER (WHERE student_found = '1') * 1e0 /
             nullif(count(*) FILTER (WHERE student_found = '2'), 0), 6) AS ratio_found_not_found,
       round(count(*) FILTER (WHERE student_found = '1') * 100e0 / count(*), 6) AS p_found
FROM found_rows GROUP BY 1""")
def interviewer_report(t: Tables) -> DataFrame:
    """Found and not-found students per interviewer."""
    return rounded(
        quality.interviewer_report(found_rows(t)), "ratio_found_not_found", "p_found"
    )


ABSENCES = ORDER_DAYS + ",\n" + STUDENTS + """,
counts AS (
  SELECT student_id, count(*) FILTER (WHERE absent) AS absences,
         count(*) FILTER (WHERE absent AND month(date) = 2) AS absences_feb,
         count(*) FILTER (WHERE absent AND month(date) = 3) AS absences_mar,
         count(*) FILTER (WHERE absent AND month(date) = 4) AS absences_apr
  FROM (SELECT *, CASE WHEN status <> 'P' THEN status = 'F' END AS absent FROM order_days)
  GROUP BY 1)"""
MONTHS = {"absences_feb": 2, "absences_mar": 3, "absences_apr": 4}


def flagged_orders(t: Tables) -> DataFrame:
    absent = F.when(F.col("status") != "P", F.col("status") == "F")
    return order_days(t).withColumn("absent", absent)


def absence_counts(t: Tables) -> DataFrame:
    return quality.absence_counts(
        students(t).select("student_id", "combined_number", "school_name"),
        flagged_orders(t), MONTHS, "student_id",
    )


COUNT_SQL = """student_id, combined_number, school_name, coalesce(absences, 0) AS absences,
       coalesce(absences_feb, 0) AS absences_feb, coalesce(absences_mar, 0) AS absences_mar,
       coalesce(absences_apr, 0) AS absences_apr
FROM students LEFT JOIN counts USING (student_id)"""


@query("absences_by_month_per_student", f"WITH {ABSENCES} SELECT {COUNT_SQL}")
def absences_by_month_per_student(t: Tables) -> DataFrame:
    """Absences per student, in total and by month, zero-filled."""
    return absence_counts(t)


@query("missing_student_absences", f"""WITH {ABSENCES},
{FOUND_ONLY},
visited AS (
  SELECT school_number FROM found_rows GROUP BY 1
  HAVING count(*) FILTER (WHERE student_found = '1') > 5)
SELECT f.student_id, f.cod_inq, coalesce(absences, 0) AS absences,
       coalesce(absences_feb, 0) AS absences_feb, coalesce(absences_mar, 0) AS absences_mar,
       coalesce(absences_apr, 0) AS absences_apr
FROM found_rows f LEFT JOIN counts USING (student_id)
WHERE student_found = '2' AND school_number IN (SELECT school_number FROM visited)""")
def missing_student_absences(t: Tables) -> DataFrame:
    """Absence counts of the students not found in visited schools."""
    missing = quality.visited_missing(found_rows(t)).select("student_id", "cod_inq")
    return quality.absence_counts(missing, flagged_orders(t), MONTHS, "student_id")


@query("many_absences", f"""WITH {ABSENCES}
SELECT * FROM (SELECT {COUNT_SQL}) WHERE absences >= 6""")
def many_absences(t: Tables) -> DataFrame:
    """Students with many absences."""
    return quality.many_absences(absence_counts(t), at_least=6)


@query("zero_absence", f"""WITH {ABSENCES}
SELECT month, student_id, absences FROM (
  SELECT CAST(month(date) AS INTEGER) AS month, student_id,
         count(*) FILTER (WHERE status = 'F') AS absences
  FROM order_days GROUP BY 1, 2)
WHERE absences = 0""")
def zero_absence(t: Tables) -> DataFrame:
    """Student-months without an absence among the dated facts."""
    return quality.zero_absence_months(flagged_orders(t), "student_id")


@query("month_extremes", f"""WITH {USER_PANEL},
monthly AS (
  SELECT CAST(month(date) AS INTEGER) AS month, user_id, count(*) FILTER (WHERE absent) AS absences
  FROM user_panel GROUP BY 1, 2)
SELECT month, count(*) AS students, count(*) FILTER (WHERE absences = 0) AS never_absent,
       count(*) FILTER (WHERE absences > 10) AS often_absent
FROM monthly GROUP BY 1""")
def month_extremes(t: Tables) -> DataFrame:
    """How many students were never and how many very often absent per month."""
    return quality.month_extremes(user_panel(t), "user_id", more_than=10)


DAYS_OFF = ORDER_DAYS + ",\n" + STUDENTS + """,
days_off AS (
  SELECT DISTINCT school_number AS school, school_name, date
  FROM order_days JOIN students USING (student_id) WHERE priority = '1-URGENT')"""


def days_off(t: Tables) -> DataFrame:
    """A school is closed on the days of its students' urgent orders."""
    urgent = order_days(t).filter(F.col("priority") == "1-URGENT").select("student_id", "date")
    return urgent.join(students(t), "student_id").select(
        F.col("school_number").alias("school"), "school_name", "date"
    ).distinct()


@query("days_off_per_school", f"""WITH {DAYS_OFF}
SELECT school, min(school_name) AS school_name, count(*) AS n, count(*) BETWEEN 8 AND 15 AS in_range
FROM days_off WHERE isodow(date) < 6 GROUP BY 1""")
def days_off_per_school(t: Tables) -> DataFrame:
    """Weekday days off per school and whether their number is plausible."""
    return quality.days_off_per_school(days_off(t))


@query("days_off_per_month", f"""WITH {DAYS_OFF}
SELECT school_name, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       count(*) AS n
FROM days_off GROUP BY ALL""")
def days_off_per_month(t: Tables) -> DataFrame:
    """Days off per school, year and month."""
    return quality.days_off_per_month(days_off(t))


@query("conflict_days", f"""WITH {DAYS_OFF}
SELECT o_orderkey, student_id, o.date, s.school_number AS school
FROM order_days o JOIN students s USING (student_id)
WHERE status = 'F' AND EXISTS (
  SELECT 1 FROM days_off d WHERE d.school = s.school_number AND d.date = o.date)""")
def conflict_days(t: Tables) -> DataFrame:
    """Absences on days their school reports as days off."""
    absences = order_days(t).filter(F.col("status") == "F").select("o_orderkey", "student_id", "date")
    placed = absences.join(
        students(t).select("student_id", F.col("school_number").alias("school")), "student_id"
    )
    return joins.conflicts(placed, days_off(t), ["school", "date"])


@query("unique_check", """
SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1""")
def unique_check(t: Tables) -> DataFrame:
    """Keys that occur more than once."""
    return quality.unique_check(t("part"), ["p_name", "p_brand"])


@query("entity_count_check", """
SELECT count(DISTINCT c_nationkey) AS found, CAST(25 AS BIGINT) AS expected,
       count(DISTINCT c_nationkey) = 25 AS as_expected
FROM customer""")
def entity_count_check(t: Tables) -> DataFrame:
    """Number of schools against the expected number."""
    return quality.count_check(t("customer"), "c_nationkey")


@query("range_check", """
SELECT o_orderkey, m FROM (
  SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders)
WHERE m NOT BETWEEN 4 AND 11""")
def range_check(t: Tables) -> DataFrame:
    """Rows whose month lies outside the plausible reference months."""
    return quality.range_check(
        t("orders").select("o_orderkey", F.month("o_orderdate").alias("m")), ["m"]
    )


@query("missing_ids", """
SELECT c_nationkey AS school, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS missing,
       round(count(*) FILTER (WHERE c_acctbal < 0) * 100e0 / count(*), 6) AS p_missing
FROM customer GROUP BY 1""")
def missing_ids(t: Tables) -> DataFrame:
    """Share of students without an id, per school."""
    permid = F.when(F.col("c_acctbal") >= 0, F.col("c_name"))
    rows = t("customer").select(F.col("c_nationkey").alias("school"), permid.alias("permid"))
    return rounded(quality.missing_share(rows, "permid", ["school"]), "p_missing")


@query("mark_completeness", f"""WITH {STUDENTS},
rows AS (
  SELECT school_number, class_name, CAST(month(o_orderdate) AS INTEGER) AS month,
         unnest(['price', 'priority']) AS subject,
         unnest([o_totalprice > 100000, o_orderpriority < '4']) AS complete
  FROM orders JOIN students ON o_custkey = student_id)
SELECT school_number, class_name, month, subject, count(*) AS n,
       count(*) FILTER (WHERE complete) AS complete,
       count(*) - count(*) FILTER (WHERE complete) AS missing,
       round(count(*) FILTER (WHERE complete) * 100e0 / count(*), 6) AS p_complete
FROM rows GROUP BY ALL""")
def mark_completeness(t: Tables) -> DataFrame:
    """Complete and missing answers by school, class, month and subject."""
    from rollbook.operators import reshape

    facts = t("orders").select(
        F.col("o_custkey").alias("student_id"), F.month("o_orderdate").alias("month"),
        F.when(F.col("o_totalprice") > 100000, 1.0).alias("price"),
        F.when(F.col("o_orderpriority") < "4", 1.0).alias("priority"),
    ).join(students(t).select("student_id", "school_number", "class_name"), "student_id")
    by = ["school_number", "class_name", "month"]
    long = reshape.to_long(facts, by, ["price", "priority"], "subject", "mark")
    return rounded(quality.completeness(long, "mark", [*by, "subject"]), "p_complete")


@query("teachers_per_school", """
SELECT s_nationkey AS school, count(DISTINCT s_name) AS n_members FROM supplier GROUP BY 1""")
def teachers_per_school(t: Tables) -> DataFrame:
    """Distinct teachers per school."""
    rows = t("supplier").select(F.col("s_nationkey").alias("school"), "s_name")
    return quality.members_per_group(rows, ["school"], "s_name")


PEOPLE_SQL = """people AS (
  SELECT c_custkey, DATE '1930-01-01' + CAST(c_custkey * 37 % 29000 AS INTEGER) AS dob FROM customer)"""


def people(t: Tables) -> DataFrame:
    days = (F.col("c_custkey") * 37 % 29000).cast("int")
    return t("customer").select(
        "c_custkey", F.date_add(F.to_date(F.lit("1930-01-01")), days).alias("dob")
    )


@query("age_check", f"""WITH {PEOPLE_SQL}
SELECT c_custkey, dob FROM people
WHERE dob > DATE '2016-06-30' - INTERVAL 18 YEAR OR dob < DATE '2016-06-30' - INTERVAL 70 YEAR""")
def age_check(t: Tables) -> DataFrame:
    """People implausibly young or old on a given day."""
    found = quality.age_check(people(t), F.to_date(F.lit("2016-06-30")))
    return found.select("c_custkey", "dob")


@query("histogram", f"""WITH {PEOPLE_SQL},
span AS (SELECT min(dob) AS lo, max(dob) AS hi FROM people)
SELECT CAST(least(floor((dob - lo) * 100e0 / (hi - lo)), 99) AS BIGINT) AS bin,
       count(*) AS n, min(dob) AS first, max(dob) AS last
FROM people, span GROUP BY 1""")
def histogram(t: Tables) -> DataFrame:
    """Dates of birth in one hundred bins."""
    return quality.date_histogram(people(t))


@query("teacher_absence_rate", """
SELECT strftime(l_shipdate, '%Y-%m') AS year_month,
       count(*) FILTER (WHERE l_returnflag = 'R') AS absences,
       count(*) FILTER (WHERE l_returnflag <> 'R') AS presences, count(*) AS eligibles,
       round(count(*) FILTER (WHERE l_returnflag = 'R') * 100e0 / count(*), 6) AS absenteeism_rate
FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-04-01' AND DATE '1998-04-30'
  AND month(l_shipdate) NOT IN (5, 6)
GROUP BY 1""")
def teacher_absence_rate(t: Tables) -> DataFrame:
    """Monthly rate of missed days in a span of months, two months left out."""
    days = t("lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_returnflag") == "R").alias("absent"),
    )
    return rounded(
        quality.teacher_absence_rate(days, "1997-04-01", "1998-04-30"), "absenteeism_rate"
    )


@query("teacher_completeness", """
SELECT s_nationkey AS school, CAST(month(l_shipdate) AS INTEGER) AS month, count(*) AS n,
       count(*) FILTER (WHERE l_linenumber <> 7) AS complete,
       count(*) FILTER (WHERE l_linenumber = 7) AS missing,
       round(count(*) FILTER (WHERE l_linenumber <> 7) * 100e0 / count(*), 6) AS p_complete
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def teacher_completeness(t: Tables) -> DataFrame:
    """Completeness of the teachers' absence flags by school and month."""
    rows = t("lineitem").select(
        "l_suppkey", F.month("l_shipdate").alias("month"),
        F.when(F.col("l_linenumber") != 7, F.col("l_returnflag")).alias("flag"),
    ).join(
        t("supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                             F.col("s_nationkey").alias("school")), "l_suppkey",
    )
    return rounded(quality.completeness(rows, "flag", ["school", "month"]), "p_complete")


@query("checked_panel", f"""WITH {PEOPLE_SQL},
facts AS (
  SELECT orders.*, c_nationkey, c_acctbal, dob, CAST(month(o_orderdate) AS INTEGER) AS m
  FROM orders JOIN customer ON o_custkey = customer.c_custkey JOIN people ON people.c_custkey = o_custkey)
SELECT unnest(['rows', 'months', 'no_id', 'ages', 'no_price', 'no_priority', 'schools', 'students']) AS check,
       unnest([count(*), count(*) FILTER (WHERE m NOT BETWEEN 4 AND 11), count(*) FILTER (WHERE c_acctbal < 0),
               count(*) FILTER (WHERE dob > DATE '2016-06-30' - INTERVAL 18 YEAR OR dob < DATE '2016-06-30' - INTERVAL 70 YEAR),
               count(*) FILTER (WHERE o_totalprice <= 100000), count(*) FILTER (WHERE o_orderpriority >= '4'),
               count(DISTINCT c_nationkey),
               count(DISTINCT o_custkey) FILTER (WHERE o_custkey < 100000)]) AS n
FROM facts""")
def checked_panel(t: Tables) -> DataFrame:
    """Row checks and distinct numbers of a joined table, counted while it is stored."""
    born = people(t).select(F.col("c_custkey").alias("o_custkey"), "dob")
    person = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    facts = t("orders").join(person, "o_custkey").join(born, "o_custkey").withColumn("month", F.month("o_orderdate"))
    age = dates.age_years(F.col("dob"), F.to_date(F.lit("2016-06-30")))
    faults = {
        "months": checks.outside(F.col("month"), 4, 11), "no_id": F.col("c_acctbal") < 0,
        "ages": checks.outside(age, 18, 70), "no_price": F.col("o_totalprice") <= 100000,
        "no_priority": F.col("o_orderpriority") >= "4",
    }
    numbers = {"schools": (F.col("c_nationkey"), 100), "students": (F.col("o_custkey"), 100_000)}
    stored, counts = checks.store_checked(facts, "checked-panel", faults, numbers)
    return checks.as_table(stored, counts)
