"""The study's entities seen in the generated tables, in Spark and in SQL.

student = customer, school = nation, district = region, class = market segment,
dated facts = orders and lineitem, day events = events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.functions import keys
from workload.base import Tables, day, pad


def regions_of(t: Tables) -> DataFrame:
    """Customers with the region number of their nation."""
    nation = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return t("customer").join(nation, "c_nationkey")


def places(t: Tables) -> DataFrame:
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    region = t("region").select("r_regionkey", "r_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def students(t: Tables) -> DataFrame:
    """Roster: one row per customer."""
    joined = t("customer").join(places(t), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.concat_ws("-", "n_regionkey", "c_nationkey", "c_custkey")
    return joined.select(
        F.col("c_custkey").alias("student_id"),
        keys.composite_id(raw).alias("combined_number"),
        F.col("r_name").alias("district"),
        F.col("c_nationkey").alias("school_number"),
        F.col("n_name").alias("school_name"),
        (F.col("c_custkey") % 7 + 1).cast("int").alias("grade"),
        F.col("c_mktsegment").alias("class_name"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.col("c_acctbal").alias("balance"),
    )


STUDENTS = f"""students AS (
  SELECT c_custkey AS student_id,
         {pad('n_regionkey', 2)} || '-' || {pad('c_nationkey', 2)} || '-' || {pad('c_custkey', 3)}
           AS combined_number,
         r_name AS district, c_nationkey AS school_number, n_name AS school_name,
         CAST(c_custkey % 7 + 1 AS INTEGER) AS grade, c_mktsegment AS class_name, c_name AS name,
         CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
         c_acctbal AS balance
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def shipments(t: Tables) -> DataFrame:
    """Student-days from lineitem; the flag of a seventh line is unknown."""
    lines = t("lineitem").select(
        "l_orderkey", day("l_shipdate").alias("date"),
        F.when(F.col("l_linenumber") != 7, F.col("l_returnflag") == "R").alias("absent"),
    )
    # Owners are put on the orders first: the lines, the larger side, are joined once.
    orders = t("orders").select("o_orderkey", F.col("o_custkey").alias("student_id"))
    owned = orders.join(students(t), "student_id")
    return lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))


SHIPMENTS = STUDENTS + """,
shipments AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CASE WHEN l_linenumber <> 7 THEN l_returnflag = 'R' END AS absent, students.*
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN students ON o_custkey = student_id)"""


def order_days(t: Tables) -> DataFrame:
    """Dated facts per student from orders."""
    return t("orders").select(
        F.col("o_orderkey"), F.col("o_custkey").alias("student_id"),
        day("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
    )


ORDER_DAYS = """order_days AS (
  SELECT o_orderkey, o_custkey AS student_id, CAST(o_orderdate AS DATE) AS date,
         o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price
  FROM orders)"""


def event_days(t: Tables) -> DataFrame:
    return t("events").select(
        "user_id", day("ts").alias("date"), (F.col("event_type") == "error").alias("absent")
    )


EVENT_DAYS = """event_days AS (
  SELECT user_id, CAST(ts AS DATE) AS date, event_type = 'error' AS absent FROM events)"""


# --- survey forms derived from the tables -----------------------------------

def school_form(t: Tables) -> DataFrame:
    """One form per region that has customers, with coded answers."""
    per_region = t("customer").join(
        places(t), F.col("c_nationkey") == F.col("n_nationkey")
    ).groupBy("n_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n"))
    return per_region.select(
        F.col("n_regionkey").cast("string").alias("SCHOOL_UUID"),
        (F.col("n_regionkey") % 3 + 1).cast("int").alias("DISTRICT"),
        (F.col("n") % 6 + 1).cast("int").alias("TYPE_OF_LATRINE"),
        (F.col("n") % 9 + 1).cast("int").alias("SCHOOL_CONDITIONS"),
        F.col("r_name").alias("SCHOOL_NAME"),
        (F.lit(-250000000000) - F.col("n")).alias("GPS_LAT"),
        (F.lit(320000000000) + F.col("n")).alias("GPS_LNG"),
        (F.col("n") % 3).cast("int").alias("LUNCH"),
        F.col("n").cast("int").alias("NUMBER_OF_CLASSES"),
    )


SCHOOL_FORM = """school_form AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS school_uuid,
         CAST(n_regionkey % 3 + 1 AS INTEGER) AS district_code,
         CAST(count(*) % 6 + 1 AS INTEGER) AS latrine, CAST(count(*) % 9 + 1 AS INTEGER) AS conditions,
         r_name AS school_name, -250000000000 - count(*) AS gps_lat, 320000000000 + count(*) AS gps_lng,
         CAST(count(*) % 3 AS INTEGER) AS lunch, count(*) AS n_classes
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY n_regionkey, r_name)"""


def class_form(t: Tables) -> DataFrame:
    """One class per region and segment; a third of the last months is mistyped as January."""
    first = F.col("first_student")
    return (
        regions_of(t).groupBy("n_regionkey", "c_mktsegment").agg(F.min("c_custkey").alias("first_student"))
        .select(
            F.concat_ws("/", "n_regionkey", "c_mktsegment").alias("_URI"),
            F.col("n_regionkey").cast("string").alias("SCHOOL_UUID"),
            F.concat_ws("/", "n_regionkey", "c_mktsegment").alias("CLASS_UUID"),
            F.col("c_mktsegment").alias("CLASS_NAME"),
            (first % 5 + 1).cast("int").alias("GRADE"),
            (first % 4 + 3).cast("int").alias("FIRST_MONTH_OF_REFERENCE"),
            (first % 4 + 5).cast("int").alias("SECOND_MONTH_OF_REFERENCE"),
            F.when(first % 3 == 0, 1).otherwise(first % 4 + 8).cast("int")
            .alias("THIRD_MONTH_OF_REFERENCE"),
        )
    )


CLASS_FORM = """class_form AS (
  SELECT CAST(n_regionkey AS VARCHAR) || '/' || c_mktsegment AS class_uuid,
         CAST(n_regionkey AS VARCHAR) AS school_uuid, c_mktsegment AS class_name,
         CAST(min(c_custkey) % 5 + 1 AS INTEGER) AS grade,
         CAST(min(c_custkey) % 4 + 3 AS INTEGER) AS m1, CAST(min(c_custkey) % 4 + 5 AS INTEGER) AS m2,
         CAST(CASE WHEN min(c_custkey) % 3 = 0 THEN 1 ELSE min(c_custkey) % 4 + 8 END AS INTEGER) AS m3
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_regionkey, c_mktsegment)"""


def student_form(t: Tables) -> DataFrame:
    """One form per customer."""
    key = F.col("c_custkey")
    born = F.date_add(F.to_date(F.lit("2000-01-01")), (key % 3000).cast("int"))
    joined = regions_of(t)
    return joined.select(
        key.cast("string").alias("_URI"), F.col("c_name").alias("NAME"),
        F.concat(F.lpad(key.cast("string"), 12, "0"), F.lit("-01")).alias("PERMID"),
        F.col("n_regionkey").cast("string").alias("SCHOOL_UUID"),
        F.concat_ws("/", "n_regionkey", "c_mktsegment").alias("CLASS_UUID"),
        F.upper(F.date_format(born, "ddMMMyyyy")).alias("DOB"),
        F.lpad(key.cast("string"), 8, "0").alias("HOUSEHOLD_NUMBER"),
        (key % 3 + 1).cast("int").alias("GENDER"),
    )


STUDENT_FORM = """student_form AS (
  SELECT CAST(c_custkey AS VARCHAR) AS uri, c_name AS name,
         lpad(CAST(c_custkey AS VARCHAR), 12, '0') || '-01' AS permid,
         CAST(n_regionkey AS VARCHAR) AS school_uuid,
         CAST(n_regionkey AS VARCHAR) || '/' || c_mktsegment AS class_uuid,
         DATE '2000-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS dob,
         CAST(c_custkey % 3 + 1 AS INTEGER) AS gender_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def slot_tables(t: Tables) -> dict[int, DataFrame]:
    """Three month tables of absences from the orders, by their status.

    Day numbers run from 0 to 31, so some name no calendar day.
    """
    rows = t("orders").select(
        F.col("o_custkey").cast("string").alias("_PARENT_AURI"), "o_orderstatus",
        (F.col("o_orderkey") % 32).cast("int").alias("day"),
    )
    names = {
        1: ("F", "DAYS_OF_ABSENCE_FIRST_MONTH"), 2: ("O", "DAYS_OF_ABSENCE_SECOND_MONTH"),
        3: ("P", "DAYS_OF_ABSENCE_THIRD_MONTH"),
    }
    return {
        slot: rows.filter(F.col("o_orderstatus") == status)
        .select("_PARENT_AURI", F.col("day").alias(column))
        for slot, (status, column) in names.items()
    }


SLOT_ABSENCES = CLASS_FORM + ",\n" + STUDENT_FORM + """,
slot_rows AS (
  SELECT CAST(o_custkey AS VARCHAR) AS uri, o_orderkey % 32 AS day,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS slot
  FROM orders),
slot_absences AS (
  SELECT uri AS student_id, date FROM (
    SELECT s.uri, TRY_CAST('2015-' || lpad(CAST(
             CASE s.slot WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE CASE WHEN m3 = 1 THEN 9 ELSE m3 END END
           AS VARCHAR), 2, '0') || '-' || lpad(CAST(s.day AS VARCHAR), 2, '0') AS DATE) AS date
    FROM slot_rows s
    LEFT JOIN student_form f ON s.uri = f.uri
    LEFT JOIN class_form c ON f.class_uuid = c.class_uuid)
  WHERE date IS NOT NULL)"""


# The first phase's panel: eligible students, weekly rates, believable days.
PHASE_ONE = SLOT_ABSENCES + ",\n" + SCHOOL_FORM + """,
days_2015 AS (
  SELECT CAST(d AS DATE) AS date
  FROM generate_series(TIMESTAMP '2015-03-01', TIMESTAMP '2015-12-31', INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 6),
student_class AS (
  SELECT f.uri AS student_id, f.name, f.permid, f.dob, f.gender_code, c.class_name, c.grade,
         c.m1, c.m2, c.m3, s.*EXCLUDE (school_uuid)
  FROM student_form f
  LEFT JOIN class_form c ON f.class_uuid = c.class_uuid AND f.school_uuid = c.school_uuid
  LEFT JOIN school_form s ON f.school_uuid = s.school_uuid),
eligible_days AS (
  SELECT s.*, d.date FROM student_class s JOIN days_2015 d ON month(d.date) IN (m1, m2, m3)),
eligible AS (SELECT DISTINCT * EXCLUDE (date) FROM eligible_days),
enrolled_1 AS (
  SELECT district_code, school_name, grade, class_name, count(DISTINCT student_id) AS n_students
  FROM eligible GROUP BY ALL),
weekly_1 AS (
  SELECT e.district_code, e.school_name, e.grade, e.class_name,
         strftime(a.date, '%Y-%U') AS year_week, count(*) AS absences
  FROM slot_absences a JOIN eligible e USING (student_id) GROUP BY ALL),
rated_1 AS (
  SELECT w.*, n_students, w.absences * 100e0 / (n_students * 5) AS rate
  FROM weekly_1 w JOIN enrolled_1 USING (district_code, school_name, grade, class_name)),
panel_1 AS (
  SELECT p.*, a.student_id IS NOT NULL AS absent
  FROM eligible_days p
  JOIN rated_1 r ON p.district_code = r.district_code AND p.school_name = r.school_name
    AND p.grade = r.grade AND p.class_name = r.class_name
    AND strftime(p.date, '%Y-%U') = r.year_week AND r.rate >= 1
  LEFT JOIN (SELECT DISTINCT * FROM slot_absences) a
    ON a.student_id = p.student_id AND a.date = p.date)"""


def ids(t: Tables) -> DataFrame:
    """Id numbers per student: region, region and customer number."""
    key = F.col("c_custkey")
    joined = regions_of(t)
    raw = F.concat_ws("-", "n_regionkey", "c_nationkey", key)
    return joined.select(
        F.col("c_name").alias("NAME"),
        F.concat(F.lpad(key.cast("string"), 12, "0"), F.lit("-01")).alias("PERMID"),
        keys.zero_pad(F.col("n_regionkey")).alias("district_number"),
        keys.zero_pad(F.col("c_nationkey")).alias("school_number"),
        keys.zero_pad(key, 3).alias("student_number"),
        keys.composite_id(raw).alias("combined_number"),
    )


IDS = f"""ids AS (
  SELECT c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 12, '0') || '-01' AS permid,
         {pad('n_regionkey', 2)} AS district_number, {pad('c_nationkey', 2)} AS school_number,
         {pad('c_custkey', 3)} AS student_number,
         {pad('n_regionkey', 2)} || '-' || {pad('c_nationkey', 2)} || '-' || {pad('c_custkey', 3)}
           AS combined_number
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def form_b2(t: Tables) -> DataFrame:
    """Second-phase student form: building and trade segments, the found flag from the balance."""
    joined = regions_of(t)
    return joined.select(
        F.col("c_custkey").cast("string").alias("uri"),
        F.concat_ws("-", "n_regionkey", "c_nationkey", "c_custkey").alias("student_number"),
        F.when(F.col("c_acctbal") > 0, "1").otherwise("2").alias("student_found"),
        F.lit("1").alias("grade"),
        F.when(F.col("c_mktsegment") < "G", "A").otherwise("B").alias("class"),
    )


def form_b3(t: Tables) -> DataFrame:
    """Third student form: ids without their leading zero, some without a grade."""
    joined = regions_of(t)
    padded = keys.composite_id(F.concat_ws("-", "n_regionkey", "c_nationkey", "c_custkey"))
    return joined.select(
        F.col("c_custkey").cast("string").alias("uri"),
        F.substring(padded, 2, 100).alias("students_student_number"),
        F.when(F.col("c_mktsegment") != "MACHINERY", "1").alias("students_grade"),
        F.when(F.col("c_mktsegment") < "G", "A").otherwise("B").alias("students_class"),
    )


PHASE_TWO = f"""classes_2 AS (
  SELECT CAST(c_custkey AS VARCHAR) AS uri,
         {pad('n_regionkey', 2)} || '-' || {pad('c_nationkey', 2)} || '-' || {pad('c_custkey', 3)}
           AS combined_number,
         c_nationkey AS school_number, 1 AS grade,
         CASE WHEN c_mktsegment < 'G' THEN 'A' ELSE 'B' END AS class
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
absences_2_raw AS (
  SELECT c.combined_number, c.school_number, c.grade, c.class,
         TRY_CAST('2016-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' ||
                  lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0') AS DATE) AS date,
         month(o_orderdate) AS m
  FROM orders JOIN classes_2 c ON CAST(o_custkey AS VARCHAR) = c.uri
  WHERE month(o_orderdate) BETWEEN 2 AND 6),
absences_2 AS (
  SELECT * FROM absences_2_raw
  WHERE date IS NULL OR (isodow(date) < 6 AND date NOT IN (DATE '2016-05-01', DATE '2016-06-25'))),
enrolled_2 AS (
  SELECT school_number, grade, class, count(DISTINCT combined_number) AS n_students
  FROM classes_2 GROUP BY ALL),
rated_2 AS (
  SELECT school_number, grade, class, year_week, absences * 100e0 / (n_students * 5) AS rate
  FROM (SELECT school_number, grade, class, strftime(date, '%Y-%U') AS year_week, count(*) AS absences
        FROM absences_2 GROUP BY ALL)
  JOIN enrolled_2 USING (school_number, grade, class)),
days_2016 AS (
  SELECT CAST(d AS DATE) AS date
  FROM generate_series(TIMESTAMP '2016-02-01', TIMESTAMP '2016-06-30', INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 6),
attendance_2 AS (
  SELECT c.combined_number, c.school_number, c.grade, c.class, d.date,
         a.combined_number IS NOT NULL AS absent
  FROM rated_2 r
  JOIN days_2016 d ON strftime(d.date, '%Y-%U') = r.year_week
  JOIN classes_2 c ON c.school_number = r.school_number AND c.grade = r.grade AND c.class = r.class
  LEFT JOIN (SELECT DISTINCT combined_number, date FROM absences_2) a
    ON a.combined_number = c.combined_number AND a.date = d.date
  WHERE r.rate >= 1)"""
