"""The study's pipelines end to end: phases, corrections, census, roster, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook import constants as K, session
from rollbook.operators import corrections as fix
from rollbook.operators import joins, linkage, panel, quality
from rollbook.plans import phase_one, phase_two, report, study
from rollbook.sources import attendance as stored
from workload import views
from workload.base import Tables, pad, query, rounded
from workload.link_queries import utm_sql


@query("slot_absences", f"WITH {views.SLOT_ABSENCES} SELECT student_id, date FROM slot_absences")
def slot_absences(t: Tables) -> DataFrame:
    """First-phase absences: month slots to dates, impossible days dropped."""
    return phase_one.slot_absences(
        views.slot_tables(t), views.student_form(t), views.class_form(t)
    )


def month_tables(t: Tables) -> list[phase_two.MonthTable]:
    """Five month tables of absences from the orders, with their parent forms."""
    b2, b3 = phase_two.form_b2_ids(views.form_b2(t)), phase_two.form_b3_ids(views.form_b3(t))
    rows = t("orders").select(
        F.col("o_custkey").cast("string").alias("parent_auri"), "o_orderdate",
        (F.col("o_orderkey") % 32).cast("int").alias("day"),
    )
    return [
        phase_two.MonthTable(
            name, K.PHASE_2_YEAR, f"{form}_{name.lower()}",
            rows.filter(F.month("o_orderdate") == number), parent,
        )
        for name, number, form, parent in (
            ("February", 2, "b2", b2), ("March", 3, "b2", b2), ("April", 4, "b2", b2),
            ("May", 5, "b3", b3), ("June", 6, "b3", b3),
        )
    ]


@query("monthly_absences", f"""WITH {views.PHASE_TWO}
SELECT combined_number, date, true AS absent,
       CASE m WHEN 2 THEN 'b2_february' WHEN 3 THEN 'b2_march' WHEN 4 THEN 'b2_april'
              WHEN 5 THEN 'b3_may' ELSE 'b3_june' END AS src,
       school_number, grade, class
FROM absences_2""")
def monthly_absences(t: Tables) -> DataFrame:
    """Second-phase absences of five month tables with the student's class."""
    classes = phase_two.student_classes(
        phase_two.form_b2_ids(views.form_b2(t)), phase_two.form_b3_ids(views.form_b3(t))
    )
    return phase_two.class_absences(phase_two.dated_months(month_tables(t)), classes)


def second_phase(t: Tables, **options) -> dict[str, DataFrame]:
    b2, b3 = phase_two.form_b2_ids(views.form_b2(t)), phase_two.form_b3_ids(views.form_b3(t))
    return study.second_phase(b2, b3, month_tables(t), **options)


def first_calendars(t: Tables) -> DataFrame:
    """First-phase calendars under the combined id."""
    learners, classes = views.student_form(t), views.class_form(t)
    absences = phase_one.slot_absences(views.slot_tables(t), learners, classes)
    numbered = learners.join(views.ids(t).select("PERMID", "combined_number"), "PERMID", "left")
    return phase_one.phase_one_calendars(numbered, classes, views.school_form(t), absences, number="combined_number")


TWO_PHASE = f"""phases_raw AS (
  SELECT combined_number, date, absent, 1 AS phase
  FROM (SELECT permid, date, absent FROM panel_1) JOIN ids USING (permid)
  UNION ALL
  SELECT combined_number, date, absent, 2 AS phase FROM attendance_2),
attendance AS (
  SELECT DISTINCT combined_number, date, absent, phase FROM phases_raw
  WHERE month(date) NOT IN (12, 1) AND combined_number IN (
    SELECT combined_number FROM phases_raw GROUP BY 1 HAVING count(DISTINCT phase) = 2))"""
PHASED_ROWS = ",\n".join([views.STUDENTS, views.ORDER_DAYS]) + """,
phased AS (
  SELECT combined_number, date, status = 'F' AS absent,
         CASE WHEN year(date) < 1998 THEN 1 ELSE 2 END AS phase
  FROM order_days JOIN students USING (student_id))"""
ATTENDANCE = ",\n".join([views.PHASE_ONE, views.IDS, views.PHASE_TWO, TWO_PHASE])


def both_calendars(t: Tables) -> DataFrame:
    first, second = session.together(lambda: first_calendars(t), lambda: second_phase(t, store=True)["calendars"])
    return panel.two_phase_calendars(first, second, null_is_entity=False)


def attendance(t: Tables) -> DataFrame:
    return panel.attendance_rows(both_calendars(t))


@query("two_phase", f"WITH {ATTENDANCE} SELECT * FROM attendance")
def two_phase(t: Tables) -> DataFrame:
    """Both phases: students seen in both, no break days, no repeats."""
    return attendance(t)


@query("two_phase_rows", f"""WITH {PHASED_ROWS}
SELECT DISTINCT combined_number, date, absent, phase FROM phased
WHERE month(date) NOT IN (12, 1) AND combined_number IN (
  SELECT combined_number FROM phased GROUP BY 1 HAVING count(DISTINCT phase) = 2)""")
def two_phase_rows(t: Tables) -> DataFrame:
    """The same from two tables of dated rows, with their repeats."""
    people = views.students(t).select("student_id", "combined_number")
    rows = views.order_days(t).join(people, "student_id").select(
        "combined_number", "date", (F.col("status") == "F").alias("absent")
    )
    return panel.two_phase(rows.filter(F.year("date") < 1998), rows.filter(F.year("date") >= 1998))


@query("panel_report", f"""WITH {ATTENDANCE},
daily AS (
  SELECT date, CASE left(combined_number, 2) WHEN '01' THEN 'a' WHEN '02' THEN 'b' END AS district,
         count(*) FILTER (WHERE absent) * 100e0 / count(*) AS rate, count(*) AS n
  FROM attendance GROUP BY 1, 2),
pair AS (
  SELECT date, a.rate AS first_rate, a.n AS first_students, b.rate AS second_rate,
         b.n AS second_students
  FROM (SELECT * FROM daily WHERE district = 'a') a
  FULL JOIN (SELECT * FROM daily WHERE district = 'b') b USING (date)),
rolling AS (
  SELECT *, avg(second_rate) OVER w / nullif(avg(first_rate) OVER w, 0) * 100 AS rolling_mean
  FROM pair WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))
SELECT date, first_students, second_students, round(rolling_mean, 6) AS rolling_mean FROM rolling
WHERE first_students >= 10 AND second_students >= 10 AND rolling_mean BETWEEN 20 AND 400""")
def panel_report(t: Tables) -> DataFrame:
    """The report's rolling ratio computed from forms to chart."""
    rolling = report.report(attendance(t))["rolling_ratio"]
    return rounded(rolling, "rolling_mean").select(
        "date", "first_students", "second_students", "rolling_mean"
    )


# --- corrections ------------------------------------------------------------

def roster_rows(t: Tables) -> DataFrame:
    """Students with the attributes a correction may change."""
    numbered = views.ids(t)
    form = views.student_form(t).select(
        "NAME", "PERMID", F.col("CLASS_UUID"), F.col("_URI").cast("bigint").alias("student_order")
    )
    joined = numbered.join(form, ["NAME", "PERMID"])
    return joined.select(
        "combined_number", "NAME", "PERMID", "student_order",
        F.concat(F.lit("school "), F.col("school_number")).alias("SCHOOL_NAME"),
        F.split_part("CLASS_UUID", F.lit("/"), F.lit(2)).alias("CLASS_NAME"),
        (F.col("student_order") % 5).cast("double").alias("GRADE"),
        F.date_add(F.to_date(F.lit("2000-01-01")), (F.col("student_order") % 3000).cast("int"))
        .alias("DOB"),
    )


ROSTER_ONLY = """roster_rows AS (
  SELECT ids.combined_number, ids.name, ids.permid, c_custkey AS student_order,
         'school ' || ids.school_number AS school_name, c_mktsegment AS class_name,
         CAST(c_custkey % 5 AS DOUBLE) AS grade, DATE '2000-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS dob
  FROM ids JOIN customer ON c_name = ids.name)"""
ROSTER_ROWS = views.IDS + ",\n" + ROSTER_ONLY


def correction_rows(t: Tables) -> DataFrame:
    """Urgent finished orders as corrections: attributes partly missing, day lists as text."""
    orders = t("orders").filter(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    )
    key, day = F.col("o_orderkey"), F.dayofmonth("o_orderdate").cast("string")
    person = F.lpad(F.col("o_custkey").cast("string"), 12, "0")
    return orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("NAME"), F.concat(person, F.lit("-01")).alias("permids"),
        F.when(key % 2 == 0, F.concat(F.lit("moved "), key.cast("string"))).alias("name_schools"),
        F.when(key % 3 == 0, (F.lit(36526) + key % 3000).cast("string")).alias("dobs"),
        F.when(key % 5 == 0, "x").otherwise((key % 7).cast("string")).alias("grades"),
        F.when(key % 4 == 0, "corrected").alias("class_names"),
        F.concat_ws("|", day, F.lit("3"), F.lit("x"), F.lit("14")).alias("first_months"),
        F.when(key % 2 == 0, day).alias("second_months"),
        F.concat_ws("|", F.lit("15"), day).alias("third_months"),
        key.alias("correction_order"),
    )


CORRECTIONS = """corrections AS (
  SELECT c_name AS name, lpad(CAST(o_custkey AS VARCHAR), 12, '0') || '-01' AS permid,
         CASE WHEN o_orderkey % 2 = 0 THEN 'moved ' || o_orderkey END AS new_school,
         CASE WHEN o_orderkey % 3 = 0
              THEN DATE '1899-12-30' + CAST(36526 + o_orderkey % 3000 AS INTEGER) END AS new_dob,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS new_grade,
         CASE WHEN o_orderkey % 4 = 0 THEN 'corrected' END AS new_class,
         [day(o_orderdate), 3, 14] AS d1,
         CASE WHEN o_orderkey % 2 = 0 THEN [day(o_orderdate)] ELSE [] END AS d2,
         [15, day(o_orderdate)] AS d3, o_orderkey AS ord
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"""


def typed_corrections(t: Tables) -> DataFrame:
    from rollbook.sources import forms

    return forms.type_corrections(correction_rows(t))


@query("corrected_entities", f"""WITH {ROSTER_ROWS},
{CORRECTIONS},
latest AS (
  SELECT name, permid,
         arg_max(new_school, ord) FILTER (WHERE new_school IS NOT NULL) AS s,
         arg_max(new_dob, ord) FILTER (WHERE new_dob IS NOT NULL) AS d,
         arg_max(new_grade, ord) FILTER (WHERE new_grade IS NOT NULL) AS g,
         arg_max(new_class, ord) FILTER (WHERE new_class IS NOT NULL) AS c
  FROM corrections GROUP BY ALL)
SELECT combined_number, r.name, r.permid, student_order, coalesce(s, school_name) AS school_name,
       coalesce(c, class_name) AS class_name, coalesce(g, grade) AS grade, coalesce(d, dob) AS dob
FROM roster_rows r LEFT JOIN latest l ON r.name = l.name AND r.permid = l.permid""")
def corrected_entities(t: Tables) -> DataFrame:
    """Students with the last non-null correction of every attribute."""
    fixed = fix.correct_entities(
        roster_rows(t), typed_corrections(t), "correction_order", "student_order"
    )
    return fixed.toDF(*[c.lower() for c in fixed.columns])


def reference_months(t: Tables) -> DataFrame:
    months = views.class_form(t).select("CLASS_UUID", *[
        F.col(c).alias(n) for c, n in zip(phase_one.MONTHS, fix.SLOT_MONTHS)
    ])
    return views.student_form(t).join(months, "CLASS_UUID", "left").select(
        F.col("PERMID").alias("permid"), F.col("NAME").alias("name"), *fix.SLOT_MONTHS,
        F.col("_URI").alias("reference_order"),
    )


CORRECTION_DAYS = """correction_days AS (
  SELECT combined_number, month, days FROM (
    SELECT combined_number, month, days,
           row_number() OVER (PARTITION BY combined_number, month ORDER BY ord DESC, slot DESC) AS rn
    FROM (
      SELECT r.combined_number, k.ord, 1 AS slot, f.m1 AS month, k.d1 AS days
      FROM corrections k JOIN roster_rows r USING (name, permid) JOIN months f USING (permid)
      UNION ALL
      SELECT r.combined_number, k.ord, 2, f.m2, k.d2
      FROM corrections k JOIN roster_rows r USING (name, permid) JOIN months f USING (permid)
      UNION ALL
      SELECT r.combined_number, k.ord, 3, f.m3, k.d3
      FROM corrections k JOIN roster_rows r USING (name, permid) JOIN months f USING (permid)))
  WHERE rn = 1)"""
MONTHS = """months AS (
  SELECT permid, m1, m2, m3 FROM student_form f JOIN class_form c ON f.class_uuid = c.class_uuid)"""


def correction_days(t: Tables) -> DataFrame:
    matched = fix.match_corrections(typed_corrections(t), roster_rows(t), "student_order")
    monthed = fix.with_reference_months(matched, reference_months(t), "reference_order")
    return fix.correction_days(monthed, "correction_order")


def _order_flags(t: Tables) -> DataFrame:
    """Orders as flagged days: the first phase ends with 1998."""
    people = views.students(t).select("student_id", "combined_number")
    return views.order_days(t).join(people, "student_id").select(
        "o_orderkey", "combined_number", "date", (F.col("priority") == "5-LOW").alias("absent"),
        F.when(F.year("date") <= 1998, 1).otherwise(2).alias("phase"),
    )


FLAGS = ",\n".join([
    ROSTER_ROWS, CORRECTIONS, views.CLASS_FORM, views.STUDENT_FORM, MONTHS, CORRECTION_DAYS,
    views.STUDENTS, views.ORDER_DAYS,
])


@query("corrected_flags", f"""WITH {FLAGS}
SELECT o_orderkey, s.combined_number, o.date,
       CASE WHEN k.days IS NOT NULL THEN list_contains(k.days, day(o.date))
            ELSE o.priority = '5-LOW' END AS absent,
       CASE WHEN year(o.date) <= 1998 THEN 1 ELSE 2 END AS phase
FROM order_days o JOIN students s USING (student_id)
LEFT JOIN correction_days k ON k.combined_number = s.combined_number AND k.month = month(o.date)
  AND year(o.date) <= 1998""")
def corrected_flags(t: Tables) -> DataFrame:
    """Flags reset in corrected months, listed days set; first phase only."""
    return fix.correct_flags(_order_flags(t), correction_days(t))


@query("corrected_months", f"""WITH {FLAGS}
SELECT o_orderkey, s.combined_number, o.date,
       CASE WHEN k.days IS NOT NULL THEN list_contains(k.days, day(o.date))
            ELSE o.priority = '5-LOW' END AS absent,
       CASE WHEN year(o.date) <= 1998 THEN 1 ELSE 2 END AS phase
FROM order_days o JOIN students s USING (student_id)
LEFT JOIN correction_days k ON k.combined_number = s.combined_number AND k.month = month(o.date)
  AND year(o.date) <= 1998""")
def corrected_months(t: Tables) -> DataFrame:
    """Attendance stored by month; corrections rewrite the months that hold a corrected row."""
    path = session.new_shared_path(t.spark, "attendance")
    stored.write(_order_flags(t), path)
    return stored.correct(t.spark, path, correction_days(t))


@query("corrected_flags_all_years", f"""WITH {FLAGS}
SELECT o_orderkey, s.combined_number, o.date,
       CASE WHEN k.days IS NOT NULL THEN list_contains(k.days, day(o.date))
            ELSE o.priority = '5-LOW' END AS absent,
       CASE WHEN year(o.date) <= 1998 THEN 1 ELSE 2 END AS phase
FROM order_days o JOIN students s USING (student_id)
LEFT JOIN correction_days k ON k.combined_number = s.combined_number AND k.month = month(o.date)""")
def corrected_flags_all_years(t: Tables) -> DataFrame:
    """The same with a corrected month number applied in every year."""
    return fix.correct_flags(_order_flags(t), correction_days(t), phase=None)


@query("corrected_panel", f"""WITH {ATTENDANCE},
{ROSTER_ONLY}, {CORRECTIONS}, {MONTHS}, {CORRECTION_DAYS}
SELECT a.combined_number, a.date, a.phase, CAST(day(a.date) AS INTEGER) AS day,
       CAST(month(a.date) AS INTEGER) AS month,
       CASE WHEN k.days IS NOT NULL THEN list_contains(k.days, day(a.date)) ELSE a.absent END AS absent
FROM attendance a
LEFT JOIN correction_days k ON k.combined_number = a.combined_number AND k.month = month(a.date)
  AND a.phase = 1""")
def corrected_panel(t: Tables) -> DataFrame:
    """Two-phase attendance after all corrections."""
    rows = panel.attendance_rows(both_calendars(t), correction_days(t))
    return rows.withColumns({"day": F.dayofmonth("date"), "month": F.month("date")})


# --- roster and census ------------------------------------------------------

def eligible(t: Tables) -> DataFrame:
    classes = phase_one.eligible_classes(views.class_form(t), views.school_form(t))
    return phase_one.eligible_students(views.student_form(t), classes)


@query("roster", f"""WITH {views.PHASE_ONE}, {views.IDS}
SELECT CASE district_code WHEN 1 THEN 'Manhiça' WHEN 2 THEN 'Magude' END AS district,
       e.student_id, e.school_name, e.name,
       CASE gender_code WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS gender,
       e.grade, e.class_name, e.dob, e.permid, i.district_number, i.school_number,
       i.student_number, i.combined_number
FROM eligible e LEFT JOIN ids i ON e.name = i.name AND e.permid = i.permid""")
def roster(t: Tables) -> DataFrame:
    """Students of the panel joined to their id numbers on all shared attributes."""
    rows = phase_one.roster(eligible(t), views.ids(t))
    return rows.toDF(*[c.lower() for c in rows.columns])


def census_members(t: Tables) -> DataFrame:
    """First census: customers as members; households come from their nation's suppliers."""
    key = F.col("c_custkey")
    return t("customer").select(
        F.concat(F.lpad(key.cast("string"), 12, "0"), F.lit("-01")).alias("PERM_ID_MEMBER"),
        F.concat(F.date_add(F.to_date(F.lit("1990-01-01")), (key % 4000).cast("int")).cast("string"),
                 F.lit("T00:00:00")).alias("BIRTH_MEMBER"),
        (key % 3 + 1).cast("string").alias("MEMBER_GENDER"),
        F.col("c_name").alias("MEMBER_NAME"),
        F.col("c_nationkey").cast("string").alias("HOUSEHOLD_NUMBER"),
    )


def census_households(t: Tables) -> DataFrame:
    per_nation = t("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return per_nation.select(
        F.col("s_nationkey").cast("string").alias("HOUSEHOLD_HEAD_AGREG_NUM"),
        (F.lit(32.0) + F.col("s_nationkey") / 100).alias("HOUSEHOLD_HEAD_GPS_LNG"),
        (F.lit(-25.0) - F.col("n") / 1000).alias("HOUSEHOLD_HEAD_GPS_LAT"),
    )


def census_individuals(t: Tables) -> DataFrame:
    """Second census: suppliers as individuals, numbered like customers."""
    key = F.col("s_suppkey")
    return t("supplier").select(
        F.concat(F.lpad(key.cast("string"), 12, "0"), F.lit("-01")).alias("lastName"),
        F.col("s_name").alias("firstName"),
        F.when(key % 3 == 0, "M").when(key % 3 == 1, "F").otherwise("?").alias("gender"),
        F.date_add(F.to_date(F.lit("1980-01-01")), (key % 4000).cast("int")).alias("dob"),
    )


def census_coordinates(t: Tables) -> DataFrame:
    """UTM positions of the households; poor households have none."""
    key, known = F.col("s_suppkey"), F.col("s_acctbal") > 0
    house = F.substring(F.lpad(key.cast("string"), 12, "0"), 1, 8)
    return t("supplier").groupBy(house.alias("house_number")).agg(
        F.min(F.when(known, F.lit(450000.0) + key % 1000 * 100)).alias("lng"),
        F.min(F.when(known, F.lit(7180000.0) + key % 1000 * 100)).alias("lat"),
    )


def census(t: Tables) -> DataFrame:
    return linkage.unite_census([
        linkage.individual_census(census_individuals(t), census_coordinates(t), "second"),
        linkage.member_census(census_members(t), census_households(t), "first"),
    ])


CENSUS = f"""members AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') || '-01' AS permid,
         DATE '1990-01-01' + CAST(c_custkey % 4000 AS INTEGER) AS dob,
         CASE c_custkey % 3 + 1 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS gender,
         CAST(c_nationkey AS VARCHAR) AS house_number,
         32.0 + s_nationkey / 100e0 AS lng, -25.0 - n / 1000e0 AS lat, 'first' AS geo
  FROM customer
  LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey),
individuals AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') || '-01' AS permid,
         DATE '1980-01-01' + CAST(s_suppkey % 4000 AS INTEGER) AS dob,
         CASE s_suppkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender,
         left(lpad(CAST(s_suppkey AS VARCHAR), 12, '0'), 8) AS house_number, 'second' AS geo
  FROM supplier),
coordinates AS (
  SELECT left(lpad(CAST(s_suppkey AS VARCHAR), 12, '0'), 8) AS house_number,
         min(CASE WHEN s_acctbal > 0 THEN 450000e0 + s_suppkey % 1000 * 100 END) AS easting,
         min(CASE WHEN s_acctbal > 0 THEN 7180000e0 + s_suppkey % 1000 * 100 END) AS northing
  FROM supplier GROUP BY 1),
placed AS ({utm_sql('easting', 'northing', 'coordinates', 'house_number')}),
census AS (
  SELECT permid, dob, gender, house_number, geo, lng, lat FROM individuals LEFT JOIN placed USING (house_number)
  UNION ALL
  SELECT permid, dob, gender, house_number, geo, lng, lat FROM members
  WHERE permid NOT IN (SELECT permid FROM individuals))"""


@query("linked_census", f"""WITH {views.STUDENT_FORM}, {CENSUS}
SELECT s.uri AS student_id, s.permid,
       CASE gender_code WHEN 1 THEN 'MALE' WHEN 2 THEN 'FEMALE' END AS gender,
       c.dob AS census_dob, c.house_number, c.geo,
       round(c.lng, 6) AS lng, round(c.lat, 6) AS lat
FROM student_form s
LEFT JOIN census c ON s.permid = c.permid
  AND upper(c.gender) = CASE gender_code WHEN 1 THEN 'MALE' WHEN 2 THEN 'FEMALE' END""")
def linked_census(t: Tables) -> DataFrame:
    """Two censuses harmonised, united and linked to the students."""
    pupils = views.student_form(t).select(
        F.col("_URI").alias("student_id"), "PERMID",
        F.when(F.col("GENDER") == 1, "Male").when(F.col("GENDER") == 2, "Female").alias("gender"),
    )
    linked = linkage.link_exact(pupils, census(t))
    return linked.select(
        "student_id", F.col("PERMID").alias("permid"), "gender", F.col("dob").alias("census_dob"),
        "house_number", "geo",
        F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"),
    )


@query("school_dimension", f"""WITH {ROSTER_ROWS}
SELECT r.school_name, left(combined_number, 2) AS district_number,
       substr(combined_number, 4, 2) AS school_number,
       count(DISTINCT combined_number) AS n_students, any_value(n) AS n_suppliers
FROM roster_rows r
LEFT JOIN (SELECT 'school ' || {pad('s_nationkey', 2)} AS school_name, count(*) AS n
           FROM supplier GROUP BY 1) s USING (school_name)
WHERE r.school_name <> 'school 07' GROUP BY 1, 2, 3""")
def school_dimension(t: Tables) -> DataFrame:
    """One row per school: distinct students and the school's attributes."""
    from rollbook.functions import keys

    pupils = roster_rows(t).select(
        "combined_number", "SCHOOL_NAME",
        keys.district_of(F.col("combined_number")).alias("district_number"),
        keys.school_of(F.col("combined_number")).alias("school_number"),
    )
    places = t("supplier").groupBy(
        F.concat(F.lit("school "), keys.zero_pad(F.col("s_nationkey"))).alias("SCHOOL_NAME")
    ).agg(F.count(F.lit(1)).alias("n_suppliers"))
    rows = quality.school_dimension(
        pupils, places, [F.col("district_number"), F.col("school_number")], "school 07"
    )
    return rows.withColumnRenamed("SCHOOL_NAME", "school_name")


@query("union_sources", """
SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_acctbal AS balance,
       c_mktsegment AS segment, NULL::DOUBLE AS price FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL, NULL FROM supplier
UNION ALL SELECT 'part', p_partkey, p_name, NULL, NULL, p_retailprice FROM part""")
def union_sources(t: Tables) -> DataFrame:
    """Union of three sources with differing columns and a literal tag."""
    frames = [
        t("customer").select(
            F.lit("customer").alias("source"), F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("segment"),
        ),
        t("supplier").select(
            F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
        ),
        t("part").select(
            F.lit("part").alias("source"), F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        ),
    ]
    return joins.union_all(frames, fill_missing=True)


@query("tagged_slots", """
SELECT CAST(o_custkey AS VARCHAR) AS parent, CAST(o_orderkey % 32 AS INTEGER) AS day,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS slot
FROM orders""")
def tagged_slots(t: Tables) -> DataFrame:
    """Three month tables united under a slot tag."""
    return phase_one.slot_rows(views.slot_tables(t))
