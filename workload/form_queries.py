"""Projection, recodes, keys, dates, filters and joins on the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook import constants as K
from rollbook.functions import dates, geo, keys, recode
from rollbook.operators import joins, rates
from workload.base import Tables, pad, query, rounded, sunday_week
from workload.views import EVENT_DAYS, ORDER_DAYS, STUDENTS, event_days, order_days, students


@query("project_forms", """
SELECT c_custkey AS student_id, c_name AS name, c_mktsegment AS class FROM customer""")
def project_forms(t: Tables) -> DataFrame:
    """Column pruning and renaming."""
    return recode.project(
        t("customer"), {"c_custkey": "student_id", "c_name": "name", "c_mktsegment": "class"}
    )


@query("suffix_columns", """
SELECT p_partkey, p_name AS p_name_2015, p_brand, p_type, p_size, p_retailprice FROM part""")
def suffix_columns(t: Tables) -> DataFrame:
    """A suffix on every column whose name holds a token."""
    return recode.suffix_columns(t("part"), "name", "_2015")


@query("upper_columns", """
SELECT s_suppkey AS S_SUPPKEY, s_name AS S_NAME, s_nationkey AS S_NATIONKEY, s_acctbal AS S_ACCTBAL
FROM supplier""")
def upper_columns(t: Tables) -> DataFrame:
    """All column names in upper case."""
    return recode.upper_columns(t("supplier"))


@query("alias_columns", """
SELECT c_custkey, c_acctbal AS lng, c_acctbal AS longitude, c_acctbal AS x, c_acctbal AS lon,
       c_nationkey AS lat, c_nationkey AS latitude, c_nationkey AS y FROM customer""")
def alias_columns(t: Tables) -> DataFrame:
    """Coordinates repeated under their alias names."""
    from rollbook.operators.linkage import COORDINATE_ALIASES

    points = t("customer").select(
        "c_custkey", F.col("c_acctbal").alias("lng"), F.col("c_nationkey").alias("lat")
    )
    return recode.with_aliases(points, COORDINATE_ALIASES)


@query("ordered", """
SELECT p_brand, p_type, p_partkey FROM part ORDER BY p_brand, p_type, p_partkey DESC""")
def ordered(t: Tables) -> DataFrame:
    """Sort by several keys."""
    return joins.ordered(
        t("part").select("p_brand", "p_type", "p_partkey"), "p_brand", "p_type", F.desc("p_partkey")
    )


@query("spaced_labels", "SELECT n_name, replace(n_name, '_', ' ') AS label, c_custkey "
       "FROM nation JOIN customer ON c_nationkey = n_nationkey")
def spaced_labels(t: Tables) -> DataFrame:
    """Underscores of a label shown as spaces."""
    named = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = t("customer").select("c_custkey", "c_nationkey").join(named, "c_nationkey")
    return joined.select("n_name", recode.spaced(F.col("n_name")).alias("label"), "c_custkey")


CONDITIONS_SQL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.SCHOOL_CONDITIONS.items())
LATRINE_SQL = " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.TYPE_OF_LATRINE.items())


@query("recode_labels", f"""
SELECT p_partkey, CASE p_size % 10 {CONDITIONS_SQL} END AS conditions,
       CASE p_size % 7 {LATRINE_SQL} END AS latrine,
       CASE p_size % 3 WHEN 1 THEN true WHEN 2 THEN false END AS lunch,
       CASE p_size % 4 WHEN 1 THEN 'Manhiça' WHEN 2 THEN 'Magude' END AS district,
       CASE p_size % 3 WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS gender
FROM part""")
def recode_labels(t: Tables) -> DataFrame:
    """Coded answers to labels; unknown codes become NULL."""
    size = F.col("p_size")
    return t("part").select(
        "p_partkey",
        recode.recode(size % 10, K.SCHOOL_CONDITIONS).alias("conditions"),
        recode.recode(size % 7, K.TYPE_OF_LATRINE).alias("latrine"),
        recode.recode(size % 3, K.LUNCH).alias("lunch"),
        recode.recode(size % 4, K.DISTRICT).alias("district"),
        recode.recode(size % 3, K.GENDER).alias("gender"),
    )


@query("name_standard", """
SELECT s_suppkey, CASE WHEN n_regionkey < 3 THEN r_name END AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def name_standard(t: Tables) -> DataFrame:
    """Names replaced through a lookup of spellings; unknown spellings become NULL."""
    lookup = t("nation").filter("n_regionkey < 3").join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_name", "r_name")
    names = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    forms = t("supplier").select("s_suppkey", "s_nationkey").join(names, "s_nationkey")
    return recode.standardise_names(forms, lookup, "name", "n_name", "r_name").select(
        "s_suppkey", "name"
    )


@query("fill_default", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END, false) AS absent,
       coalesce(CASE WHEN o_orderpriority > '2' THEN o_orderpriority END, 'EPC xUngucha') AS school
FROM orders""")
def fill_default(t: Tables) -> DataFrame:
    """Missing labels and flags replaced by fixed values."""
    status = F.col("o_orderstatus")
    rows = t("orders").select(
        "o_orderkey", F.when(status != "P", status == "F").alias("absent"),
        F.when(F.col("o_orderpriority") > "2", F.col("o_orderpriority")).alias("school"),
    )
    return recode.fill_default(rows, {"absent": False, "school": K.MISSING_SCHOOL_NAME})


@query("composite_ids", f"""
SELECT o_orderkey,
       {pad('o_custkey % 12', 2)} || '-' || {pad('o_orderkey % 130', 2)} || '-' || {pad('o_custkey', 3)}
         AS combined_number
FROM orders""")
def composite_ids(t: Tables) -> DataFrame:
    """Ids of three padded parts."""
    raw = F.concat_ws("-", F.col("o_custkey") % 12, F.col("o_orderkey") % 130, "o_custkey")
    return t("orders").select("o_orderkey", keys.composite_id(raw).alias("combined_number"))


@query("split_ids", f"""WITH {STUDENTS}
SELECT combined_number, substr(combined_number, 1, 2) AS district_number,
       substr(combined_number, 4, 2) AS school,
       CASE CAST(substr(combined_number, 1, 2) AS INTEGER) WHEN 1 THEN 'Manhiça' WHEN 2 THEN 'Magude' END
         AS district_name,
       '0' || substr(combined_number, 2) AS repaired
FROM students""")
def split_ids(t: Tables) -> DataFrame:
    """District and school taken from the combined id."""
    combined = F.col("combined_number")
    number = keys.district_of(combined)
    return students(t).select(
        combined, number.alias("district_number"), keys.school_of(combined).alias("school"),
        recode.recode(number.try_cast("int"), K.DISTRICT).alias("district_name"),
        keys.repair_leading_zero(F.expr("substring(combined_number, 2)")).alias("repaired"),
    )


@query("class_labels", f"""WITH {STUDENTS}
SELECT combined_number, 'school:' || school_number || '-grade:' ||
       coalesce(CAST(nullif(grade, 3) AS VARCHAR), 'NA') || '-class:' || class_name AS class_number
FROM students""")
def class_labels(t: Tables) -> DataFrame:
    """Readable class names; missing parts show as NA."""
    label = keys.class_label(
        F.col("school_number"), F.nullif(F.col("grade"), F.lit(3)), F.col("class_name")
    )
    return students(t).select("combined_number", label.alias("class_number"))


@query("slot_dates", """
SELECT o_orderkey, TRY_CAST('2015-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' ||
                            lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) AS date
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN o_custkey % 12 + 1 WHEN 2 THEN o_custkey % 7 + 3
        WHEN 3 THEN CASE WHEN o_custkey % 5 + 1 = 1 THEN 9 ELSE o_custkey % 5 + 1 END END AS m FROM orders)""")
def slot_dates(t: Tables) -> DataFrame:
    """Month slot and day to a date; impossible days give NULL."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    date = dates.slot_date(key % 4, key % 33, owner % 12 + 1, owner % 7 + 3, owner % 5 + 1)
    return t("orders").select("o_orderkey", date.alias("date"))


@query("parse_dates", """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS iso,
       CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS named,
       make_date(2016, month(o_orderdate), day(o_orderdate)) AS spelled
FROM orders""")
def parse_dates(t: Tables) -> DataFrame:
    """Dates from an ISO prefix, from a short month name and from a long one."""
    good = F.col("o_orderkey") % 6 != 0
    day = F.col("o_orderdate").cast("date")
    iso = F.when(good, F.date_format(day, "yyyy-MM-dd'T'HH:mm")).otherwise("2015-02-30")
    named = F.when(good, F.upper(F.date_format(day, "dMMMyyyy"))).otherwise("31Feb2001")
    return t("orders").select(
        "o_orderkey", dates.iso_prefix_date(iso).alias("iso"),
        dates.day_month_name_date(named).alias("named"),
        dates.named_month_date(
            F.date_format(day, "MMMM"), F.dayofmonth(day), F.lit(2016)
        ).alias("spelled"),
    )


@query("excel_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0
       THEN DATE '1899-12-30' + CAST(30000 + o_orderkey % 12000 AS INTEGER) END AS date
FROM orders""")
def excel_dates(t: Tables) -> DataFrame:
    """Spreadsheet day numbers to dates."""
    key = F.col("o_orderkey")
    serial = F.when(key % 9 != 0, (F.lit(30000) + key % 12000).cast("string")).otherwise("n/a")
    return t("orders").select("o_orderkey", dates.excel_date(serial).alias("date"))


@query("calendar_fields", f"""WITH {ORDER_DAYS}
SELECT o_orderkey, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(day(date) AS INTEGER) AS day, strftime(date, '%Y-%m') AS year_month,
       CAST(date_trunc('month', date) AS DATE) AS month_start, {sunday_week('date')} AS year_week,
       CAST(isodow(date) - 1 AS INTEGER) AS weekday
FROM order_days""")
def calendar_fields(t: Tables) -> DataFrame:
    """Date parts used as grouping keys."""
    parts = dates.calendar_fields(F.col("date"))
    return order_days(t).select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query("weekday_rows", f"""WITH {ORDER_DAYS}
SELECT o_orderkey, date FROM order_days WHERE isodow(date) < 6""")
def weekday_rows(t: Tables) -> DataFrame:
    """Rows dated on weekdays."""
    return order_days(t).filter(dates.is_weekday(F.col("date"))).select("o_orderkey", "date")


@query("scaled_coords", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * 1e6 / 1e10, 6) AS lat FROM lineitem""")
def scaled_coords(t: Tables) -> DataFrame:
    """Scaled integer coordinates to degrees."""
    lat = geo.scale_degrees(F.col("l_extendedprice") * 1e6)
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", lat.alias("lat")), "lat")


@query("match_keys", """
SELECT c_custkey, upper(c_mktsegment) AS gender, substr(c_name, 1, 8) AS household FROM customer""")
def match_keys(t: Tables) -> DataFrame:
    """Case-folded gender and household number."""
    return t("customer").select(
        "c_custkey", keys.match_gender(F.lower(F.col("c_mktsegment"))).alias("gender"),
        keys.household_of(F.col("c_name")).alias("household"),
    )


@query("complete_rows", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority
FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def complete_rows(t: Tables) -> DataFrame:
    """Rows whose id and attributes are all known."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = t("orders").select(
        "o_orderkey", F.when(status != "P", status).alias("status"),
        F.when(priority != "5-LOW", priority).alias("priority"),
    )
    return joins.require(rows, ["status", "priority"])


@query("literal_excluded", """
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS name
FROM orders WHERE o_orderpriority <> '2-HIGH'""")
def literal_excluded(t: Tables) -> DataFrame:
    """One literal value dropped, missing values kept."""
    priority = F.col("o_orderpriority")
    rows = t("orders").select("o_orderkey", F.when(priority != "5-LOW", priority).alias("name"))
    return joins.without_value(rows, "name", "2-HIGH")


@query("exclude_listed", """
SELECT o_orderkey, o_custkey FROM orders
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)""")
def exclude_listed(t: Tables) -> DataFrame:
    """Rows whose key is not in a list."""
    bad = t("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.exclude_listed(t("orders").select("o_orderkey", "o_custkey"), bad, ["o_custkey"])


@query("semi_listed", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def semi_listed(t: Tables) -> DataFrame:
    """Rows whose key is in a computed list."""
    good = t("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return joins.keep_listed(t("orders").select("o_orderkey", "o_custkey"), good, ["o_custkey"])


@query("natural_join_nulls", """
SELECT f.priority, f.status, f.o_orderkey, d.n
FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority,
             nullif(o_orderstatus, 'P') AS status FROM orders) f
LEFT JOIN (SELECT nullif(o_orderpriority, '5-LOW') AS priority, nullif(o_orderstatus, 'P') AS status,
                  count(*) AS n FROM orders WHERE o_orderpriority <> '2-HIGH' GROUP BY 1, 2) d
  ON f.priority IS NOT DISTINCT FROM d.priority AND f.status IS NOT DISTINCT FROM d.status""")
def natural_join_nulls(t: Tables) -> DataFrame:
    """Left join on all shared columns; a missing value matches a missing value."""
    facts = t("orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
    )
    groups = facts.filter("priority IS NULL OR priority <> '2-HIGH'").groupBy(
        "priority", "status"
    ).agg(F.count(F.lit(1)).alias("n"))
    return joins.natural_left_join(facts, groups, null_safe=True)


@query("enrich_facts", """
SELECT l_orderkey, l_linenumber, l_quantity, s_name, n_name FROM lineitem
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def enrich_facts(t: Tables) -> DataFrame:
    """Facts with the attributes of two dimensions."""
    teachers = joins.left_join(
        t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name",
                             F.col("s_nationkey").alias("n_nationkey")),
        t("nation").select("n_nationkey", "n_name"), ["n_nationkey"],
    )
    facts = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return joins.left_join(facts, teachers, ["l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "s_name", "n_name"
    )


@query("composite_key_join", f"""WITH {STUDENTS},
classes AS (
  SELECT school_number, class_name, count(*) AS n_students FROM students GROUP BY ALL)
SELECT combined_number, students.school_number, students.class_name, n_students
FROM students LEFT JOIN classes USING (school_number, class_name)""")
def composite_key_join(t: Tables) -> DataFrame:
    """Students with their class, joined on school and class."""
    rows = students(t).select("combined_number", "school_number", "class_name")
    classes = rows.groupBy("school_number", "class_name").agg(
        F.count(F.lit(1)).alias("n_students")
    )
    return joins.left_join(rows, classes, ["school_number", "class_name"])


@query("flag_join", f"""WITH {ORDER_DAYS}
SELECT o_orderkey, student_id, date, EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS absent
FROM order_days""")
def flag_join(t: Tables) -> DataFrame:
    """Rows flagged where a matching event exists."""
    returned = t("lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    rows = order_days(t).select("o_orderkey", "student_id", "date")
    return joins.flag_join(rows, returned, ["o_orderkey"])


@query("cumulative_snapshots", f"""WITH {EVENT_DAYS}, {STUDENTS},
daily AS (
  SELECT date, district, count(*) FILTER (WHERE absent) AS absences, count(*) AS eligibles,
         round(count(*) FILTER (WHERE absent) * 100e0 / count(*), 6) AS absenteeism_rate
  FROM event_days JOIN students ON user_id = student_id GROUP BY 1, 2)
SELECT s.observation_date, d.*, d.date = s.observation_date AS today
FROM daily d JOIN (SELECT DISTINCT date AS observation_date FROM daily) s
  ON d.date <= s.observation_date""")
def cumulative_snapshots(t: Tables) -> DataFrame:
    """For each observed day, the daily district rates up to it."""
    people = students(t).select(F.col("student_id").alias("user_id"), "district")
    daily = rates.rate_by(event_days(t).join(people, "user_id"), ["date", "district"])
    return joins.cumulative_snapshots(rounded(daily.drop("presences"), "absenteeism_rate"))
