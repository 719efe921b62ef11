"""Wide-to-long reshaping, class calendars and mark statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook import constants as K
from rollbook.functions import recode
from rollbook.operators import joins, reshape
from rollbook.plans import study
from workload.base import Tables, query, rounded
from workload.views import STUDENTS, students

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("long_measures", f"""
SELECT l_orderkey, l_linenumber, measure, amount
FROM (SELECT l_orderkey, l_linenumber, {', '.join(MEASURES)} FROM lineitem)
UNPIVOT (amount FOR measure IN ({', '.join(MEASURES)}))""")
def long_measures(t: Tables) -> DataFrame:
    """A column range of a wide table as key and value."""
    return reshape.to_long(
        t("lineitem"), ["l_orderkey", "l_linenumber"], MEASURES, "measure", "amount"
    )


MARKS = {
    "evaluation_avaliation_a_term_mt_quantity_2015": "l_quantity",
    "evaluation_avaliation_b_term_ap_price_2015": "CASE WHEN l_discount > 0 THEN l_extendedprice END",
    "evaluation_avaliation_c_term_discount_2015": "l_discount",
    "evaluation_avaliation_d_term_mt_tax_2016": "l_tax",
}


def wide_marks(t: Tables) -> DataFrame:
    """Lines as records with four evaluation columns."""
    return t("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", *[f"{sql} AS {name}" for name, sql in MARKS.items()]
    )


MARK_ROWS = """marks AS (
  SELECT l_orderkey, l_linenumber, 2015 AS year, 1 AS trimester, 'MT' AS period,
         '_term_quantity_' AS subject, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 2015, 2, 'AP', '_term_price_', l_extendedprice
  FROM lineitem WHERE l_discount > 0
  UNION ALL SELECT l_orderkey, l_linenumber, 2015, 3, NULL, '_term_discount_', l_discount FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 2016, 4, 'MT', '_term_tax_', l_tax FROM lineitem)"""


def marks(t: Tables) -> DataFrame:
    wide = wide_marks(t)
    return reshape.marks_long(wide, ["l_orderkey", "l_linenumber"], reshape.mark_columns(wide))


@query("marks_long", f"WITH {MARK_ROWS} SELECT * FROM marks WHERE value IS NOT NULL")
def marks_long(t: Tables) -> DataFrame:
    """Evaluation columns to year, trimester, period, subject and value."""
    return marks(t)


PLACED = MARK_ROWS + ",\n" + STUDENTS + """,
placed AS (
  SELECT marks.*, district FROM marks JOIN orders ON l_orderkey = o_orderkey
  JOIN students ON o_custkey = student_id)"""


def placed_marks(t: Tables) -> DataFrame:
    """Marks with their student's district; the wide records are joined, not the long rows."""
    people = students(t).select(F.col("student_id").alias("o_custkey"), "district")
    owners = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    wide = wide_marks(t).join(owners, "l_orderkey").join(people, "o_custkey")
    return reshape.marks_long(wide, ["district"], reshape.mark_columns(wide))


@query("marks_mean", f"""WITH {PLACED}
SELECT CASE WHEN grouping(trimester) = 0 AND grouping(subject) = 0 THEN 'trimester+subject+district'
            WHEN grouping(trimester) = 0 THEN 'trimester+district'
            WHEN grouping(subject) = 0 THEN 'year+subject+district' ELSE 'year+district' END AS level,
       trimester, subject, district, year, round(avg(value), 6) AS mean_value, count(*) AS n_marks
FROM placed
GROUP BY GROUPING SETS ((trimester, subject, district), (trimester, district),
                        (year, subject, district), (year, district))""")
def marks_mean(t: Tables) -> DataFrame:
    """Mean mark by trimester or year, with and without subject, per district."""
    return rounded(reshape.mark_means(placed_marks(t)), "mean_value")


@query("marks_quantiles", f"""WITH {PLACED}
SELECT CASE WHEN grouping(trimester) = 0 AND grouping(subject) = 0 THEN 'trimester+subject+district'
            WHEN grouping(trimester) = 0 THEN 'trimester+district'
            WHEN grouping(subject) = 0 THEN 'year+subject+district' ELSE 'year+district' END AS level,
       trimester, subject, district, year, round(min(value), 6) AS lowest, round(quantile_cont(value, 0.25), 6) AS q1,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
       round(max(value), 6) AS highest, count(value) AS n_values
FROM placed WHERE value IS NOT NULL
GROUP BY GROUPING SETS ((trimester, subject, district), (trimester, district),
                        (year, subject, district), (year, district))""")
def marks_quantiles(t: Tables) -> DataFrame:
    """Quartiles of marks by trimester or year, with and without subject, per district."""
    return rounded(reshape.mark_quantiles(placed_marks(t)), *reshape.QUARTILES)


@query("marks_histogram", f"""WITH {PLACED}
SELECT trimester, district, CAST(floor(value / 10e0) AS BIGINT) AS bin, count(*) AS n,
       floor(value / 10e0) * 10e0 AS bin_start
FROM placed GROUP BY ALL""")
def marks_histogram(t: Tables) -> DataFrame:
    """Distribution of marks by trimester and district in fixed bins."""
    return reshape.histogram(placed_marks(t), "value", 0.0, 10.0, ["trimester", "district"])


@query("performance", """
SELECT 'p' || l_orderkey AS combined_number, year, trimester, period, subject, value FROM (
  SELECT l_orderkey, 2015 AS year, 1 AS trimester, 'MT' AS period, '_term_quantity_' AS subject,
         l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, 2016, 4, 'AP', '_term_etica_', l_tax FROM lineitem
  WHERE l_linestatus = 'O')""")
def performance(t: Tables) -> DataFrame:
    """Two evaluation forms joined, suffixed by year and made long."""
    uri = F.concat_ws("/", *[F.col(c) for c in (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")])
    first = t("lineitem").select(
        uri.alias("uri"), F.concat(F.lit("p"), "l_orderkey").alias("combined_number"),
        F.col("l_quantity").alias("evaluation_avaliation_a_term_mt_quantity"),
    )
    second = t("lineitem").select(
        uri.alias("parent_auri"),
        F.when(F.col("l_linestatus") == "O", F.col("l_tax"))
        .alias("evaluation_avaliation_d_term_ap_day_off_august"),
    )
    return study.performance(first, second)


# --- class calendar ---------------------------------------------------------

def class_answers(t: Tables) -> DataFrame:
    """The wide class form: two answers per month, from the orders of the class."""
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.month("o_orderdate")
    counts = {
        name: F.count_if(month == number) for name, number in K.CALENDAR_MONTHS.items()
    }
    dear = {
        name: F.count_if((month == number) & (F.col("o_orderpriority") < "3"))
        for name, number in K.CALENDAR_MONTHS.items()
    }
    by_class = joined.groupBy("c_nationkey", "c_mktsegment").agg(
        *[c.alias(f"{m}_n") for m, c in counts.items()],
        *[c.alias(f"{m}_d") for m, c in dear.items()],
    )
    answers = []
    for m in K.CALENDAR_MONTHS:
        yes = f"{m}_info_if_yes" if m == "jun" else f"{m}_info_yes"
        n, d = F.col(f"{m}_n"), F.col(f"{m}_d")
        info = F.when(n % 7 != 0, n % 2 + 1).cast("int")
        answers += [
            info.alias(f"class_room_{m}_info"),
            (d % 2 + 1).cast("int").alias(f"class_room_{yes}"),
        ]
    return by_class.select(
        F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("uri"),
        F.col("c_nationkey").alias("class_room_school_code"), F.lit(1).alias("class_room_grade"),
        F.col("c_mktsegment").alias("class_room_class"),
        F.lit("none").alias("class_room_reason_text"), *answers,
    )


ANSWERS = """answers AS (
  SELECT uri, school_number, class, month, month_number,
         CAST(CASE WHEN n % 7 <> 0 THEN n % 2 + 1 END AS INTEGER) AS info,
         CAST(d % 2 + 1 AS INTEGER) AS info_yes
  FROM (
    SELECT c_nationkey || '/' || c_mktsegment AS uri, c_nationkey AS school_number,
           c_mktsegment AS class, m.month, m.month_number,
           count(*) FILTER (WHERE month(o_orderdate) = m.month_number) AS n,
           count(*) FILTER (WHERE month(o_orderdate) = m.month_number AND o_orderpriority < '3') AS d
    FROM orders JOIN customer ON o_custkey = c_custkey
    CROSS JOIN (VALUES ('fev', 2), ('march', 3), ('april', 4), ('may', 5), ('jun', 6)) m(month, month_number)
    GROUP BY ALL)),
acted AS (
  SELECT *, CASE WHEN info = 2 THEN 'not_usable'
                 WHEN info = 1 AND info_yes = 2 THEN 'lective_days'
                 WHEN info = 1 AND info_yes = 1 AND month IN ('fev', 'march', 'april') THEN 'days_off'
                 WHEN info = 1 AND info_yes = 1 AND month IN ('may', 'jun') THEN 'from_scratch' END AS action
  FROM answers)"""


def class_form(t: Tables) -> DataFrame:
    """The class form with columns chosen by pattern and their prefix removed."""
    return recode.select_matching(
        class_answers(t), keep="class_room", drop="reason",
        always=("uri", "school_code", "grade", "class"), strip="^class_room_",
        rename={"school_code": "school_number"},
    )


@query("select_columns", f"""WITH {ANSWERS}
SELECT uri, school_number, 1 AS grade, class,
       any_value(info) FILTER (WHERE month = 'april') AS april_info,
       any_value(info_yes) FILTER (WHERE month = 'april') AS april_info_yes,
       any_value(info) FILTER (WHERE month = 'fev') AS fev_info,
       any_value(info_yes) FILTER (WHERE month = 'fev') AS fev_info_yes,
       any_value(info) FILTER (WHERE month = 'jun') AS jun_info,
       any_value(info_yes) FILTER (WHERE month = 'jun') AS jun_info_if_yes,
       any_value(info) FILTER (WHERE month = 'march') AS march_info,
       any_value(info_yes) FILTER (WHERE month = 'march') AS march_info_yes,
       any_value(info) FILTER (WHERE month = 'may') AS may_info,
       any_value(info_yes) FILTER (WHERE month = 'may') AS may_info_yes
FROM answers GROUP BY uri, school_number, class""")
def select_columns(t: Tables) -> DataFrame:
    """Columns chosen by pattern, prefix removed, renamed and sorted."""
    return class_form(t)


def long_answers(t: Tables) -> DataFrame:
    form = class_form(t)
    keys = ["uri", "school_number", "grade", "class"]
    return reshape.to_long(form, keys, [c for c in form.columns if c not in keys])


@query("key_value_long", f"""WITH {ANSWERS}
SELECT uri, school_number, 1 AS grade, class, month || '_info' AS key, info AS value FROM answers
UNION ALL
SELECT uri, school_number, 1, class,
       month || CASE WHEN month = 'jun' THEN '_info_if_yes' ELSE '_info_yes' END, info_yes FROM answers""")
def key_value_long(t: Tables) -> DataFrame:
    """The class form as one row per answer."""
    return long_answers(t)


@query("yes_no_self_join", f"""WITH {ANSWERS}
SELECT uri, month, school_number, class, info, info_yes FROM answers""")
def yes_no_self_join(t: Tables) -> DataFrame:
    """Both answers of a class-month on one row, from the long form."""
    return reshape.yes_no_pairs(long_answers(t), ["uri"], ["school_number", "class"])


@query("class_actions", f"""WITH {ANSWERS}
SELECT school_number, 1 AS grade, class, month, month_number, info, info_yes, action,
       CASE month WHEN 'fev' THEN 'february_b' WHEN 'march' THEN 'march_b'
                  WHEN 'april' THEN 'april_b' WHEN 'may' THEN 'may' ELSE 'june' END AS month_symbol
FROM acted""")
def class_actions(t: Tables) -> DataFrame:
    """Class-months with month number, symbol and the action decided."""
    months = reshape.class_months(class_form(t))
    return months.withColumn("month_symbol", recode.recode(F.col("month"), K.CALENDAR_SYMBOLS))


@query("class_calendar", f"""WITH {ANSWERS},
days AS (
  SELECT CAST(d AS DATE) AS date
  FROM generate_series(TIMESTAMP '2016-01-01', TIMESTAMP '2016-12-31', INTERVAL 1 DAY) g(d)
  WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2016-05-01', DATE '2016-06-25'))
SELECT DISTINCT school_number, 1 AS grade, class, date
FROM acted JOIN days ON month(date) = month_number WHERE action <> 'not_usable'""")
def class_calendar(t: Tables) -> DataFrame:
    """School days of every class from the wide form."""
    return reshape.class_calendar(class_form(t))


@query("unresolved_months", f"""WITH {ANSWERS}
SELECT month, count(*) AS n FROM acted WHERE action IS NULL GROUP BY 1""")
def unresolved_months(t: Tables) -> DataFrame:
    """Class-months whose answers lead to no action."""
    return reshape.unresolved_months(reshape.class_months(class_form(t)))


@query("complete_class_months", f"""WITH {ANSWERS}
SELECT school_number, 1 AS grade, class, month, month_number, info, info_yes, action FROM acted
WHERE month NOT IN (SELECT month FROM acted a2 WHERE info IS NULL AND a2.school_number = acted.school_number)""")
def complete_class_months(t: Tables) -> DataFrame:
    """Months of a school count only if every class has answered."""
    from rollbook.operators import quality

    months = reshape.class_months(class_form(t))
    return quality.complete_groups(months, ["school_number", "month"], ["info", "info_yes"])


@query("parent_child", """
SELECT o.o_orderkey, o_custkey, o_orderstatus, l_linenumber, l_quantity
FROM orders o JOIN lineitem ON o.o_orderkey = l_orderkey""")
def parent_child(t: Tables) -> DataFrame:
    """Parent form joined to its child rows."""
    parent = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    child = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.parent_child(parent, child, "o_orderkey", "l_orderkey", drop=["o_totalprice"])
