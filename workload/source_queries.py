"""Files in and out: each query writes a derived file set to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rollbook import session
from rollbook.operators.dedupe import keep_first
from rollbook.sources import forms, store
from workload.base import Tables, query
from workload.composite_queries import correction_rows

CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def written(t: Tables, df: DataFrame, label: str, form: str) -> str:
    """Write ``df`` as one form folder below a fresh folder; returns the outer folder."""
    folder = session.new_shared_path(t.spark, label)
    store.write_csv(df, f"{folder}/{form}")
    return folder


@query("ingest_roundtrip", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def ingest_roundtrip(t: Tables) -> DataFrame:
    """A form written as CSV with empty rows and read under its schema without them."""
    people = t("customer")
    empty = people.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in people.schema])
    folder = written(t, people.unionByName(empty), "forms", "customer")
    return forms.read_form(t.spark, f"{folder}/customer", CUSTOMER_SCHEMA)


@query("ingest_as_text", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer""")
def ingest_as_text(t: Tables) -> DataFrame:
    """The same with one column forced to text."""
    folder = written(t, t("customer"), "text", "customer")
    return forms.read_form(t.spark, f"{folder}/customer", CUSTOMER_SCHEMA, as_text=["c_custkey"])


@query("read_id_lists", """
SELECT * EXCLUDE (rn) FROM (
  SELECT o_custkey, o_orderkey, o_orderstatus,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def read_id_lists(t: Tables) -> DataFrame:
    """Several lists of different column order united, one row per id."""
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    early = F.col("o_orderkey") % 3 == 0
    folder = written(t, rows.filter(early), "ids", "lists/first")
    turned = rows.filter(~early).select("o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey")
    store.write_csv(turned, f"{folder}/lists/second")
    return forms.read_multi(
        t.spark, f"{folder}/lists/*",
        "o_custkey bigint, o_orderkey bigint, o_orderstatus string, o_totalprice double",
        ["o_custkey", "o_orderkey", "o_orderstatus"], "o_custkey", [F.col("o_orderkey")],
    )


@query("ingest_directory", """
SELECT 'orders' AS form, CAST(o_orderkey AS VARCHAR) AS id, 'say "' || o_orderpriority || '", ' || o_orderstatus AS note,
       o_totalprice AS amount FROM orders
UNION ALL
SELECT 'customer_file', CAST(c_custkey AS VARCHAR), c_name || chr(10) || c_mktsegment, c_acctbal FROM customer
UNION ALL
SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier""")
def ingest_directory(t: Tables) -> DataFrame:
    """A directory of forms: reordered headers, quotes, commas, line breaks, failed values."""
    note = F.concat(F.lit('say "'), "o_orderpriority", F.lit('", '), "o_orderstatus")
    orders = t("orders").select(F.col("o_totalprice").alias("amount"), note.alias("note"), F.col("o_orderkey").alias("id"))
    folder = written(t, orders, "directory", "Orders.csv")
    people = t("customer").select(
        F.col("c_custkey").alias("id"), F.concat_ws("\n", "c_name", "c_mktsegment").alias("note"), F.col("c_acctbal").alias("amount"),
    )
    store.write_csv(people, f"{folder}/customer file.csv")
    sellers = t("supplier").select(F.col("s_name").alias("note"), F.col("s_suppkey").alias("id"), F.lit("n/a").alias("amount"))
    store.write_csv(sellers, f"{folder}/supplier")
    schema = "id string, note string, amount double"
    names = ("orders", "customer_file", "supplier")
    read = forms.read_forms(t.spark, folder, {n: schema for n in names}, multi_line=["customer_file"])
    frames = [read[n].select(F.lit(n).alias("form"), "id", "note", "amount") for n in names]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("correction_sheets", """
SELECT c_name AS NAME, 'p' || CAST(o_orderkey AS VARCHAR) AS permids,
       DATE '1899-12-30' + CAST(36526 + o_orderkey % 3000 AS INTEGER) AS dobs,
       CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS grades,
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS class_names,
       CAST(o_orderkey % 2 AS INTEGER) AS sheet,
       row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS place
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def correction_sheets(t: Tables) -> DataFrame:
    """Two sheets of different columns, each with a title and a repeated header, typed."""
    rows = t("orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").join(
        t("customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    key = F.col("o_orderkey")
    texts = rows.select(
        key, F.col("c_name").alias("NAME"), F.concat(F.lit("p"), key.cast("string")).alias("permids"),
        (36526 + key % 3000).cast("string").alias("dobs"),
        F.when(key % 5 != 0, (key % 7).cast("string")).otherwise("?").alias("grades"), F.col("o_orderstatus").alias("class_names"),
    )
    folder = session.new_shared_path(t.spark, "sheets")
    paths = []
    for sheet, columns in enumerate((["NAME", "permids", "dobs", "grades"], ["permids", "class_names", "NAME", "dobs"])):
        head = t.spark.range(2).select(
            (F.col("id") - 10).alias("o_orderkey"), *(F.when(F.col("id") == 1, c).otherwise("title").alias(c) for c in columns),
        )
        body = texts.filter(key % 2 == sheet).select("o_orderkey", *columns)
        sheet_rows = head.unionByName(body).repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
        paths.append(f"{folder}/sheet-{sheet}")
        store.write_csv(sheet_rows.drop("o_orderkey"), paths[-1])
    typed = forms.type_corrections(forms.read_sheets(t.spark, paths))
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("correction_order"))
    return typed.select("NAME", "permids", "dobs", "grades", "class_names", "sheet", place.cast("bigint").alias("place"))


@query("read_reference_table", """
SELECT CAST(s_suppkey AS VARCHAR) AS house_number, s_name AS region, s_acctbal AS lat FROM supplier""")
def read_reference_table(t: Tables) -> DataFrame:
    """A reference table whose columns are named by position."""
    folder = written(t, t("supplier").select("s_suppkey", "s_name", "s_acctbal"), "places", "places")
    return forms.read_table(
        t.spark, f"{folder}/places", ["house_number", "region", "lat"],
        "house_number string, region string, lat double",
    )


@query("snapshot_cache", """
SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def snapshot_cache(t: Tables) -> DataFrame:
    """A result computed and saved once for these orders, then loaded."""
    path = session.new_shared_path(t.spark, "snapshot")
    depends = {"inputs": [f"{t.folder}/orders.parquet"], "parameters": {"by": "o_orderstatus"}}
    compute = lambda: t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    store.cached(t.spark, path, compute, **depends)
    return store.cached(t.spark, path, compute, **depends)


@query("first_entered", """
SELECT o_custkey, CAST(arg_min(o_orderkey, o_orderkey) AS VARCHAR) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus
FROM orders GROUP BY 1""")
def first_entered(t: Tables) -> DataFrame:
    """Of customers filed several times in a form of many parts, the row entered first."""
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_custkey").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
    folder = written(t, rows, "entered", "orders")
    form = forms.read_form(t.spark, f"{folder}/orders", "o_custkey bigint, o_orderkey string, o_orderstatus string", entered="__entered")
    return keep_first(form, ["o_custkey"], [F.col("__entered")]).drop("__entered")


@query("typed_corrections", """
SELECT c_name AS NAME, lpad(CAST(o_custkey AS VARCHAR), 12, '0') || '-01' AS permids,
       CASE WHEN o_orderkey % 3 = 0
            THEN DATE '1899-12-30' + CAST(36526 + o_orderkey % 3000 AS INTEGER) END AS dobs,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS grades
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""")
def typed_corrections(t: Tables) -> DataFrame:
    """Corrections from text: spreadsheet dates, numeric grades, garbage rows dropped."""
    rows = correction_rows(t)
    garbage = rows.withColumn("permids", F.lit(None).cast("string"))
    typed = forms.type_corrections(rows.unionByName(garbage))
    return typed.select("NAME", "permids", "dobs", "grades")
