"""Survey forms, id lists, lookup tables and correction sheets from files."""

from __future__ import annotations

import csv
import posixpath
import re
from collections.abc import Collection, Iterator, Mapping, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rollbook import constants as K, session
from rollbook.functions import dates
from rollbook.operators.dedupe import keep_first

#: Schemes of paths that tasks open as files of the machine or of a mounted share.
OPENED = ("file",)
#: Bytes read at once for the first line of a file.
HEADER_BYTES = 1 << 14


def table_name(path: str) -> str:
    """Lower-cased file name without its ending, blanks as underscores."""
    stem = re.sub(r"\.(csv|parquet)$", "", posixpath.basename(path.rstrip("/")), flags=re.I)
    return stem.lower().replace("%20", " ").replace(" ", "_")


def _plain(path: str) -> str:
    """A path without its scheme and host."""
    return re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)


def _scheme(spark: SparkSession, path: str) -> str:
    """The kind of file system a path lies in, the default one if it names none."""
    named = re.match("([A-Za-z][A-Za-z0-9+.-]*):", path)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return named[1] if named else default.split(":")[0]


def form_files(spark: SparkSession, directory: str) -> dict[str, str]:
    """Table name to path for the forms of a directory: CSV files, and folders of them.

    Names only: the file source prunes the content column, on any file system.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True).load(directory).select("path")
    )
    # One name for each form, however many parts its folder has.
    form = F.regexp_extract(F.col("path"), re.escape(_plain(directory).strip("/")) + "/+([^/]+)", 1).alias("form")
    found: dict[str, str] = {}
    for r in files.select(form).distinct().sort("form").toLocalIterator():
        path = f"{directory.rstrip('/')}/{r.form}"
        if found.setdefault(table_name(r.form), path) != path:
            raise ValueError(f"{found[table_name(r.form)]} and {path} are both named {table_name(r.form)}")
    return found


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows in which at least one column has a value."""
    return df.dropna(how="all")


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, read): the first line of each file, and the bytes read for it.

    Files are listed by their names and opened in tasks; a file is read up to the end of
    its first line, whatever its size. Empty files give no row. Where tasks cannot open
    files by themselves (:data:`OPENED`), Spark's text reader scans them instead.
    """
    if _scheme(spark, path) not in OPENED:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_size").alias("size"),
            F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        )
        return lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), F.first("size").alias("read"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, name in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist()):
                with open(_plain(name), "rb", buffering=0) as stream:
                    held = b""
                    while b"\n" not in held and (more := stream.read(HEADER_BYTES)):
                        held += more
                if held:
                    line = held.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig", "replace")
                    rows.append((file, line, len(held)))
            columns = zip(*rows) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["file", "header", "read"])

    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "path")
    return names.mapInArrow(read, "file string, header string, read long")


def read_text_columns(
    spark: SparkSession, path: str, multi_line: bool = False, entered: str | None = None
) -> DataFrame:
    """CSV files with a header as text columns, each file by the names in its own header.

    Only the distinct headers reach the driver. Files of one header are read as they are;
    where headers differ, all files are read once by position and each row is named by the
    header of its file. A doubled quote inside quotes is a quote; ``multi_line`` allows line
    breaks in cells, at the price of unsplit files. ``entered`` names a column that sorts
    rows as they were entered: file by file, block by block, line by line.
    """
    heads = first_lines(spark, path)
    headers = [r.header for r in heads.select("header").distinct().sort("header").toLocalIterator()]
    named = [next(csv.reader([h])) if h else [] for h in headers]
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    )
    if not named:
        return spark.createDataFrame([], StructType()).select(*([place_of_nothing().alias(entered)] if entered else []))
    alike = len(named) == 1
    positions = named[0] if alike else [f"__{k}" for k in range(max(map(len, named)))]
    kinds = StructType([StructField(n, StringType()) for n in positions])
    reader = spark.read.schema(kinds).option("header", True).option("escape", '"').option("multiLine", multi_line)
    rows = reader.csv(path).select(*(F.col(f"`{n}`") for n in positions), place.alias("__at"))
    own = [F.col("__at").alias(entered)] if entered else []
    if alike:
        return rows.select(*(F.col(f"`{n}`") for n in positions), *own)
    numbers = F.create_map(*(F.lit(v) for k, h in enumerate(headers) for v in (h, k)))
    of_file = heads.select(F.col("file").alias("__file"), numbers[F.col("header")].alias("__header"))
    rows = rows.join(of_file, F.col("__at.file") == F.col("__file"))

    def column(name: str) -> Column:
        """The position that each header has the name at."""
        out = F
        for k, names in enumerate(named):
            if name in names:
                out = out.when(F.col("__header") == k, F.col(f"__{names.index(name)}"))
        return out.alias(name)

    return rows.select(*(column(n) for n in dict.fromkeys(n for names in named for n in names)), *own)


def place_of_nothing() -> Column:
    return F.lit(None).cast("struct<file:string,block:bigint,row:bigint>")


def _kinds(schema: StructType | str, as_text: Sequence[str] = ()) -> dict[str, str]:
    given = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return {f.name: "string" if f.name in as_text else f.dataType.simpleString() for f in given}


def _typed(raw: DataFrame, kinds: Mapping[str, str], also: Sequence[str] = ()) -> DataFrame:
    """The named columns by name; values that do not parse and absent columns are NULL."""
    return raw.select(*(
        (F.col(f"`{n}`").try_cast(k) if n in raw.columns else F.lit(None).cast(k)).alias(n)
        for n, k in kinds.items()
    ), *also)


def read_form(
    spark: SparkSession, path: str, schema: StructType | str | None = None,
    as_text: Sequence[str] = (), multi_line: bool = False, entered: str | None = None,
) -> DataFrame:
    """One form, a file or a folder of files. Without a schema all columns are text, so
    no code loses its zeros; ``as_text`` turns single columns of a given schema into text.

    Columns are found by name. A value that does not parse is NULL;
    :func:`failed_casts` counts these. ``entered`` adds a column that sorts rows in the
    order in which they were entered, for :func:`rollbook.operators.dedupe.keep_first`.
    """
    raw = read_text_columns(spark, path, multi_line, entered)
    own = [entered] if entered else []
    rows = raw if schema is None else _typed(raw, _kinds(schema, as_text), own)
    return rows.dropna(how="all", subset=[f"`{c}`" for c in rows.columns if c not in own])


def failed_casts(
    spark: SparkSession, path: str, schema: StructType | str,
    as_text: Sequence[str] = (), multi_line: bool = False,
) -> DataFrame:
    """Values of a form that do not parse under its schema: (column, n), columns with any."""
    raw, kinds = read_text_columns(spark, path, multi_line), _kinds(schema, as_text)
    known = [n for n in kinds if n in raw.columns]
    counts = raw.agg(*(
        F.count_if(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast(kinds[n]).isNull()).alias(n)
        for n in known
    ))
    return counts.unpivot([], known, "column", "n").filter("n > 0")


def read_forms(
    spark: SparkSession, directory: str,
    schemas: Mapping[str, StructType | str] | None = None,
    as_text: Mapping[str, Sequence[str]] | None = None, multi_line: Collection[str] = (),
) -> dict[str, DataFrame]:
    """All forms of a directory by table name, empty rows removed."""
    return {
        name: read_form(
            spark, path, (schemas or {}).get(name), (as_text or {}).get(name, ()), name in multi_line
        )
        for name, path in form_files(spark, directory).items()
    }


def read_multi(
    spark: SparkSession, directory: str, schema: StructType | str, columns: Sequence[str],
    key: str = "combined_number", order: Sequence[Column] | None = None,
) -> DataFrame:
    """Union of a directory's lists, one row per key; each list by its own header.

    The first row counts: by ``order``, or as the rows were entered, file by file.
    """
    raw = read_text_columns(spark, directory, entered="__at")
    kinds = _kinds(schema)
    named = _typed(raw, {c: kinds[c] for c in columns}, ["__at"])
    return keep_first(named, [key], order or [F.col("__at")]).drop("__at")


def read_table(
    spark: SparkSession, path: str, names: Sequence[str], schema: str | None = None,
    header: bool = True,
) -> DataFrame:
    """Reference table whose columns are named by position."""
    types = schema or ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(types).option("header", header).option(
        "enforceSchema", True
    ).option("escape", '"').csv(path).toDF(*names)


def read_sheets(
    spark: SparkSession, paths: Sequence[str], marker: str = "NAME", headerless: str = "error"
) -> DataFrame:
    """Correction sheets (a CSV file each, or a folder of parts): the rows below the
    repeated header row.

    Sheets may differ in columns; all values are text. ``sheet`` is the position
    in ``paths`` and ``line`` the place within it (part, block and row), so
    ``correction_order`` restores the order of entry. A sheet without a repeated header is an error, or gives no
    rows if ``headerless`` is "skip".
    """
    read = session.together(*(partial(read_text_columns, spark, p, True, "line") for p in paths))
    sheets = [sheet.withColumn("sheet", F.lit(k)) for k, sheet in enumerate(read)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)
    header = (
        rows.filter(F.col(marker) == marker).groupBy("sheet").agg(F.min("line").alias("__header"))
    )
    if headerless == "error":
        known = {r.sheet for r in header.select("sheet").toLocalIterator()}
        lost = [p for k, p in enumerate(paths) if k not in known]
        if lost:
            raise ValueError(f"no repeated header row in {lost}")
    below = rows.join(header, "sheet", "inner").filter(F.col("line") > F.col("__header"))
    return below.drop("__header").withColumn("correction_order", F.struct("sheet", "line"))


def type_corrections(corrections: DataFrame, origin: str = K.EXCEL_ORIGIN) -> DataFrame:
    """Dates from day numbers, numeric grades; rows without name or id go."""
    return corrections.withColumns({
        "dobs": dates.excel_date(F.col("dobs"), origin),
        "grades": F.col("grades").try_cast("double"),
    }).dropna(subset=["NAME", "permids"])
