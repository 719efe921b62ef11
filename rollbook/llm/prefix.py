"""Global order and prefix sums from per-partition totals, on built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook import session

#: Rows of one partition lie below this bit of ``at``, the partition's number above it.
_ROW_BITS = 33

SEPARATED = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SEPARATED)), F.lit(0)).cast("long")


def beside(df: DataFrame, **added: Column) -> DataFrame:
    """``df`` as one struct column ``row`` next to working columns.

    Working columns so never clash with the caller's columns.
    """
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(v.alias(k) for k, v in added.items()))


def unfold(df: DataFrame, *added: str, first: bool = False) -> DataFrame:
    """The columns kept in ``row`` and the named working columns.

    A working column replaces a column of the same name.
    """
    names = [c for c in df.schema["row"].dataType.names if c not in added]
    return df.select(*(F.col("row").getField(c).alias(c) for c in names), *added)


def in_order(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` sorted by range partitions and stored, with ``at``, a unique number that
    rises in that order.

    The table is stored because range bounds are sampled: a second evaluation might cut
    elsewhere, and totals of one must not meet rows of the other.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return session.materialize(ranged.withColumn("at", F.monotonically_increasing_id()), label)


def prefix_sums(ordered: DataFrame, **values: Column) -> DataFrame:
    """Add, for each named value, the sum over all rows before (``<name>_before``).

    ``ordered`` comes from :func:`in_order`. Each partition sums its own rows; what lies
    before a partition comes from the totals of partitions, one row each.
    """
    part = F.shiftright("at", _ROW_BITS)
    rows = ordered.withColumn("part", part)
    for name, value in values.items():
        rows = rows.withColumn(name, value.cast("long"))
    totals = rows.groupBy("part").agg(*(F.sum(n).alias(n) for n in values))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_base") for n in values))
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(within), F.lit(0)) for n in values})
    # One row for each partition of the stored table: small whatever the table holds.
    rows = rows.join(F.broadcast(totals), "part")
    rows = rows.withColumns({f"{n}_before": F.col(f"{n}_before") + F.col(f"{n}_base") for n in values})
    return rows.drop("part", *(f"{n}_base" for n in values))
