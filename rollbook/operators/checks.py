"""Quality counts of a table, collected by the job that stores it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F

from rollbook import session

#: Numbers that one bitmap of Spark's bitmap functions holds.
BITMAP = 32_768


def _bitmaps(number: Column, below: int) -> list[Column]:
    """Bitmaps of the numbers from 0 up to ``below`` that occur, one for each 32,768 of them."""
    whole = number.cast("long")
    known = whole.between(0, below - 1)
    return [
        F.bitmap_construct_agg(F.when(known & (F.floor(whole / BITMAP) == k), whole % BITMAP))
        for k in range(-(-below // BITMAP))
    ]


def store_checked(
    df: DataFrame, label: str, faults: Mapping[str, Column],
    distinct: Mapping[str, tuple[Column, int]] | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """Store ``df`` and count on the way: (the stored table, number by name).

    ``rows`` is the number of rows. ``faults`` names conditions; a row for which one holds
    counts, a NULL does not. ``distinct`` names a number and a bound: the values from 0 up to
    the bound that occur are counted exactly, in a bitmap of that many bits, and NULL and
    values outside are not. All of it is observed while the rows are written, so ``df`` is
    computed once and read by no second job; partial counts merge, so their size depends on
    the bounds and never on the rows.
    """
    distinct = distinct or {}
    clash = {"rows"} & {*faults, *distinct} | {*faults} & {*distinct}
    if clash:
        raise ValueError(f"names of counts used twice: {sorted(clash)}")
    seen = Observation()
    bits = {(name, k): b for name, (number, below) in distinct.items() for k, b in enumerate(_bitmaps(number, below))}
    checked = df.observe(
        seen, F.count(F.lit(1)).alias("rows"),
        *(F.count_if(fault).alias(f"fault_{name}") for name, fault in faults.items()),
        *(b.alias(f"bits_{name}_{k}") for (name, k), b in bits.items()),
    )
    stored = session.materialize(checked, label)
    got = seen.get
    counts = {"rows": got["rows"], **{name: got[f"fault_{name}"] for name in faults}}
    for name, k in bits:
        counts[name] = counts.get(name, 0) + int.from_bytes(got[f"bits_{name}_{k}"], "big").bit_count()
    return stored, counts


def outside(column: Column, low: object, high: object) -> Column:
    """The fault of a value out of bounds, as :func:`quality.range_check` has it."""
    return ~column.between(low, high)


def as_table(df: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """(check, n): the counts as rows."""
    return df.sparkSession.createDataFrame(list(counts.items()), "check string, n long")
