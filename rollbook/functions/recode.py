"""Recodes, defaults, column selection and the class-month decision table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from rollbook import constants as K


def recode(value: Column, labels: Mapping) -> Column:
    """Code to label through a literal map; unknown and NULL codes give NULL."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items())
    return F.when(value.isNotNull(), F.create_map(*pairs)[value])


def fill_default(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULLs of the named columns by fixed values."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def standardise_names(
    df: DataFrame, lookup: DataFrame, column: str, found: str, correct: str
) -> DataFrame:
    """Replace a name by its standard form; names without an entry become NULL.

    Of several entries for a spelling the first standard form in order counts. Spark broadcasts it while its size
    stays under ``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle
    beyond.
    """
    spelled = lookup.groupBy(F.col(found).alias(column)).agg(F.min(correct).alias("__standard"))
    joined = df.join(spelled, column, "left")
    return joined.withColumn(column, F.col("__standard")).select(*df.columns)


def decide_action(info: Column, info_yes: Column, month: Column) -> Column:
    """How a class-month's school days are derived; uncovered answers give NULL."""
    yes = (info == 1) & (info_yes == 1)
    return (
        F.when(info == 2, K.NOT_USABLE)
        .when((info == 1) & (info_yes == 2), K.LECTIVE_DAYS)
        .when(yes & month.isin(*K.DAYS_OFF_MONTHS), K.DAYS_OFF)
        .when(yes & month.isin(*K.FROM_SCRATCH_MONTHS), K.FROM_SCRATCH)
    )


def project(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the named columns only and rename them (``{old: new}``)."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def select_matching(
    df: DataFrame, keep: str, drop: str | None = None, always: Sequence[str] = (),
    strip: str | None = None, rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Columns chosen by pattern: ``always`` first, then the rest in sorted order.

    ``strip`` is removed from every kept name, ``rename`` then maps exact names.
    Names are resolved while the plan is built; no data is touched.
    """
    chosen = {}
    for name in df.columns:
        wanted = re.search(keep, name) and not (drop and re.search(drop, name))
        if name in always or wanted:
            new = re.sub(strip, "", name) if strip else name
            chosen[(rename or {}).get(new, new)] = name
    lead = [(rename or {}).get(a, a) for a in always]
    order = [c for c in lead if c in chosen] + sorted(c for c in chosen if c not in lead)
    return df.select(*[F.col(f"`{chosen[c]}`").alias(c) for c in order])


def rename_ethics(df: DataFrame) -> DataFrame:
    """Mislabelled day-off columns hold the ethics marks; give them that name."""
    pattern = "|".join(sorted(K.ETHICS_COLUMNS, key=len, reverse=True))
    return df.toDF(*[re.sub(pattern, K.ETHICS_SUBJECT, c) for c in df.columns])


def suffix_columns(df: DataFrame, token: str, suffix: str) -> DataFrame:
    """Append ``suffix`` to every column whose name holds ``token``."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if token in c})


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def spaced(label: Column) -> Column:
    """Underscores of a subject label shown as spaces."""
    return F.regexp_replace(label, "_", " ")


def with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Repeat columns under further names (``{source: [alias, ...]}``)."""
    return df.withColumns({a: F.col(c) for c, names in aliases.items() for a in names})
