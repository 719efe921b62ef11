"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def zero_pad(value: Column, width: int = 2) -> Column:
    """Left-pad with zeros, never cutting; NULL counts as ``'0'``."""
    text = F.coalesce(value.cast("string"), F.lit("0"))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def join_id(district: Column, school: Column, student: Column) -> Column:
    """``DD-SS-NNN`` from its three parts."""
    return F.concat_ws("-", zero_pad(district), zero_pad(school), zero_pad(student, 3))


def composite_id(raw: Column) -> Column:
    """Normalise a ``d-s-n`` number to ``DD-SS-NNN``; NULL stays NULL."""
    parts = [F.split_part(raw, F.lit("-"), F.lit(i)) for i in (1, 2, 3)]
    return F.when(raw.isNotNull(), join_id(*parts))


def repair_leading_zero(raw: Column) -> Column:
    """Give back the leading zero that a numeric reading has removed."""
    return F.concat(F.lit("0"), raw.cast("string"))


def district_of(combined: Column) -> Column:
    return F.substring(combined, 1, 2)


def school_of(combined: Column) -> Column:
    return F.substring(combined, 4, 2)


def household_of(permid: Column) -> Column:
    """Household number: the first eight characters of a person's id."""
    return F.substring(permid, 1, 8)


def class_label(school: Column, grade: Column, class_name: Column) -> Column:
    """Readable class name; a missing part is printed as ``NA``."""

    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("NA"))

    return F.concat(
        F.lit("school:"), shown(school),
        F.lit("-grade:"), shown(grade),
        F.lit("-class:"), shown(class_name),
    )


def match_gender(gender: Column) -> Column:
    """Case-folded gender used when people are linked."""
    return F.upper(gender)
