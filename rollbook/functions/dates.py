"""Date expressions. All are locale free and return NULL for invalid dates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from rollbook import constants as K


def sunday_week(date: Column) -> Column:
    """``YYYY-WW`` with Sunday-start weeks; days before the first Sunday are week 00."""
    week = F.floor((F.dayofyear(date) + 7 - F.dayofweek(date)) / F.lit(7))
    return F.concat_ws("-", F.year(date).cast("string"), F.lpad(week.cast("string"), 2, "0"))


def year_month(date: Column, sep: str = "-") -> Column:
    return F.date_format(date, f"yyyy{sep}MM")


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def is_weekday(date: Column) -> Column:
    return F.weekday(date) < 5


def in_break(date: Column, months: Iterable[int] = K.BREAK_MONTHS) -> Column:
    """True for days of the school break."""
    return F.month(date).isin(*months)


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL where the parts name no calendar day.

    Integer arithmetic throughout: nothing is formatted or parsed, and no part
    can raise an error under ANSI rules.
    """
    y, m, d = (part.try_cast("int") for part in (year, month, day))
    first = F.make_date(y, F.when(m.between(1, 12), m), F.lit(1))
    exists = d.between(1, F.dayofmonth(F.last_day(first)))
    return F.when(exists, F.date_add(first, d - 1))


def reference_month(
    slot: Column, first: Column, second: Column, third: Column,
    third_fix: dict[int, int] | None = None,
) -> Column:
    """The month number a slot 1-3 stands for, with wrong third months repaired."""
    for wrong, right in (K.THIRD_SLOT_FIX if third_fix is None else third_fix).items():
        third = F.when(third == wrong, F.lit(right)).otherwise(third)
    return F.when(slot == 1, first).when(slot == 2, second).when(slot == 3, third)


def slot_date(
    slot: Column, day: Column, first: Column, second: Column, third: Column,
    year: int = K.PHASE_1_YEAR, third_fix: dict[int, int] | None = None,
) -> Column:
    """Date of an absence given by month slot and day of month."""
    month = reference_month(slot, first, second, third, third_fix)
    return date_from_parts(F.lit(year), month, day)


def month_number(name: Column) -> Column:
    """English month name to 1-12; other text gives NULL."""
    position = F.array_position(F.array(*[F.lit(m) for m in K.MONTH_NAMES]), name)
    return F.nullif(position, F.lit(0)).cast("int")


def named_month_date(name: Column, day: Column, year: Column) -> Column:
    return date_from_parts(year, month_number(name), day)


def iso_prefix_date(text: Column) -> Column:
    """Date from the first ten characters, ``YYYY-MM-DD``."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def day_month_name_date(text: Column) -> Column:
    """Date from day, short English month name in any case and year: ``05Mar2004``."""
    head = F.substring(text, 1, 10)
    day, name, year = (
        F.regexp_extract(head, r"^([0-9]{1,2})([A-Za-z]{3})([0-9]{4})", i) for i in (1, 2, 3)
    )
    short = F.array(*[F.lit(m[:3].lower()) for m in K.MONTH_NAMES])
    return date_from_parts(year, F.array_position(short, F.lower(name)), day)


def excel_date(serial: Column, origin: str = K.EXCEL_ORIGIN) -> Column:
    """Date from a spreadsheet day number, possibly given as text."""
    days = serial.try_cast("double").cast("int")
    return F.date_add(F.to_date(F.lit(origin)), days)


def age_years(born: Column, on: Column) -> Column:
    return F.months_between(on, born) / 12


def weekday_array(start: Column, end: Column, holidays: Iterable[str] = ()) -> Column:
    """Array of the weekdays from ``start`` to ``end`` inclusive, less ``holidays``."""
    days = F.filter(F.sequence(start, end), is_weekday)
    skipped = [F.to_date(F.lit(h)) for h in holidays]
    return F.array_except(days, F.array(*skipped)) if skipped else days


def calendar_fields(date: Column) -> dict[str, Column]:
    """The date parts used as grouping keys, by name."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "year_month": year_month(date),
        "month_start": month_start(date),
        "year_week": sunday_week(date),
        "weekday": F.weekday(date),
    }
