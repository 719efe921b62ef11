"""Wide-to-long reshaping: marks, class calendars, and mark statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollbook import constants as K
from rollbook.functions import dates, recode
from rollbook.operators import panel


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str],
    key: str = "key", value: str = "value",
) -> DataFrame:
    """One row per record and column; all the columns need one common type."""
    return df.unpivot(list(ids), list(columns), key, value)


@dataclass(frozen=True)
class Mark:
    """What the name of an evaluation column says."""

    column: str
    year: int | None
    trimester: int | None
    period: str | None
    subject: str


def parse_mark(
    column: str, subject_start: int = K.MARK_SUBJECT_START,
    letter_year: Mapping[str, int] = K.LETTER_YEAR,
    letter_trimester: Mapping[str, int] = K.LETTER_TRIMESTER,
    periods: Sequence[str] = K.MARK_PERIODS, years: Sequence[str] = K.MARK_YEARS,
) -> Mark:
    """Year, trimester, period and subject from an evaluation column's name."""
    tokens = column.split("_")
    letter = next((t for t in tokens if len(t) == 1), None)
    period = next((t for t in tokens if t in periods), None)
    said = {*letter_year, *periods, *years}
    first, *middle = column[subject_start - 1:].split("_")
    # The first and the last token border on no underscore on one side: they stay, but
    # for a year at the end.
    last = ["" if t in years else t for t in middle[-1:]]
    subject = "_".join([first, *(t for t in middle[:-1] if t not in said), *last])
    return Mark(
        column, letter_year.get(letter), letter_trimester.get(letter),
        None if period is None else period.upper(), subject,
    )


def marks_long(
    df: DataFrame, ids: Sequence[str], marks: Sequence[Mark], value: str = "value"
) -> DataFrame:
    """Evaluation columns as (ids, year, trimester, period, subject, value) rows.

    The names are parsed once while the plan is built and travel as literals
    inside each record, so the reshape is a narrow projection; missing marks
    give no row.
    """
    cells = F.array(*[
        F.struct(
            F.lit(m.year).cast("int").alias("year"),
            F.lit(m.trimester).cast("int").alias("trimester"),
            F.lit(m.period).cast("string").alias("period"),
            F.lit(m.subject).alias("subject"),
            F.col(f"`{m.column}`").try_cast("double").alias(value),
        )
        for m in marks
    ])
    rows = df.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.*")
    return rows.filter(F.col(value).isNotNull())


def mark_columns(df: DataFrame, token: str = K.MARK_TOKEN) -> list[Mark]:
    return [parse_mark(c) for c in df.columns if token in c]


def yes_no_pairs(
    long: DataFrame, ids: Sequence[str], attributes: Sequence[str] = (),
    key: str = "key", value: str = "value",
) -> DataFrame:
    """Bring the ``info`` and ``info_yes`` answers of a form and month onto one row.

    Rows of ``long`` carry ``<month>_info`` or ``<month>_info[_if]_yes`` keys. One
    conditional aggregate replaces the self-join; months without a ``yes`` answer
    row are left out, as a left join from the ``yes`` rows does.
    """
    is_yes = F.col(key).contains("yes")
    paired = long.groupBy(*ids, F.split_part(F.col(key), F.lit("_"), F.lit(1)).alias("month")).agg(
        *[F.max(F.when(~is_yes, F.col(a))).alias(a) for a in attributes],
        F.max(F.when(~is_yes, F.col(value))).alias("info"),
        F.max(F.when(is_yes, F.col(value))).alias("info_yes"),
        F.max(is_yes).alias("__yes"),
    )
    return paired.filter("__yes").drop("__yes")


def class_months(
    wide: DataFrame, keys: Sequence[str] = ("school_number", "grade", "class"),
    months: Mapping[str, int] = K.CALENDAR_MONTHS,
) -> DataFrame:
    """Class-months with their answers and action, straight from the wide form.

    Both answers of a month sit in the same record, so no self-join is needed.
    """
    answers = []
    for name, number in months.items():
        yes = next(
            (c for c in (f"{name}_info_yes", f"{name}_info_if_yes") if c in wide.columns), None
        )
        if yes:
            info = F.col(f"{name}_info") if f"{name}_info" in wide.columns else F.lit(None)
            answers.append(F.struct(
                F.lit(name).alias("month"), F.lit(number).alias("month_number"),
                info.cast("int").alias("info"), F.col(yes).cast("int").alias("info_yes"),
            ))
    rows = wide.select(*keys, F.explode(F.array(*answers)).alias("a")).select(*keys, "a.*")
    return rows.withColumn(
        "action", recode.decide_action(F.col("info"), F.col("info_yes"), F.col("month"))
    )


def calendar_days(
    months: DataFrame, keys: Sequence[str] = ("school_number", "grade", "class"),
    year: int = K.PHASE_2_YEAR, holidays: Iterable[str] = K.HOLIDAYS,
) -> DataFrame:
    """School days of every usable class-month, each day once per class.

    Months without an action or marked unusable give no days.
    """
    usable = months.filter(F.col("action").isNotNull() & (F.col("action") != K.NOT_USABLE))
    # Repeated class-months are removed while they are still months.
    distinct = usable.select(*keys, "month_number").distinct()
    first = dates.date_from_parts(F.lit(year), F.col("month_number"), F.lit(1))
    days = distinct.withColumn("__first", first).filter(F.col("__first").isNotNull())
    expanded = panel.expand_days(
        days, F.col("__first"), F.last_day("__first"), holidays=holidays
    )
    return expanded.select(*keys, "date")


def class_calendar(
    wide: DataFrame, keys: Sequence[str] = ("school_number", "grade", "class"),
    year: int = K.PHASE_2_YEAR, holidays: Iterable[str] = K.HOLIDAYS,
) -> DataFrame:
    """The wide class form to one row per class and school day."""
    return calendar_days(class_months(wide, keys), keys, year, holidays)


def unresolved_months(months: DataFrame) -> DataFrame:
    """Class-months whose answers fit no action, counted by month."""
    return months.filter(F.col("action").isNull()).groupBy("month").agg(
        F.count(F.lit(1)).alias("n")
    )


MARK_LEVELS = (
    ("trimester", "subject", "district"),
    ("trimester", "district"),
    ("year", "subject", "district"),
    ("year", "district"),
)


def mark_means(
    marks: DataFrame, levels: Sequence[Sequence[str]] = MARK_LEVELS, value: str = "value",
) -> DataFrame:
    """Mean mark at several levels at once; keys outside a level are NULL.

    Marks are summed once per finest group, the levels are then taken from that
    small table.
    """
    every = list(dict.fromkeys(k for level in levels for k in level))
    known = marks.filter(F.col("district").isNotNull() & F.col(value).isNotNull())
    finest = known.groupBy(*every).agg(
        F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__n")
    )
    sets = [[F.col(k) for k in level] for level in levels]
    level_id = F.grouping_id(*[F.col(k) for k in every]).alias("__level")
    means = finest.groupingSets(sets, *[F.col(k) for k in every]).agg(
        level_id, (F.sum("__sum") / F.sum("__n")).alias("mean_value"), F.sum("__n").alias("n_marks")
    )
    names = {
        sum(1 << (len(every) - 1 - i) for i, k in enumerate(every) if k not in level): "+".join(level)
        for level in levels
    }
    return means.select(
        recode.recode(F.col("__level").cast("int"), names).alias("level"),
        *every, "mean_value", "n_marks",
    )


def quantile_sketch(
    df: DataFrame, by: Sequence[str], value: str = "value", resolution: float = 0.01,
) -> DataFrame:
    """A mergeable sketch of the values of each group: rows (by, ``cell``, ``n``).

    A cell holds the values nearest to one multiple of ``resolution``, so the sketch is exact
    for values on that grid, and each quantile is within half a ``resolution`` otherwise.
    Its size follows the range of values, not their number; sketches merge by adding up
    equal cells (:func:`merged_sketch`). NULL and NaN are left out.
    """
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cell = F.round(F.col(value).cast("double") / F.lit(resolution)).cast("bigint")
    return known.groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def merged_sketch(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketch of coarser groups."""
    return sketch.groupBy(*by, "cell").agg(F.sum("n").alias("n"))


def sketch_quantiles(
    sketch: DataFrame, by: Sequence[str], probabilities: Mapping[str, float],
    resolution: float = 0.01,
) -> DataFrame:
    """Quantiles of each group by name, interpolated between neighbours, and ``n_values``.

    Only the cells of a group are ordered, whatever number of values they stand for.
    """
    group = Window.partitionBy(*by)
    upto = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = sketch.withColumns({"__end": F.sum("n").over(upto), "__all": F.sum("n").over(group)})

    def at(rank: Column) -> Column:
        """The value with so many values before it."""
        inside = (F.col("__end") - F.col("n") <= rank) & (rank < F.col("__end"))
        return F.max(F.when(inside, F.col("cell")))

    out = {}
    for name, p in probabilities.items():
        place = (F.col("__all") - 1) * F.lit(float(p))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out[name] = (low + (high - low) * part) * F.lit(resolution)
    return placed.groupBy(*by).agg(*(c.alias(n) for n, c in out.items()), F.max("__all").alias("n_values"))


#: Quantiles of a distribution of marks by name.
QUARTILES = {"lowest": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "highest": 1.0}


def mark_quantiles(
    marks: DataFrame, levels: Sequence[Sequence[str]] = MARK_LEVELS, value: str = "value",
    probabilities: Mapping[str, float] = QUARTILES, resolution: float = 0.01,
) -> DataFrame:
    """Quantiles of marks at several levels; keys outside a level are NULL.

    Marks are read once for sketches of the finest groups; every level merges those.
    """
    every = list(dict.fromkeys(k for level in levels for k in level))
    finest = quantile_sketch(marks.filter(F.col("district").isNotNull()), every, value, resolution)
    sets = [[*(F.col(k) for k in level), F.col("cell")] for level in levels]
    keys = [*(F.col(k) for k in every), F.col("cell")]
    merged = finest.groupingSets(sets, *keys).agg(F.grouping_id(*keys).alias("__level"), F.sum("n").alias("n"))
    found = sketch_quantiles(merged, ["__level", *every], probabilities, resolution)
    names = {
        sum(2 << (len(every) - 1 - i) for i, k in enumerate(every) if k not in level): "+".join(level)
        for level in levels
    }
    return found.select(recode.recode(F.col("__level").cast("int"), names).alias("level"), *every, *probabilities, "n_values")


def histogram(
    df: DataFrame, value: str, low: float, width: float, by: Sequence[str] = (),
) -> DataFrame:
    """Fixed-width bins: ``bin`` 0 begins at ``low``; NULL values are left out."""
    bin_number: Column = F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("bigint")
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, bin_number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_start", F.lit(low) + F.col("bin") * F.lit(width))
    )
