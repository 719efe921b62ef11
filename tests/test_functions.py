"""Column expressions on hand-made values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rollbook import constants as K
from rollbook.functions import dates, geo, keys, recode
from rollbook.operators import reshape

D = dt.date


def values(spark, schema, data, column):
    return [r[0] for r in spark.createDataFrame(data, schema).select(column).collect()]


def test_sunday_weeks_around_new_year(spark):
    days = [D(2015, 12, 31), D(2016, 1, 1), D(2016, 1, 2), D(2016, 1, 3), D(2016, 12, 31), None]
    got = values(spark, "d date", [(d,) for d in days], dates.sunday_week(F.col("d")))
    assert got[:-1] == [d.strftime("%Y-%U") for d in days[:-1]]


def test_zero_pad_never_cuts(spark):
    data = [("1",), ("12",), ("123",), ("1234",), (None,)]
    got = values(spark, "v string", data, keys.zero_pad(F.col("v")))
    assert got == ["01", "12", "123", "1234", "00"]


def test_composite_id(spark):
    data = [("1-2-3",), ("11-22-1234",), ("1-2",), (None,)]
    got = values(spark, "v string", data, keys.composite_id(F.col("v")))
    assert got == ["01-02-003", "11-22-1234", "01-02-000", None]


def test_class_label_shows_missing_parts(spark):
    got = values(
        spark, "s int, g int, c string", [(1, None, "A")],
        keys.class_label(F.col("s"), F.col("g"), F.col("c")),
    )
    assert got == ["school:1-grade:NA-class:A"]


def test_slot_dates(spark):
    data = [(1, 31), (1, 30), (2, 5), (3, 7), (1, 0), (2, None), (4, 3)]
    got = values(
        spark, "slot int, day int", data,
        dates.slot_date(F.col("slot"), F.col("day"), F.lit(4), F.lit(5), F.lit(1)),
    )
    assert got == [None, D(2015, 4, 30), D(2015, 5, 5), D(2015, 9, 7), None, None, None]


def test_named_and_written_dates(spark):
    got = values(
        spark, "m string, d int", [("February", 29), ("February", 30), ("x", 1), (None, 1)],
        dates.named_month_date(F.col("m"), F.col("d"), F.lit(2016)),
    )
    assert got == [D(2016, 2, 29), None, None, None]
    texts = [("05MAR2004",), ("5mar2004",), ("31Feb2004",), ("junk",), (None,)]
    got = values(spark, "t string", texts, dates.day_month_name_date(F.col("t")))
    assert got == [D(2004, 3, 5), D(2004, 3, 5), None, None, None]
    texts = [("2004-03-05T10:00",), ("2004-13-05",), (None,)]
    assert values(spark, "t string", texts, dates.iso_prefix_date(F.col("t"))) == [
        D(2004, 3, 5), None, None,
    ]


def test_excel_dates_and_origin(spark):
    data = [("37000",), ("37000.0",), ("x",), (None,)]
    assert values(spark, "t string", data, dates.excel_date(F.col("t"))) == [
        D(2001, 4, 19), D(2001, 4, 19), None, None,
    ]
    assert values(spark, "t string", data[:1], dates.excel_date(F.col("t"), "1900-01-01")) == [
        D(2001, 4, 21)
    ]


def test_recode_unknown_is_null(spark):
    data = [(1,), (8,), (9,), (None,)]
    got = values(spark, "c int", data, recode.recode(F.col("c"), K.SCHOOL_CONDITIONS))
    assert got == ["Caniço e palha", "Outro", None, None]


@pytest.mark.parametrize("info,yes,month,action", [
    (2, None, "fev", K.NOT_USABLE), (2, 1, "may", K.NOT_USABLE), (1, 2, "jun", K.LECTIVE_DAYS),
    (1, 1, "april", K.DAYS_OFF), (1, 1, "jun", K.FROM_SCRATCH), (1, 1, "july", None),
    (None, 1, "may", None), (1, None, "may", None),
])
def test_decision_table(spark, info, yes, month, action):
    got = values(
        spark, "i int, y int, m string", [(info, yes, month)],
        recode.decide_action(F.col("i"), F.col("y"), F.col("m")),
    )
    assert got == [action]


def test_parse_mark():
    mark = reshape.parse_mark("evaluation_avaliation_d_x_mt_port_2016")
    assert (mark.year, mark.trimester, mark.period, mark.subject) == (2016, 4, "MT", "_x_port_")
    other = reshape.parse_mark("evaluation_avaliation_zz_port")
    assert (other.year, other.trimester, other.period) == (None, None, None)


def test_distance_is_zero_on_itself_and_symmetric(spark):
    data = [(32.0, -25.0, 33.5, -24.0), (K.ORIGIN_LNG, K.ORIGIN_LAT, K.ORIGIN_LNG, K.ORIGIN_LAT)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    there = geo.sphere_km(*[F.col(x) for x in "abcd"]).alias("x")
    back = geo.sphere_km(*[F.col(x) for x in "cdab"]).alias("y")
    first, same = df.select(there, back).collect()
    assert first.x == pytest.approx(first.y, abs=1e-9) and first.x > 100
    assert same.x == pytest.approx(0.0, abs=1e-6)


def forward_utm(lng, lat):
    """Forward transverse Mercator by the same series family, for a round trip."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    e = math.sqrt(f * (2 - f))
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240,
    )
    phi, lam = math.radians(lat), math.radians(lng - 33)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 5e5 + 0.9996 * big * x, 1e7 + 0.9996 * big * y


def test_utm_round_trip(spark):
    points = [(32.8, -25.4), (33.0, -24.0), (34.9, -26.9), (31.2, -20.1)]
    df = spark.createDataFrame([forward_utm(*p) for p in points], "e double, n double")
    lng, lat = geo.utm_to_lonlat(F.col("e"), F.col("n"))
    for got, want in zip(df.select(lng, lat).collect(), points):
        assert got[0] == pytest.approx(want[0], abs=1e-7)
        assert got[1] == pytest.approx(want[1], abs=1e-7)
