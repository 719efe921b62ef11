"""Operators on hand-made tables, one case per rule that is easy to get wrong."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rollbook.plans import study
from rollbook.operators import (
    corrections, dedupe, distance, joins, linkage, panel, quality, rates, reshape,
)

D = dt.date


def day(text):
    return D.fromisoformat(text)


def test_rates_count_true_only_and_null_as_a_value(spark, rows):
    df = spark.createDataFrame(
        [("a", "s1", True), ("a", "s1", None), ("a", None, False), ("b", "s2", None)],
        "k string, id string, absent boolean",
    )
    got = rates.rate_by(df, ["k"], distinct={"students": "id"})
    assert rows(got, "k", "students", "absences", "presences", "eligibles", "absenteeism_rate") == [
        ("a", 2, 1, 1, 3, pytest.approx(100 / 3)), ("b", 1, 0, 0, 1, 0.0),
    ]
    two = rates.rate_by(df, ["k"], distinct={"students": "id", "flags": "absent"})
    assert rows(two, "k", "students", "flags") == [("a", 2, 3), ("b", 1, 1)]


def test_keep_first_is_by_order_and_groups_nulls(spark, rows):
    df = spark.createDataFrame(
        [("x", 2, "b"), ("x", 1, "a"), (None, 5, "c"), (None, 4, "d")], "k string, o int, v string"
    )
    got = dedupe.keep_first(df, ["k"], [F.col("o")])
    assert rows(got) == [("x", 1, "a"), (None, 4, "d")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.rsplit("Exchange", 1)[1]  # pruned before the shuffle


def test_numbering_over_many_partitions_with_one_hot_group(spark):
    rng = random.Random(7)
    data = [("big", f"n{i:05d}") for i in range(400)]
    data += [(f"g{i % 23:02d}", f"n{i:05d}") for i in range(300)] + [(None, "z1"), (None, "z2")]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "school string, name string").repartition(7)
    got = {(r.school, r.name): (r.school_number, r.student_number) for r in
           dedupe.number_entities(df, "school", ["name"]).collect()}
    schools = sorted({s for s, _ in data if s})
    for school, members in itertools.groupby(sorted(data, key=lambda r: (r[0] or "", r[1])),
                                             key=lambda r: r[0]):
        for i, (_, name) in enumerate(members, start=1):
            number = schools.index(school) + 1 if school else None
            assert got[(school, name)] == (number, i)
    assert len(got) == len(data)


def test_natural_join_matches_null_to_null_on_request(spark, rows):
    left = spark.createDataFrame([("a", None), ("b", "x")], "k string, j string")
    right = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, j string, v int")
    assert rows(joins.natural_left_join(left, right)) == [("a", None, None), ("b", "x", 2)]
    assert rows(joins.natural_left_join(left, right, null_safe=True)) == [
        ("a", None, 1), ("b", "x", 2),
    ]
    with pytest.raises(ValueError):
        joins.natural_left_join(left, right.select("v"))


def test_flag_join_adds_no_rows_for_repeats(spark, rows):
    grid = spark.createDataFrame([(1,), (2,)], "id int")
    events = spark.createDataFrame([(1,), (1,)], "id int")
    assert rows(joins.flag_join(grid, events, ["id"])) == [(1, True), (2, False)]


def test_literal_filter_keeps_null(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows(joins.without_value(df, "v", "a")) == [("b",), (None,)]


def test_cumulative_snapshots(spark, rows):
    days = [day("2016-01-01"), day("2016-01-03"), day("2016-01-07")]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, v int")
    want = sorted(((o, d, i, d == o) for i, d in enumerate(days) for o in days if d <= o), key=repr)
    assert rows(joins.cumulative_snapshots(df), "observation_date", "date", "v", "today") == want


def pair_table(spark, data):
    return spark.createDataFrame(
        data, "date date, first_rate double, first_students long, second_rate double, "
              "second_students long",
    )


def test_pair_ratio_keeps_one_sided_dates_and_zero_denominators(spark, rows):
    daily = spark.createDataFrame([
        (day("2016-01-01"), "a", 2.0, 10), (day("2016-01-01"), "b", 4.0, 20),
        (day("2016-01-02"), "b", 1.0, 5), (day("2016-01-03"), "a", 0.0, 8),
        (day("2016-01-03"), "b", 3.0, 6), (day("2016-01-03"), "c", 9.0, 9),
    ], "date date, district string, absenteeism_rate double, eligibles long")
    got = rates.pair_ratio(daily, "district", "a", "b")
    assert rows(got, "date", "ratio", "total_students", "avg_students") == [
        (day("2016-01-01"), 200.0, 30, 15.0), (day("2016-01-02"), None, None, None),
        (day("2016-01-03"), None, 14, 7.0),
    ]


def test_rolling_ratio_by_calendar_days(spark, rows):
    pair = pair_table(spark, [
        (day("2016-01-01"), 10.0, 10, 20.0, 10), (day("2016-01-31"), 30.0, 10, None, None),
        (day("2016-02-01"), 2.0, 10, 1.0, 10), (day("2016-06-01"), None, None, 5.0, 10),
    ])
    got = dict(rows(rates.rolling_ratio(pair), "date", "rolling_mean"))
    assert got[day("2016-01-01")] == pytest.approx(200.0)
    assert got[day("2016-01-31")] == pytest.approx(20.0 / 20.0 * 100)  # day 30 back still counts
    assert got[day("2016-02-01")] == pytest.approx(1.0 / 16.0 * 100)  # day 31 back does not
    assert got[day("2016-06-01")] is None


def test_sample_filter_and_weighted_mean(spark, rows):
    pair = pair_table(spark, [
        (day("2016-01-01"), 10.0, 30, 20.0, 10), (day("2016-01-02"), 20.0, 10, None, 40),
        (day("2016-01-03"), 10.0, 9, 20.0, 30),
    ])
    monthly = rates.weighted_monthly(pair).collect()[0]
    assert monthly.first_rate == pytest.approx((300 + 200 + 90) / 49)
    assert monthly.second_rate == pytest.approx(20.0)  # the missing day weighs nothing
    rolled = pair.withColumns({"avg_students": F.lit(20.0), "rolling_mean": F.lit(100.0)})
    assert [r[0] for r in rows(rates.sample_filter(rolled), "date")] == [
        day("2016-01-01"), day("2016-01-02"),
    ]


def weekly_table(spark):
    return spark.createDataFrame(
        [("c1", "2016-06", 0.5), ("c1", "2016-07", 2.0)],
        "class string, year_week string, absenteeism_rate double",
    )


@pytest.mark.parametrize("missing,kept", [(True, [15]), (False, [15, 22])])
def test_unreliable_weeks(spark, rows, missing, kept):
    # 2016-02-08 is in week 06, 02-15 in week 07, 02-22 in week 08 without any absence.
    grid = spark.createDataFrame(
        [("c1", D(2016, 2, d)) for d in (8, 15, 22)], "class string, date date"
    )
    options = {"missing_is_unreliable": missing}
    dropped = panel.mark_unreliable(grid, weekly_table(spark), ["class"], **options)
    assert rows(dropped, F.dayofmonth("date")) == [(d,) for d in kept]
    flagged = panel.mark_unreliable(
        grid, weekly_table(spark), ["class"], on_unreliable="flag", **options
    )
    assert [d for d, r in rows(flagged, F.dayofmonth("date"), "remove") if not r] == kept
    with pytest.raises(ValueError):
        panel.mark_unreliable(grid, weekly_table(spark), ["class"], on_unreliable="x")


def test_expand_days_over_reference_months(spark, rows):
    df = spark.createDataFrame([("a", 3, None), ("b", None, None)], "id string, m1 int, m2 int")
    got = rows(panel.expand_days(df, "2015-02-25", "2015-04-03", months=["m1", "m2"]), "id", "date")
    march = [D(2015, 3, d) for d in range(1, 32)]
    assert sorted(got) == [("a", d) for d in march if d.weekday() < 5]


def test_school_days_with_table_and_list(spark, rows):
    days = [day("2016-04-29"), day("2016-04-30"), day("2016-05-02"), day("2016-05-03")]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    assert sorted(rows(panel.school_days(df, ["2016-05-02"]))) == [(days[0],), (days[3],)]
    table = spark.createDataFrame([(day("2016-05-03"),)], "date date")
    assert sorted(rows(panel.school_days(df, table))) == [(days[0],), (days[2],)]


def test_two_phases(spark, rows):
    columns = "combined_number string, date date, absent boolean"
    first = spark.createDataFrame([
        ("both", day("2015-12-01"), True),  # only a break day, yet phase 1 is known
        ("one", day("2015-05-01"), True), (None, day("2015-05-01"), False),
    ], columns)
    second = spark.createDataFrame([
        ("both", day("2016-02-01"), True), ("both", day("2016-02-01"), True),
        ("both", day("2016-02-01"), False), ("two", day("2016-02-01"), True),
        (None, day("2016-02-02"), True),
    ], columns)
    got = panel.two_phase(first, second)
    want = sorted([
        ("both", day("2016-02-01"), True, 2), ("both", day("2016-02-01"), False, 2),
        (None, day("2015-05-01"), False, 1), (None, day("2016-02-02"), True, 2),
    ], key=repr)
    assert rows(got, "combined_number", "date", "absent", "phase") == want
    again = panel.both_phases(got, "combined_number")
    assert rows(again, "combined_number") == [(None,), (None,)]  # the break day is gone


def test_calendars_agree_with_rows(spark, rows):
    schema = "combined_number string, days array<struct<date:date>>, marks array<struct<date:date,n:long>>"

    def calendar(number, days, marks):
        return (number, [(D(y, m, d),) for y, m, d in days],
                None if marks is None else [(D(y, m, d), 1) for y, m, d in marks])

    first = spark.createDataFrame([
        calendar("p", [(2015, 3, 2), (2015, 3, 3), (2015, 12, 1)], [(2015, 3, 3), (2015, 8, 8)]),
        calendar("p", [(2015, 3, 2), (2015, 3, 4)], [(2015, 3, 2)]),  # same id again
        calendar("q", [(2015, 3, 2)], None), calendar("r", [], None),
    ], schema)
    second = spark.createDataFrame([
        calendar("p", [(2016, 2, 1)], None), calendar("q", [(2016, 3, 1)], [(2016, 3, 1)]),
        calendar("r", [(2016, 3, 1)], None),
    ], schema)
    fixes = spark.createDataFrame(
        [("q", 3, [2]), ("p", 3, [])], "combined_number string, month int, days array<int>"
    )
    calendars = panel.two_phase_calendars(first, second)
    names = ["combined_number", "date", "absent", "phase"]
    plain = panel.two_phase(panel.expand_calendars(first), panel.expand_calendars(second))
    assert rows(panel.attendance_rows(calendars), *names) == rows(plain, *names)
    for phase in (1, None):
        want = corrections.correct_flags(plain, fixes, phase=phase)
        got = panel.attendance_rows(calendars, fixes, phase=phase)
        assert rows(got, *names) == rows(want, *names)


def test_reconciliation(spark, rows):
    absences = spark.createDataFrame(
        [("a", 1), ("a", 2), ("b", 1), ("c", 1)], "combined_number string, date int"
    )
    grid = spark.createDataFrame(
        [("a", 1, True), ("a", 3, False), ("b", 1, True)],
        "combined_number string, date int, absent boolean",
    )
    assert rows(panel.reconcile(absences, grid)) == [("a", 2, 1)]


# --- corrections ------------------------------------------------------------

def correction_tables(spark):
    students = spark.createDataFrame([
        ("01", "ana", "p1", 1, "s1", D(2000, 1, 1), 3.0, "A"),
        ("01x", "ana", "p1", 2, "s9", D(2000, 1, 1), 3.0, "A"),  # repeated person
        ("02", "rui", "p2", 3, "s2", None, 4.0, "B"), (None, "eva", "p3", 4, "s3", None, 5.0, "C"),
        ("04", None, None, 5, "s4", None, 1.0, "D"),
    ], "combined_number string, NAME string, PERMID string, o int, SCHOOL_NAME string, DOB date, "
       "GRADE double, CLASS_NAME string")
    changes = spark.createDataFrame([
        ("ana", "p1", "new", None, None, None, "3|x|14", None, "", 1),
        ("ana", "p1", None, D(2001, 2, 3), 6.0, None, None, "7", None, 2),
        ("eva", "p3", "never", None, None, None, "1", None, None, 3),
        ("bob", "p9", "never", None, None, None, "1", None, None, 4),
    ], "NAME string, permids string, name_schools string, dobs date, grades double, "
       "class_names string, first_months string, second_months string, third_months string, ord int")
    return students, changes


def test_entity_corrections(spark, rows):
    students, changes = correction_tables(spark)
    got = corrections.correct_entities(students, changes, "ord", "o")
    assert rows(got, "combined_number", "SCHOOL_NAME", "DOB", "GRADE", "CLASS_NAME") == sorted([
        ("01", "new", D(2001, 2, 3), 6.0, "A"), ("02", "s2", None, 4.0, "B"),
        (None, "s3", None, 5.0, "C"), ("04", "s4", None, 1.0, "D"),
    ], key=repr)


def test_flag_corrections(spark, rows):
    students, changes = correction_tables(spark)
    reference = spark.createDataFrame(
        [("p1", "ana", 3, 4, 3, 1), ("zz", "bob", 3, 4, 5, 2)],
        "permid string, name string, month_1 int, month_2 int, month_3 int, ro int",
    )
    matched = corrections.match_corrections(changes, students, "o")
    assert rows(matched, "NAME", "combined_number") == [("ana", "01"), ("ana", "01")]
    monthed = corrections.with_reference_months(matched, reference, "ro")
    days = corrections.correction_days(monthed, "ord")
    # The later correction wins; its third slot names March again and lists nothing.
    assert rows(days, "combined_number", "month", "days") == [("01", 3, []), ("01", 4, [7])]
    attendance = spark.createDataFrame([
        ("01", D(2015, 3, 3), True, 1), ("01", D(2015, 4, 7), False, 1),
        ("01", D(2015, 4, 8), True, 1), ("01", D(2016, 4, 8), True, 2), (None, D(2015, 4, 8), True, 1),
    ], "combined_number string, date date, absent boolean, phase int")
    fixed = corrections.correct_flags(attendance, days)
    assert rows(fixed) == sorted([
        ("01", D(2015, 3, 3), False, 1), ("01", D(2015, 4, 7), True, 1),
        ("01", D(2015, 4, 8), False, 1), ("01", D(2016, 4, 8), True, 2),
        (None, D(2015, 4, 8), True, 1),
    ], key=repr)
    assert rows(corrections.correct_flags(fixed, days)) == rows(fixed)
    everywhere = corrections.correct_flags(attendance, days, phase=None)
    assert ("01", D(2016, 4, 8), False, 2) in rows(everywhere)


def test_reference_months_fall_back_to_the_name(spark, rows):
    changes = spark.createDataFrame([("ana", "other")], "NAME string, permids string")
    reference = spark.createDataFrame(
        [("p2", "ana", 9, 9, 9, 2), ("p1", "ana", 3, 4, 5, 1)],
        "permid string, name string, month_1 int, month_2 int, month_3 int, ro int",
    )
    got = corrections.with_reference_months(changes, reference, "ro")
    assert rows(got, "month_1", "month_2", "month_3") == [(3, 4, 5)]


# --- linkage and distance ---------------------------------------------------

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_fuzzy_linkage_finds_what_brute_force_finds(spark, limit):
    rng = random.Random(limit)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    students = [(i, w, rng.choice("MF")) for i, w in enumerate(words[:60])] + [(99, None, "M"), (98, "ab", None)]
    census = [(1000 + i, w, rng.choice("MF")) for i, w in enumerate(words[60:])] + [(5000, None, "M")]
    got = linkage.link_fuzzy(
        spark.createDataFrame(students, "sid int, name string, gender string"),
        spark.createDataFrame(census, "permid int, name string, gender string"), limit,
    ).collect()
    assert len(got) == len(students)
    for r in got:
        near = sorted(
            (edit_distance(r.name, n), n, p) for p, n, g in census
            if n is not None and r.name is not None and g == r.gender
        )
        best = next(((d, n, p) for d, n, p in near if d <= limit), (None, None, None))
        assert (r.match_distance, r.match_name, r.match_person) == best


def test_the_nearest_name_is_found_at_any_distance(spark, rows):
    students = spark.createDataFrame([("a", "ruiunlikeunlike", "M"), ("b", "", "M"), ("c", "ruy", "M"), ("d", "ana", "F")], "sid string, name string, gender string")
    census = spark.createDataFrame([(1, "rui", "M"), (2, "joaquim", "M"), (3, "zrui", "M"), (4, None, "F")], "permid int, name string, gender string")
    got = linkage.link_fuzzy(students, census)
    assert rows(got, "sid", "match_name", "match_distance", "match_person") == [
        ("a", "rui", 12, 1), ("b", "rui", 3, 1), ("c", "rui", 1, 1), ("d", None, None, None),
    ]
    assert rows(linkage.link_fuzzy(students, census, 11), "sid", "match_distance")[0] == ("a", None)
    assert rows(linkage.link_fuzzy(students, census, 12), "sid", "match_distance")[0] == ("a", 12)
    assert rows(linkage.open_names(got, census), "name", "reason") == [("ana", "gender absent from the census")]


def test_a_far_name_is_named_before_it_is_accepted(spark, rows):
    linked = spark.createDataFrame([("a", "ruiunlike", "MALE", None)], "sid string, NAME string, gender string, lng double")
    census = spark.createDataFrame([("p1", "rui", "male", 7.0)], "permid string, name string, gender string, lng double")
    columns = "sid", "lng", "approximate_match_in_census", "match_name", "match_distance"
    assert rows(linkage.link_nearest(linked, census, attributes=["lng"]), *columns) == [("a", None, False, "rui", 6)]
    assert rows(linkage.link_nearest(linked, census, None, attributes=["lng"]), *columns) == [("a", 7.0, True, "rui", 6)]


def test_an_exactly_linked_student_is_a_perfect_match(spark, rows):
    students = spark.createDataFrame([("p1", "rui", "Male"), (None, "ana", "Male"), ("p3", "anna", "Male")], "PERMID string, NAME string, gender string")
    census = spark.createDataFrame([("p1", "other", "male", 1.0, 2.0), ("p2", "ana", "male", 3.0, 4.0), ("p3", "x", "male", None, None)],
                                   "permid string, name string, gender string, lng double, lat double")
    got = study.census_students(students, census)
    assert rows(got, "name", "lng", "perfect_match_in_census", "approximate_match_in_census") == [
        ("ana", 3.0, True, False), ("anna", 3.0, False, True), ("rui", 1.0, True, False),
    ]


def test_exact_linkage_folds_case(spark, rows):
    students = spark.createDataFrame([("p1", "Male"), ("p2", "Male"), (None, "Male")],
                                     "PERMID string, gender string")
    census = spark.createDataFrame([("p1", "male", "x", 1.0), ("p2", "female", "y", 2.0)],
                                   "permid string, gender string, name string, lng double")
    got = linkage.link_exact(students, census)
    assert rows(got, "PERMID", "lng") == sorted([("p1", 1.0), ("p2", None), (None, None)], key=repr)
    assert "name" not in got.columns


def test_costs_need_a_position(spark, rows):
    schools = spark.createDataFrame(
        [("here", 32.803869, -25.408462, 5, "01"), ("lost", None, None, 7, "02")],
        "SCHOOL_NAME string, lng double, lat double, n_students int, district_number string",
    )
    costs = distance.travel_cost(distance.distance_to_point(schools))
    assert rows(costs, "SCHOOL_NAME", "distance", "euros") == [("here", 0.0, 0.0), ("lost", None, None)]
    assert rows(distance.without_coordinates(schools)) == [("lost",)]
    assert distance.cost_table(costs).columns == [
        "SCHOOL_NAME", "DISTANCE", "EUROS", "N_STUDENTS", "DISTRICT_NUMBER",
    ]


def test_rounding_is_half_even(spark):
    assert spark.range(1).select(F.bround(F.lit(0.125), 2)).first()[0] == pytest.approx(0.12)


# --- quality ----------------------------------------------------------------

def test_visits(spark, rows):
    data = [(1, f"s{i}", "one", "1") for i in range(6)] + [(1, "s9", "one", "2")]
    data += [(2, "t1", "two", "1"), (2, "t2", "two", "2"), (None, "u", None, "2")]
    found = spark.createDataFrame(
        data, "school_number int, combined_number string, SCHOOL_NAME string, student_found string"
    )
    assert rows(quality.visited_missing(found), "combined_number") == [("s9",)]
    assert rows(quality.found_counts(found)) == sorted([
        (1, "one", 7, 6, 1), (2, "two", 2, 1, 1), (None, None, 1, 0, 1),
    ], key=repr)
    assert quality.collected_so_far(quality.found_counts(found), 6).count() == 1
    report = quality.interviewer_report(found.withColumn("cod_inq", F.lit("x")))
    assert report.first().p_found == pytest.approx(70.0)


def test_checks(spark, rows):
    df = spark.createDataFrame(
        [("a", 3, D(1990, 1, 1)), ("a", 4, D(2005, 1, 1)), (None, 12, None), (None, None, D(1930, 1, 1))],
        "k string, m int, dob date",
    )
    assert rows(quality.unique_check(df, ["k"])) == [("a", 2), (None, 2)]
    assert rows(quality.range_check(df, ["m"]), "m") == [(12,), (3,)]
    assert quality.missing_share(df, "k").first().p_missing == pytest.approx(50.0)
    assert quality.age_check(df, F.lit(D(2016, 6, 30))).count() == 2
    assert quality.count_check(df, "k", 1).first().as_expected is True
    bins = quality.date_histogram(df, 10)
    assert sum(r.n for r in bins.collect()) == 3 and bins.agg(F.max("bin")).first()[0] == 9
    single = spark.createDataFrame([(D(2000, 1, 1),)] * 3, "dob date")
    assert rows(quality.date_histogram(single), "bin", "n") == [(0, 3)]


def test_incomplete_groups_give_nothing(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 1), ("a", None, 1), ("b", 1, 1), (None, 2, None)], "k string, x int, y int"
    )
    assert rows(quality.complete_groups(df, ["k"], ["x", "y"]), "k") == [("b",)]


def test_yes_rows_decide_which_months_exist(spark, rows):
    long = spark.createDataFrame([
        ("u", "may_info", 1, "A"), ("u", "may_info_yes", 2, "A"), ("u", "jun_info", 1, "A"),
        ("v", "fev_info_if_yes", 1, "B"),
    ], "uri string, key string, value int, class string")
    got = reshape.yes_no_pairs(long, ["uri"], ["class"])
    assert rows(got, "uri", "month", "class", "info", "info_yes") == [
        ("u", "may", "A", 1, 2), ("v", "fev", None, None, 1),
    ]


def test_open_names_have_a_reason(spark, rows):
    students = spark.createDataFrame([("M", "abcdef"), ("M", "zzzzzzzzz"), ("M", None), (None, "x"), ("X", "abc"), ("M", "zzzzzzzzz")], "gender string, name string")
    census = spark.createDataFrame([(1, "abcxef", "M")], "permid int, name string, gender string")
    linked = linkage.link_fuzzy(students, census, 3)
    assert linked.filter("match_person = 1 and match_distance = 1").count() == 1
    assert rows(linkage.open_names(linked, census, 3), "name", "people", "reason") == sorted([
        ("zzzzzzzzz", 2, "no name within 3 letters"), (None, 1, "no name"), ("x", 1, "no gender"),
        ("abc", 1, "gender absent from the census"),
    ], key=repr)


def test_nearest_name_gives_a_position(spark, rows):
    linked = spark.createDataFrame([("a", "rui", "MALE", 1.0), ("b", "ana", "MALE", None), ("c", "anna", "MALE", None), ("d", "xyzxyz", "MALE", None)],
                                   "sid string, NAME string, gender string, lng double")
    census = spark.createDataFrame([("p1", "ana", "Male", 7.0), ("p2", "rui", "male", None)], "permid string, name string, gender string, lng double")
    got = linkage.link_nearest(linked, census, 2, attributes=["lng"])
    assert rows(got, "sid", "lng", "perfect_match_in_census", "approximate_match_in_census") == [
        ("a", 1.0, True, False), ("b", 7.0, True, False), ("c", 7.0, False, True), ("d", None, False, False),
    ]


def test_repeated_absences_count_on_both_sides(spark):
    day = dt.date(2016, 3, 1)
    absences = spark.createDataFrame([("a", day), ("a", day)], "combined_number string, date date")
    grid = spark.createDataFrame([("a", day, True)], "combined_number string, date date, absent boolean")
    assert panel.reconcile(absences, grid).count() == 0
    calendars = spark.createDataFrame(
        [("a", [(day,)], [(day, 2)]), ("b", [(day,)], [(day, 1), (dt.date(2016, 3, 2), 2)])],
        "combined_number string, days array<struct<date:date>>, marks array<struct<date:date,n:bigint>>",
    )
    got = panel.reconcile_calendars(calendars, "combined_number").collect()
    assert [tuple(r) for r in got] == [("b", 3, 1)]


def test_repeated_spellings_give_one_row(spark, rows):
    from rollbook.functions import recode

    names = spark.createDataFrame([("a",), ("b",)], "name string")
    lookup = spark.createDataFrame([("a", "B"), ("a", "A")], "found string, correct string")
    assert rows(recode.standardise_names(names, lookup, "name", "found", "correct")) == [("A",), (None,)]
