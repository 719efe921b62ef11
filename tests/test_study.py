"""The whole study on small invented forms, against a plain-Python account of it."""

import datetime as dt
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rollbook.operators import linkage
from rollbook.plans import phase_two, report, study

D = dt.date
HOLIDAYS = {D(2016, 5, 1), D(2016, 6, 25)}
NAMES = ["ana", "rui", "eva", "leo", "mia", "zoe"]


def days_between(start, end):
    return [start + dt.timedelta(i) for i in range((end - start).days + 1)]


def weekdays(start, end):
    return [d for d in days_between(start, end) if d.weekday() < 5]


@pytest.fixture(scope="module")
def forms(spark):
    """Two schools in two districts, one class each, three students per class."""
    schools = spark.createDataFrame([
        ("s1", 1, "escola um", -254000000000, 328000000000, 1, 8, 1),
        ("s2", 2, "escola dois", -250000000000, 326000000000, 9, 2, 2),
    ], "SCHOOL_UUID string, DISTRICT int, SCHOOL_NAME string, GPS_LAT long, GPS_LNG long, "
       "TYPE_OF_LATRINE int, SCHOOL_CONDITIONS int, LUNCH int")
    names = spark.createDataFrame(
        [("escola um", "EPC Um"), ("escola dois", "EPC Dois")],
        "`School names…` string, `Correct name` string",
    )
    classes = spark.createDataFrame([
        ("b1", "s1", "c1", "A", 4, 4, 5, 12), ("b2", "s2", "c2", "B", 5, 4, 6, 1),
    ], "_URI string, SCHOOL_UUID string, CLASS_UUID string, CLASS_NAME string, GRADE int, "
       "FIRST_MONTH_OF_REFERENCE int, SECOND_MONTH_OF_REFERENCE int, THIRD_MONTH_OF_REFERENCE int")
    students = spark.createDataFrame([
        (f"u{i}", n, f"0000000{i}-1", "s1" if i < 3 else "s2", "c1" if i < 3 else "c2",
         f"{i + 1:02d}Mar2004", i % 2 + 1) for i, n in enumerate(NAMES)
    ], "_URI string, NAME string, PERMID string, SCHOOL_UUID string, CLASS_UUID string, DOB string, "
       "GENDER int")
    slots = {
        "form_c_days_first": ("DAYS_OF_ABSENCE_FIRST_MONTH", [("u0", 6), ("u0", 6), ("u1", 31), ("u3", 7), ("u4", 0)]),
        "form_c_days_second": ("DAYS_OF_ABSENCE_SECOND_MONTH", [("u1", 5), ("u3", 3), ("u5", 12)]),
        "form_c_days_third": ("DAYS_OF_ABSENCE_THIRD_MONTH", [("u2", 2), ("u4", 8)]),
    }
    ids = spark.createDataFrame([
        ("Manhiça" if i < 3 else "Magude", n, f"0000000{i}-1", "01" if i < 3 else "02",
         f"{1 if i < 3 else 2:02d}", f"{i:03d}",
         f"{1 if i < 3 else 2:02d}-{1 if i < 3 else 2:02d}-{i:03d}") for i, n in enumerate(NAMES)
    ], "district string, NAME string, PERMID string, district_number string, school_number string, "
       "student_number string, combined_number string")
    return {
        "form_a_core": schools, "school_names": names, "form_b_core": classes,
        "form_c_core": students, "ids": ids,
        **{k: spark.createDataFrame(v, f"_PARENT_AURI string, {c} int") for k, (c, v) in slots.items()},
    }


SLOTS = {
    "u0": [D(2015, 4, 6), D(2015, 4, 6)], "u1": [D(2015, 5, 5)], "u2": [D(2015, 12, 2)],
    "u3": [D(2015, 4, 7), D(2015, 6, 3)], "u4": [D(2015, 9, 8)], "u5": [D(2015, 6, 12)],
}


def expected_first():
    """(combined number, date) -> absent, by looping over students and days."""
    months = {"c1": (4, 5, 12), "c2": (4, 6, 1)}
    members = {"c1": ["u0", "u1", "u2"], "c2": ["u3", "u4", "u5"]}
    rows = {}
    for name, people in members.items():
        weeks = Counter(d.strftime("%Y-%U") for p in people for d in SLOTS[p])
        for p in people:
            for d in weekdays(D(2015, 3, 1), D(2015, 12, 31)):
                count = weeks[d.strftime("%Y-%U")]
                if d.month in months[name] and count and count / 3 * 100 / 5 >= 1:
                    i = int(p[1:])
                    district = 1 if i < 3 else 2
                    rows[(f"{district:02d}-{district:02d}-{i:03d}", d)] = d in SLOTS[p]
    return rows


SECOND = {0: [D(2016, 2, 3), D(2016, 5, 1)], 1: [D(2016, 3, 2)], 3: [D(2016, 5, 10), D(2016, 5, 14)]}


def second_forms(spark):
    number = lambda i: f"{1 if i < 3 else 2}-{1 if i < 3 else 2}-{i}"
    # Student 5 is lost in the second phase, student 7 is new.
    b2 = spark.createDataFrame(
        [(f"f{i}", number(i), "1", "4", "A" if i < 3 else "B") for i in (0, 1, 2, 3, 4, 7)],
        "uri string, student_number string, student_found string, grade string, class string",
    )
    b3 = spark.createDataFrame(
        [("g3", "2-02-003", "4", "B")],
        "uri string, students_student_number string, students_grade string, students_class string",
    )
    return phase_two.form_b2_ids(b2), phase_two.form_b3_ids(b3)


def month_tables(spark, b2, b3):
    schema = "parent_auri string, day int"
    empty = spark.createDataFrame([], schema)
    return [
        phase_two.MonthTable("February", 2016, "feb", spark.createDataFrame([("f0", 3), ("f0", 31)], schema), b2),
        phase_two.MonthTable("March", 2016, "mar", spark.createDataFrame([("f1", 2), ("lost", 2)], schema), b2),
        phase_two.MonthTable("April", 2016, "apr", empty, b2),
        phase_two.MonthTable("May", 2016, "may", spark.createDataFrame([("g3", 10), ("g3", 14)], schema), b3),
        phase_two.MonthTable("June", 2016, "jun", empty, b3),
    ]


def expected_second():
    groups = {"A": [0, 1, 2], "B": [3, 4, 7]}
    rows = {}
    for people in groups.values():
        weeks = Counter(
            d.strftime("%Y-%U") for p in people for d in SECOND.get(p, [])
            if d.weekday() < 5 and d not in HOLIDAYS
        )
        for p in people:
            for d in weekdays(D(2016, 2, 1), D(2016, 6, 30)):
                if weeks[d.strftime("%Y-%U")] / 3 * 100 / 5 >= 1:
                    district = 1 if p < 3 else 2
                    rows[(f"{district:02d}-{district:02d}-{p:03d}", d)] = d in SECOND.get(p, [])
    return rows


def test_study_from_forms_to_report(spark, forms, rows):
    first = study.phase_one_tables(forms)
    got_first = {(r.student_id, r.date): r.absent for r in first["panel"].collect()}
    assert {(f"u{int(k[0][-3:])}", k[1]): v for k, v in expected_first().items()} == got_first
    labels = rows(first["panel"].select("SCHOOL_NAME", "district", "LUNCH", "TYPE_OF_LATRINE").distinct())
    assert labels == [
        ("EPC Dois", "Magude", False, None),
        ("EPC Um", "Manhiça", True, "Retrete ligada a fossa séptica"),
    ]
    assert rows(first["students"], "combined_number") == [
        (f"{1 if i < 3 else 2:02d}-{1 if i < 3 else 2:02d}-{i:03d}",) for i in range(6)
    ]

    b2, b3 = second_forms(spark)
    second = study.second_phase(b2, b3, month_tables(spark, b2, b3))
    got_second = {(r.combined_number, r.date): r.absent for r in second["attendance"].collect()}
    assert got_second == expected_second()
    # One impossible date of student 0 counts as reported but lies on no lective day.
    assert rows(second["reconciliation"]) == [("01-01-000", 2, 1)]

    corrections = spark.createDataFrame(
        [("rui", "00000001-1", "EPC Dois", None, 5.0, None, "8|9", "", None, 1)],
        "NAME string, permids string, name_schools string, dobs date, grades double, "
        "class_names string, first_months string, second_months string, third_months string, "
        "correction_order long",
    )
    households = spark.createDataFrame(
        [("h1", 32.5, -25.1)],
        "HOUSEHOLD_HEAD_AGREG_NUM string, HOUSEHOLD_HEAD_GPS_LNG double, HOUSEHOLD_HEAD_GPS_LAT double",
    )
    members = spark.createDataFrame(
        [("00000000-1", "2004-01-01T00", "1", "Ana M", "h1"), ("00000004-1", "2004-01-05", "1", "Mia", None)],
        "PERM_ID_MEMBER string, BIRTH_MEMBER string, MEMBER_GENDER string, MEMBER_NAME string, "
        "HOUSEHOLD_NUMBER string",
    )
    individuals = spark.createDataFrame(
        [("00000001-1", "Rui", "F", D(2004, 2, 2)), ("00000004-1", "Mia", "F", D(2004, 2, 3))],
        "lastName string, firstName string, gender string, dob date",
    )
    coordinates = spark.createDataFrame(
        [("00000001", 7190000.0, 480000.0)], "house_number string, lat double, lng double"
    )
    census = linkage.unite_census([
        linkage.individual_census(individuals, coordinates, "Manhiça"),
        linkage.member_census(members, households, "Magude"),
    ])
    assert rows(census, "permid", "geo") == [
        ("00000000-1", "Magude"), ("00000001-1", "Manhiça"), ("00000004-1", "Manhiça"),
    ]
    tables = study.study(first, second, corrections, census)

    merged = defaultdict(dict)
    for phase, source in ((1, expected_first()), (2, expected_second())):
        for (number, date), absent in source.items():
            merged[number].setdefault(phase, {})[date] = absent
    want = {}
    for number, phases in merged.items():
        if len(phases) < 2:
            continue
        for phase, flags in phases.items():
            for date, absent in flags.items():
                if date.month in (12, 1):
                    continue
                if number == "01-01-001" and phase == 1 and date.month in (4, 5):
                    absent = date.month == 4 and date.day in (8, 9)
                want[(number, date, phase)] = absent
    got = {(r.combined_number, r.date, r.phase): r.absent for r in tables["attendance"].collect()}
    assert got == want and len(got) == tables["attendance"].count()

    linked = {r.PERMID: r for r in tables["students"].collect()}
    assert linked["00000001-1"].SCHOOL_NAME == "EPC Dois" and linked["00000001-1"].GRADE == 5
    assert linked["00000001-1"].lng == pytest.approx(32.80, abs=0.05)
    assert linked["00000000-1"].lng == 32.5 and linked["00000004-1"].geo is None
    schools = {r.SCHOOL_NAME: r for r in tables["schools"].collect()}
    assert schools["EPC Um"].n_students == 2 and schools["EPC Dois"].lat == pytest.approx(-25.0)

    charts = report.report(tables["attendance"], min_sample=1)
    daily = {(r.date, r.district): (r.absences, r.eligibles) for r in charts["daily_by_district"].collect()}
    counts = defaultdict(lambda: [0, 0])
    for (number, date, _), absent in want.items():
        cell = counts[(date, "Manhiça" if number[:2] == "01" else "Magude")]
        cell[0] += absent
        cell[1] += 1
    assert daily == {k: tuple(v) for k, v in counts.items()}
    assert charts["yearly_by_school"].agg(F.sum("eligibles")).first()[0] == len(want)
    for name in ("daily_ratio", "rolling_ratio", "monthly_ratio"):
        assert charts[name].columns
    classes = second["classes"]
    monthly = phase_two.monthly_class_report(tables["attendance"], classes)
    assert monthly.agg(F.sum("student_school_days")).first()[0] == len(want)
    districts = phase_two.monthly_district_report(tables["attendance"], classes)
    assert districts.agg(F.sum("absences")).first()[0] == sum(want.values())


def test_a_class_calendar_replaces_the_weekday_grid(spark):
    b2, b3 = second_forms(spark)
    open_days = spark.createDataFrame(
        [(1, 4, "A", D(2016, 2, 3)), (1, 4, "A", D(2016, 2, 5))],
        "school_number int, grade int, class string, date date",
    )
    second = study.second_phase(b2, b3, month_tables(spark, b2, b3), calendar=open_days)
    got = {(r.combined_number, r.date): r.absent for r in second["attendance"].collect()}
    assert got == {
        (f"01-01-{i:03d}", D(2016, 2, d)): (i == 0 and d == 3) for i in (0, 1, 2) for d in (3, 5)
    }
