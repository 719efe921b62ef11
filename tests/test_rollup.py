"""Levels of a report from bitmaps of students."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import rollup


@pytest.mark.parametrize("students", [50, 90_000])
def test_every_level_counts_distinct_students(spark, rows, students):
    rng, people = random.Random(students), [*range(students), None]
    days = [(rng.choice(people), rng.randrange(4), rng.choice("xy"), rng.choice([True, False, None])) for _ in range(4000 if students < 100 else 120_000)]
    df = spark.createDataFrame(days, "student long, month int, class string, absent boolean").repartition(6)
    held = rollup.cells(df, ["month", "class"], "student")
    for by in (["month", "class"], ["class"], ["month"]):
        want = df.groupBy(*by).agg(
            F.count_if("absent").alias("absences"), F.count_if(~F.col("absent")).alias("presences"), F.count("*").alias("eligibles"),
            (F.count_distinct("student") + F.max(F.col("student").isNull().cast("int"))).alias("students"),
        )
        got = rollup.roll_up(held, {c: F.col(c) for c in by})
        names = [*by, *rollup.COUNTS, "students"]
        assert rows(got, *names) == rows(want, *names)
    whole = rollup.roll_up(held, {"all": F.lit(1)}).collect()
    assert [r.students for r in whole] == [len({d[0] for d in days})]


def test_members_of_a_class_are_numbered_together(spark):
    df = spark.createDataFrame([(k, f"c{k % 300}") for k in range(60_000)], "student long, class string")
    numbers = rollup.numbered(df, "student", ["class"])
    spread = numbers.join(df, "student").groupBy("class").agg(F.count_distinct(F.bitmap_bucket_number("__number")).alias("n"), F.count("*").alias("of"))
    assert spread.agg(F.max("n"), F.min("of")).first() == (2, 200) or spread.agg(F.max("n")).first()[0] <= 2
    assert numbers.select("__number").distinct().count() == 60_000


def test_no_days(spark):
    df = spark.createDataFrame([], "student long, month int, absent boolean")
    assert rollup.roll_up(rollup.cells(df, ["month"], "student"), {"month": F.col("month")}).count() == 0
