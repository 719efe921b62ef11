"""Counts observed while a table is stored agree with the separate checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollbook.functions import dates
from rollbook.operators import checks, quality

DAY = "2016-06-30"


def table(spark):
    return spark.range(0, 5000, 1, 4).select(
        F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 90_001).alias("person"),
        (F.col("id") % 23).alias("school"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 14).cast("int")).alias("month"),
        F.date_add(F.lit("1930-01-01").cast("date"), (F.col("id") * 37 % 29_000).cast("int")).alias("dob"),
        F.when(F.col("id") % 3 > 0, F.lit(1.0)).alias("mark"),
    )


def test_counts_agree_with_the_separate_checks(spark):
    df = table(spark)
    on = F.to_date(F.lit(DAY))
    stored, counts = checks.store_checked(
        df, "checked",
        {
            "months": checks.outside(F.col("month"), 4, 11), "no_id": F.col("person").isNull(),
            "ages": checks.outside(dates.age_years(F.col("dob"), on), 18, 70), "no_mark": F.col("mark").isNull(),
        },
        {"schools": (F.col("school"), 100), "people": (F.col("person"), 90_001), "low": (F.col("person"), 40_000)},
    )
    assert counts == {
        "rows": 5000, "months": quality.range_check(df, ["month"], (4, 11)).count(),
        "no_id": quality.missing_share(df, "person").first()["missing"],
        "ages": quality.age_check(df, on, bounds=(18, 70)).count(),
        "no_mark": quality.completeness(df, "mark", []).first()["missing"],
        "schools": quality.count_check(df, "school").first()["found"],
        "people": quality.count_check(df, "person").first()["found"],
        "low": quality.count_check(df.filter("person < 40000"), "person").first()["found"],
    }
    assert stored.exceptAll(df).count() == 0 and stored.count() == 5000


def test_one_job_and_no_more(spark):
    sc = spark.sparkContext
    sc.setJobGroup("checked", "one job")
    try:
        checks.store_checked(table(spark), "checked", {"no_id": F.col("person").isNull()}, {"schools": (F.col("school"), 100)})
        assert len(sc.statusTracker().getJobIdsForGroup("checked")) == 1
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_empty_tables_and_names(spark):
    none = table(spark).filter("school > 99")
    _, counts = checks.store_checked(none, "checked", {"no_id": F.col("person").isNull()}, {"schools": (F.col("school"), 100)})
    assert counts == {"rows": 0, "no_id": 0, "schools": 0}
    with pytest.raises(ValueError, match="rows"):
        checks.store_checked(none, "checked", {"rows": F.lit(True)})
