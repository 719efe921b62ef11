"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads. Every query
is run to its last row (``noop`` sink): once cold, then ``BENCH_RUNS`` times; the
reported time is the best warm run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from rollbook import session
from workload import QUERIES

HEADLINE = (
    "daily_rate_by_region",
    "monthly_rate_by_class",
    "monthly_rate_by_region",
    "monthly_rate",
    "yearly_rate_by_nation",
    "rolling_ratio_30d",
    "weighted_monthly_ratio",
    "user_day_panel",
    "reliable_panel",
    "class_day_expansion",
    "two_phase",
    "corrected_panel",
    "keep_first_order",
    "both_phases",
    "marks_long",
    "marks_mean",
    "class_calendar",
    "link_fuzzy",
    "distance_to_own",
    "corrected_entities",
)


def run(spark: SparkSession, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config(map=session.AT_START)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in chosen:
        cold[name] = round(run(spark, name, folder), 3)
        warm[name] = round(min(run(spark, name, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
