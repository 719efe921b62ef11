"""Stored intermediate tables: their owner, their buckets, and phases stored together."""

from __future__ import annotations

import datetime as dt
import os
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollbook import session
from rollbook.operators import panel

DAYS = "array<struct<date:date>>"
MARKS = "array<struct<date:date,n:bigint>>"


def left_over(folder):
    return [f for _, _, files in os.walk(folder) for f in files]


def test_an_owner_removes_its_stores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    before = {t.name for t in spark.catalog.listTables()}
    with session.stores(spark):
        one = session.materialize(spark.range(10), "one")
        two = session.bucketed(spark.range(10).withColumn("k", F.col("id") % 3), "two", "k", 4)
        assert one.join(two, "id").count() == 10 and left_over(tmp_path)
    assert not os.listdir(tmp_path)
    assert {t.name for t in spark.catalog.listTables()} == before
    with pytest.raises(ZeroDivisionError), session.stores(spark):
        session.materialize(spark.range(3), "three")
        1 / 0
    assert not os.listdir(tmp_path)


def test_steps_run_at_the_same_time_and_keep_settings(spark):
    meet = threading.Barrier(2, timeout=60)
    before = spark.conf.get(session.DROP_SHUFFLES, None)

    def step(n):
        meet.wait()
        with session.dropped_shuffles(spark):
            meet.wait()
            return session.materialize(spark.range(n), "step").count()

    with session.stores(spark):
        assert session.together(lambda: step(3), lambda: step(5)) == [3, 5]
    assert spark.conf.get(session.DROP_SHUFFLES, None) == before
    with pytest.raises(KeyError):
        session.together(lambda: 1, lambda: {}["x"])


def calendars(spark):
    d = dt.date(2016, 3, 1)
    first = [(f"s{k}", None if k % 9 == 0 else f"0{k % 40}", [(d,)], [(d, 1)] if k % 2 else None) for k in range(60)]
    second = [(f"0{k}", f"0{k}", [(dt.date(2016, 4, 1),)], None) for k in range(20, 60)]
    schema = f"student string, combined_number string, days {DAYS}, marks {MARKS}"
    return spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)


def test_stored_phases_meet_where_they_lie(spark, rows):
    with session.stores(spark):
        first, second = calendars(spark)
        stored = [panel.stored_calendars(c, "student", "combined_number", "c") for c in (first, second)]
        assert stored[0].filter("combined_number is null").select("store_key").distinct().count() == 7
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            both = panel.two_phase_calendars(*stored, null_is_entity=False)
            plan = both._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            names = "combined_number", "phase", "repeated"
            assert rows(both, *names) == rows(panel.two_phase_calendars(first, second, null_is_entity=False), *names)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        flat = panel.expand_calendars(stored[0])
        assert flat.columns == ["student", "combined_number", "date", "absent"]


@pytest.mark.parametrize("nameless_second", [0, 1, 2])
def test_rows_without_an_id_are_one_entity(spark, nameless_second):
    first, second = calendars(spark)
    extra = spark.createDataFrame([("x", None, [(dt.date(2016, 4, 2),)], None)] * nameless_second, second.schema)
    both = panel.two_phase_calendars(first, second.unionByName(extra)).filter("combined_number is null")
    got = {(r.phase, r.repeated): r.n for r in both.groupBy("phase", "repeated").agg(F.count("*").alias("n")).collect()}
    assert got == ({} if not nameless_second else {(1, True): 7, (2, nameless_second > 1): nameless_second})


def test_texts_go_to_workers_in_small_batches(spark):
    texts = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    before = spark.conf.get(session._BATCH, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    with session.small_batches(spark):
        with session.small_batches(spark):
            pass
        most = texts.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]
    assert 1 << 20 <= most <= 2 * session.BATCH_BYTES
    assert spark.conf.get(session._BATCH, None) == before and not session._held[session._BATCH]


def test_the_drivers_heap_is_collected_between_stored_tables(spark, monkeypatch):
    def collections():
        beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    monkeypatch.setattr(session, "COLLECT_EVERY", 0.0)
    before = collections()
    session.materialize(spark.range(3), "three")
    after = collections()
    assert after > before
    monkeypatch.setattr(session, "COLLECT_EVERY", 1e9)
    session.materialize(spark.range(3), "three")
    assert collections() == after
