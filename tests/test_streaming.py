"""Streams give what a batch over the same rows gives."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import events as ev

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_tumbling_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in")
    got = ev.run_to_end(ev.windowed(ev.read_events(spark, str(tmp_path / "in"))), "daily", "complete")
    want = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert {(r.start.date(), r.event_type, r.n) for r in got.collect()} == {(r.d, r.event_type, r["count"]) for r in want.collect()}


def test_cases_expire_on_the_watermark_alone(spark, tmp_path):
    """The stream gives the batch extended by expiry; entity 2 is never heard of again."""
    import datetime as dt

    from tidemark.operators import lifecycle

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    schema = "entity_id bigint, at timestamp, state string, score double, confidence double"
    files = [
        [(1, day(0), "CONSOLIDATION", None, None), (2, day(0), "ACCUMULATION", None, None)],
        [(1, day(5), "CONSOLIDATION", 80.0, 70.0), (1, day(9), "BREAKOUT_READY", 80.0, 70.0), (2, day(3), "ACCUMULATION", 90.0, 90.0), (3, day(9), "CONSOLIDATION", None, None)],
        [(1, day(200), "CONSOLIDATION", None, None), (3, day(300), "UPTREND", None, None)],  # 1 is active, so overdue since day 190
        [(9, day(900), "CONSOLIDATION", None, None)],
    ]
    source = tmp_path / "in"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        os.utime(sorted(source.glob("*.parquet"), key=os.path.getmtime)[-1], (1000 + i, 1000 + i))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        got = ev.run_to_end(lifecycle.advance_with_timers(stream, "1 day"), "cases", checkpoint=str(tmp_path / "at")).collect()
    finally:
        spark.conf.unset(name)
    every = spark.createDataFrame([r for f in files for r in f], schema)
    want = lifecycle.advance(every, until=day(899)).drop("sequence_number").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {(r.entity_id, r["at"]) for r in want if r.reason == "expired"} == {(1, day(190)), (1, day(566)), (2, day(369))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_backfill_goes_on_where_it_ended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in")
    stream = ev.deduplicated(ev.read_events(spark, str(tmp_path / "in")))
    n = spark.read.parquet(f"{SF}/events.parquet").select("event_id").distinct().count()
    for _ in range(2):
        assert ev.backfill(stream, str(tmp_path / "out"), str(tmp_path / "at")).count() == n
