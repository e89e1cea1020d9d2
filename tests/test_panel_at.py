"""Panels at many instants equal single as-of reads, splits known then included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import panel, pending

T0 = dt.datetime(2020, 1, 1)


def at(days):
    return T0 + dt.timedelta(days=days)


@pytest.mark.parametrize("lookback", [None, 20])
def test_panel_at_instants(spark, lookback):
    rng = random.Random(4)
    rows = [(f"e{i % 3}", at(i % 60), at(i % 60 + rng.choice([0, 0, 2, 30])), float(i), float(i), float(i), float(i), 10.0) for i in range(300)]
    bars = spark.createDataFrame(rows, "entity_id string, event_time timestamp_ntz, availability_time timestamp_ntz, open double, high double, low double, close double, volume double")
    actions = spark.createDataFrame([("e0", at(40), at(38), 2.0), ("e0", at(40), at(45), 4.0), ("e1", at(50), at(90), 3.0)], "entity_id string, effective_date timestamp_ntz, availability_time timestamp_ntz, ratio double")
    instants = [at(10), at(39), at(46), at(100)]
    for acts in (None, actions):
        out = panel.load_panel_at(bars, instants, actions=acts, lookback=lookback)
        got = sorted((r.as_of, r.entity_id, r.event_time, r.close, r.volume) for r in out.collect())
        want = []
        for t in instants:
            one = panel.load_panel(bars, F.lit(t).cast("timestamp_ntz"), actions=acts, start=None if lookback is None else F.lit(panel.history_start(t, lookback)).cast("timestamp_ntz"))
            want += [(t, r.entity_id, r.event_time, r.close, r.volume) for r in one.where("close is not null").collect()]
        # versions of one availability: latest() takes any, this one the last
        assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    plan = panel.load_panel_at(bars, instants)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 1 and "Join" not in plan
    assert panel.load_panel_at(bars, []).count() == 0


def test_versions_known_at_once_and_splits_known_then(spark):
    bars = spark.createDataFrame([("e", at(0), at(0), 1.0), ("e", at(0), at(5), 7.0), ("e", at(0), at(5), 8.0)], "entity_id string, event_time timestamp_ntz, availability_time timestamp_ntz, close double")
    actions = spark.createDataFrame([("e", at(3), at(2), 2.0), ("e", at(3), at(6), 4.0)], "entity_id string, effective_date timestamp_ntz, availability_time timestamp_ntz, ratio double")
    got = {r.as_of: r.close for r in panel.load_panel_at(bars, [at(1), at(2), at(5), at(6)], actions=actions).collect()}
    assert got == {at(1): 1.0, at(2): 0.5, at(5): 4.0, at(6): 2.0}


def test_history_start():
    assert panel.history_start(at(0), 252) == at(-451) and panel.history_start(at(0), 4, "month") == at(-157)


def test_pending_events(spark):
    rows = [("a", "E", at(30), at(5)), ("a", "E", at(30), at(1)), ("a", "F", at(31), at(9)), ("a", "G", at(200), at(0)), ("a", None, at(12), at(10)), ("b", "E", at(30), at(50)), ("c", "E", None, at(1))]
    events = spark.createDataFrame(rows, "entity_id string, event_type string, scheduled_for timestamp_ntz, availability_time timestamp_ntz")
    asks = [(1, "a", at(8)), (2, "a", at(30)), (3, "a", at(32)), (4, "b", at(20)), (5, "z", at(1)), (6, "c", at(2)), (7, "a", at(0)), (8, "a", at(11))]
    out = pending.pending_events(events, spark.createDataFrame(asks, "ask_id int, entity_id string, as_of timestamp_ntz"))
    got = {r.ask_id: (r.coverage, r.miss_reason, r.pending, r.next_at, r.days_to_event, r.events_covered) for r in out.collect()}
    assert got[1] == ("KNOWN", None, 1, at(30), 22, True) and got[2][:4] == ("KNOWN", None, 2, at(30))
    assert got[3] == ("NONE_SCHEDULED", None, 0, None, None, True) and got[6][0] == "NONE_SCHEDULED" and got[7][0] == "NONE_SCHEDULED"
    assert got[4] == ("UNAVAILABLE", "not_yet_available", 0, None, None, None) and got[5][:2] == ("UNAVAILABLE", "never_ingested")
    assert got[8][2:4] == (3, at(12))
    known = {(r.event_type, r.scheduled_for): r.known_from for r in pending.first_known(events).collect()}
    assert known["E", at(30)] in (at(1), at(50)) and len(known) == 5
