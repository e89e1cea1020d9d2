"""Bitemporal and interval joins against plain Python, with a hot key and ties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, evidence, intervals, panel, quality

T0 = dt.datetime(2020, 1, 1)


def at(days):
    return T0 + dt.timedelta(days=days)


@pytest.fixture(scope="module")
def facts():
    rng = random.Random(11)
    out = [("hot" if rng.random() < 0.7 else rng.choice("abc"), at(rng.randrange(400)), None, i) for i in range(600)]
    # late, restated and early versions; some times are unknown
    out = [(k, e, e + dt.timedelta(days=rng.choice([-5, 0, 0, 3, 40, 200])), v) for k, e, _, v in out]
    return [*out, ("a", None, at(1), 900), ("a", at(2), None, 901), (None, at(0), at(0), 902), *[("tie", at(5), at(6), v) for v in (7, 9, 8)]]


@pytest.mark.parametrize("slices", [1, 5])
def test_bitemporal_join(spark, facts, slices):
    rng = random.Random(5)
    asks = [(i, rng.choice(["hot", "a", "b", "c", "tie", "none", None]), at(rng.randrange(-10, 500))) for i in range(300)] + [(300, "hot", None)]
    right = spark.createDataFrame(facts, "k string, e timestamp_ntz, v timestamp_ntz, version int")
    left = spark.createDataFrame(asks, "id int, k string, e timestamp_ntz")
    got = asof.bitemporal_join(left, right, "k", "e", "e", "v", ["version"], slices=slices)
    assert got.columns == ["id", "k", "e", "e_right", "v", "version"]

    def want(k, t):
        seen = [(e, v, n) for q, e, v, n in facts if q == k and k is not None and t and e and v and e <= t and v <= t]
        return max(seen)[2] if seen else None

    rows = got.collect()
    assert len(rows) == 301 and {r.id: r.version for r in rows} == {i: want(k, t) for i, k, t in asks}


def test_asof_join_passes_over_rows_without_time(spark):
    right = spark.createDataFrame([("a", None, 1), ("a", at(3), 2)], "k string, t timestamp_ntz, x int")
    left = spark.createDataFrame([("a", at(1)), ("a", at(3))], "k string, at timestamp_ntz")
    assert sorted((r["at"], r.x) for r in asof.asof_join(left, right, "k", "at", "t").collect()) == [(at(1), None), (at(3), 2)]


def test_case_set_meets_restated_vectors_in_one_pass(spark):
    cases = spark.createDataFrame([(1, "e", at(10)), (2, "e", at(20)), (3, "e", at(1)), (4, "f", at(9))], "case_id int, entity_id string, detected_at timestamp_ntz")
    outcomes = spark.createDataFrame([(1, at(30), "old"), (1, at(40), "b"), (1, at(40), "a"), (2, at(99), "late"), (3, at(30), "x"), (4, at(30), "y")], "case_id int, recorded_at timestamp_ntz, status string")
    vectors = spark.createDataFrame([("e", at(5), at(6), 1.0), ("e", at(5), at(15), 2.0), ("e", at(8), at(12), 3.0), ("e", at(2), at(9), 4.0), ("f", at(3), at(8), 5.0), ("f", at(3), at(8), 6.0)],
                                    "entity_id string, event_time timestamp_ntz, availability_time timestamp_ntz, x double")
    for slices in (1, 3):
        got = evidence.case_set(cases, outcomes, vectors, F.lit(at(50)), slices=slices)
        assert sorted((r.case_id, r.status, r.vector.x) for r in got.collect()) == [(1, "b", 1.0), (4, "y", 6.0)]
        assert "event_time" not in got.columns and "availability_time" not in got.columns
    plan = evidence.case_set(cases, outcomes, vectors, F.lit(at(50)))._jdf.queryExecution().executedPlan().toString()
    assert "entity_id" not in "".join(line for line in plan.splitlines() if "Join" in line)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("closed", [False, True])
def test_interval_join(spark, how, closed):
    rng = random.Random(2)
    keys = ["hot"] * 6 + ["a", "b", None]
    points = [(i, rng.choice(keys), at(rng.randrange(3000) / 2)) for i in range(250)] + [(250, "hot", None), (251, "alone", at(1)), (251, "alone", at(1))]
    spans = []
    for i in range(120):
        start = rng.choice([None, at(rng.randrange(3000) / 2), at(rng.randrange(3000) / 2)])
        length = rng.choice([-1, 0, 0.5, 1, 7, 8, 60, 700, 9000, None])
        spans.append((rng.choice(keys), start, start + dt.timedelta(days=length) if start and length is not None else None, i))
    spans.append(("hot", at(-9999), at(9999), 500))  # touches every bucket of its time
    p = spark.createDataFrame(points, "id int, k string, n timestamp_ntz")
    s = spark.createDataFrame(spans, "k string, a timestamp_ntz, b timestamp_ntz, n int")
    got = sorted(((r.id, r.n_right) for r in intervals.interval_join(p, s, ["k"], "n", "a", "b", closed=closed, how=how).collect()), key=str)
    want = []
    for i, k, t in points:
        held = [n for q, a, b, n in spans if q == k and k and t and a and a <= t and (b is None or t < b or closed and t == b)]
        want += [(i, n) for n in held] or ([(i, None)] if how == "left" else [])
    assert got == sorted(want, key=str) and len(got) > 300


@pytest.mark.parametrize("closed", [False, True])
def test_interval_totals_are_those_of_the_pairs(spark, closed):
    """Equal points stay apart; totals are begun before any shuffle by point."""
    rng = random.Random(3)
    points = [(i // 2, rng.choice(["hot", "hot", "a", None]), at(rng.randrange(3000) / 2)) for i in range(120)] + [(90, "alone", at(1)), (90, "alone", at(1)), (91, "hot", None)]
    spans = [(rng.choice(["hot", "a", None]), rng.choice([None, at(rng.randrange(3000) / 2)]), rng.choice([None, at(rng.randrange(4000) / 2)]), i) for i in range(150)]
    p = spark.createDataFrame(points, "id int, k string, t timestamp_ntz")
    s = spark.createDataFrame(spans, "k string, a timestamp_ntz, b timestamp_ntz, t int")
    got = intervals.interval_totals(p, s, ["k"], "t", "a", "b", {"n": F.count("a"), "sum": F.sum("t")}, closed=closed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, k, t in points:
        held = [n for q, a, b, n in spans if q == k and k and t and a and a <= t and (b is None or t < b or closed and t == b) and (b is None or b > a or closed and b == a)]
        want.append((i, k, t, len(held), sum(held) if held else None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and sum(w[3] for w in want) > 500
    partial = plan.index("partial_count")  # reads from the bottom: the join of pairs, then totals, then the shuffle by point
    assert "hashpartitioning(_match" in plan[:partial] and "hashpartitioning(_match" not in plan[partial:]


def test_identical_restatements_without_a_window(spark):
    rows = [("a", at(1), 5), ("a", at(2), 5), ("a", at(0), None), ("a", at(3), None), ("b", at(1), 1), ("b", at(1), 2), ("b", at(2), 1), ("c", None, 3), ("c", at(1), 4), ("c", at(2), 3), ("d", at(1), 7), (None, at(1), 8), (None, at(9), 8)]
    d = spark.createDataFrame(rows, "k string, t timestamp_ntz, x int")
    got = quality.identical_restatements(d, ["k"], ["x"], "t")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2), ("b", 2), ("c", 2), (None, 2)], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_count" in plan


def test_interval_join_of_nothing(spark):
    p = spark.createDataFrame([(1, "a", at(0))], "id int, k string, t timestamp_ntz")
    s = spark.createDataFrame([], "k string, a timestamp_ntz, b timestamp_ntz")
    assert intervals.interval_join(p, s, ["k"], "t", "a", "b").count() == 0
    assert intervals.interval_join(p, s, ["k"], "t", "a", "b", how="left").count() == 1


def test_splits_are_taken_without_a_join(spark):
    bars = spark.createDataFrame([("e", at(d), 100.0, 10.0) for d in range(6)] + [("f", at(0), 8.0, 1.0)], "entity_id string, event_time timestamp_ntz, close double, volume double")
    actions = spark.createDataFrame([("e", at(2), at(2), 2.0), ("e", at(4), at(4), 3.0), ("e", at(4), at(5), 4.0), ("e", at(4), at(5), 5.0), ("e", at(5), at(5), -1.0)],
                                    "entity_id string, effective_date timestamp_ntz, availability_time timestamp_ntz, ratio double")
    out = panel.adjust_splits(bars, actions)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.entity_id, (r.event_time - T0).days): (r.close, r.volume, r.close_raw) for r in out.collect()}
    assert got["e", 1] == pytest.approx((10.0, 100.0, 100.0)) and got["e", 2] == pytest.approx((20.0, 50.0, 100.0))
    assert got["e", 4] == (100.0, 10.0, 100.0) and got["f", 0] == (8.0, 1.0, 8.0)
