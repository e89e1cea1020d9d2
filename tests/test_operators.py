"""Semantics of single operators on small hand-made inputs."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import normalize, windows as w
from tidemark.operators import asof, evaluation, lifecycle, outcomes, panel, quality, rank, reads, states
from tidemark.sources import io, sinks

T = lambda d, h=0: dt.datetime(2024, 1, d, h)


def panel_of(spark, values, entity="a"):
    rows = [(entity, T(1) + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity_id string, event_time timestamp, x double").withColumn("_bar", F.row_number().over(w.history()).cast("double"))


def values(df, expr):
    return [r.v for r in df.withColumn("v", expr).orderBy("event_time").collect()]


def test_rolling_needs_full_windows(spark):
    x = [1, 2, None, 4, 5, 6, 7]
    s = pd.Series(x, dtype=float)
    p = panel_of(spark, x)
    for mine, theirs in ((w.mean, s.rolling(3).mean()), (w.std, s.rolling(3).std()), (w.highest, s.rolling(3).max())):
        got = values(p, mine(F.col("x"), 3))
        assert np.allclose(np.array(got, dtype=float), theirs.to_numpy(), equal_nan=True)


def test_comparison_with_null_is_false(spark):
    p = panel_of(spark, [None, 1, 2, 3])
    assert values(p, w.share(F.col("x") > 1, 2)) == [None, 0.0, 0.5, 1.0]


def test_extremes_take_the_first_tie(spark):
    p = w.extremes(panel_of(spark, [5, 1, 5, 2]), "x", 4)
    assert values(p, F.col("_since_max"))[-1] == 3
    assert values(p, F.col("_after_max"))[-1] == 1
    assert values(w.extremes(panel_of(spark, [1, 2, 3]), "x", 3), F.col("_after_max"))[-1] == 3


def test_extremes_equal_a_look_at_every_window(spark):
    rng = np.random.default_rng(5)
    x = [None if i in (40, 41, 90) else int(v) for i, v in enumerate(rng.integers(0, 6, 160))]  # few values, so many ties
    p = panel_of(spark, x)
    for n in (1, 2, 3, 7, 8, 21):
        got = w.extremes(p, "x", n).orderBy("event_time").select("_highest", "_lowest", "_since_max", "_since_min", "_after_max").collect()
        for i, r in enumerate(got):
            v = x[i - n + 1 : i + 1] if i >= n - 1 else [None]
            if None in v:
                assert tuple(r) == (None,) * 5
                continue
            top, bottom = v.index(max(v)), v.index(min(v))
            assert tuple(r) == (max(v), min(v), n - 1 - top, n - 1 - bottom, min(v[top + 1 :], default=max(v)))


def test_percentile_rank_divides_by_the_window(spark):
    assert values(panel_of(spark, [1, None, 3]), w.percentile_rank(F.col("x"), 3))[-1] == 2 / 3
    assert values(panel_of(spark, [1, 3, None]), w.percentile_rank(F.col("x"), 3))[-1] == 0.0


def test_slope_matches_polyfit(spark):
    x = [3, 1, 4, 1, 5, 9, 2]
    got = values(panel_of(spark, x), w.slope(F.col("x"), 4))
    assert got[:3] == [None] * 3
    for i in range(3, 7):
        assert abs(got[i] - np.polyfit(range(4), x[i - 3 : i + 1], 1)[0]) < 1e-9


def facts(spark):
    rows = [("a", T(1), 10.0, T(2)), ("a", T(1), 99.0, T(5)), ("b", T(1), 1.0, T(9))]
    return spark.createDataFrame(rows, "entity_id string, event_time timestamp, close double, availability_time timestamp")


def test_restatements_do_not_leak(spark):
    f = facts(spark)
    for at, want in ((T(5) - dt.timedelta(microseconds=1), 10.0), (T(5), 99.0), (T(1), None)):
        got = asof.latest(f.where("entity_id = 'a'"), ["entity_id", "event_time"], at).collect()
        assert (got[0].close if got else None) == want
    assert asof.why_empty(f.where("entity_id = 'b'"), T(3)).first().reason == "not_yet_available"


def test_intervals_are_half_open(spark):
    i = spark.createDataFrame([("a", T(1), T(3)), ("a", T(3), None)], "k string, valid_from timestamp, valid_to timestamp")
    assert asof.valid_at(i, T(3)).count() == 1
    assert asof.valid_at(i, T(3)).first().valid_to is None


def test_asof_join_takes_the_newest_at_or_before(spark):
    left = spark.createDataFrame([("a", T(2)), ("a", T(4)), ("b", T(4))], "k string, t timestamp")
    right = spark.createDataFrame([("a", T(2), 1), ("a", T(3), 2), ("a", T(5), 3)], "k string, u timestamp, v int")
    got = {(r.k, r.t): r.v for r in asof.asof_join(left, right, "k", "t", "u").collect()}
    assert got == {("a", T(2)): 1, ("a", T(4)): 2, ("b", T(4)): None}


def test_splits_adjust_bars_before_their_day_once(spark):
    bars = spark.createDataFrame([("a", T(1), 100.0, 10.0), ("a", T(3), 50.0, 20.0)], "entity_id string, event_time timestamp, close double, volume double")
    actions = spark.createDataFrame([("a", T(2), 2.0, T(2)), ("a", T(2), 2.0, T(4))], "entity_id string, effective_date timestamp, ratio double, availability_time timestamp")
    got = {r.event_time: (r.close, r.close_raw, r.volume) for r in panel.adjust_splits(bars, actions).collect()}
    assert got == {T(1): (50.0, 100.0, 20.0), T(3): (50.0, 50.0, 20.0)}


def test_percent_rank_averages_ties(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, 2.0, None])], "i int, x double")
    got = {r.i: r.p for r in rank.percent_rank(df, "x", "p").collect()}
    assert np.allclose([got[0], got[1], got[2]], [1 / 3, 2.5 / 3, 2.5 / 3]) and got[3] is None


def test_candidates_and_reasons(spark):
    rows = [(f"e{i:02}", -0.01 * (i + 1), 1.0, 1.0, 0.1, 0.5) for i in range(20)] + [("up", 0.0, 1.0, 1.0, 0.1, 0.5), ("thin", -0.5, None, None, None, None)]
    df = spark.createDataFrame(rows, "entity_id string, " + ", ".join(f"{c} double" for c in rank.COMPONENTS))
    got = {r.entity_id: r.reason for r in rank.detect_candidates(df).collect()}
    assert got["up"] == "not_in_decline" and got["thin"] == "sparse"
    assert [k for k, v in sorted(got.items()) if v is None] == ["e18", "e19"]


def test_thin_evidence_has_no_state(spark):
    names = sorted({i for _, inputs in states.STATES for i in inputs})
    rows = [{n: None for n in names} | {"k": "thin"}, {n: 0.0 for n in names} | {"k": "up", "resistance_breakout_pct": 0.1, "acceptance_followthrough": 0.5, "momentum_improvement": 1.0}]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names))
    got = {r.k: (r.state, r.unmatched) for r in states.classify(df).collect()}
    assert got == {"thin": (None, "thin_evidence"), "up": ("UPTREND", None)}


def test_stop_wins_on_the_same_bar(spark):
    bars = [("a", T(1), 100.0, 100.0, 100.0, 2.0), ("a", T(2), 104.0, 98.0, 101.0, 2.0), ("a", T(3), 110.0, 100.0, 109.0, 2.0)]
    b = spark.createDataFrame(bars, "entity_id string, event_time timestamp, high double, low double, close double, atr double")
    c = spark.createDataFrame([("c", "a", T(1))], "case_id string, entity_id string, detected_at timestamp")
    r = outcomes.measure(c, b).first()
    assert (r.status, r.bars, r.bars_to_mfe) == ("FAILED", 2, 2) and abs(r.mfe - 0.1) < 1e-9


def test_radius_search_is_brute_force_over_all_values(spark, tmp_path, monkeypatch):
    from tidemark.operators import similarity
    from tidemark.plans import catalog

    rng = np.random.default_rng(0)
    v = rng.normal(0, 1, (120, 64)).astype(np.float32)
    v[51] = np.concatenate([v[50][:16], 30 * v[51][16:]])  # near in the first 16 values alone
    v[52] = v[50] + 0.01
    spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = v.astype(float)
    scale = np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)
    for most in (100_000, 1):
        monkeypatch.setattr(similarity, "MAX_QUERIES", most)
        got = {r.query_id: (r.n, round(r.nearest, 9)) for r in catalog.queries()["e7_radius_search"](spark, str(tmp_path)).collect()}
        want = {}
        for i in (0, 50, 100):
            d = np.sqrt((((x[i] - x) / scale) ** 2).mean(1))
            want[i] = ((d <= similarity.RADIUS).sum(), round(d.min(), 9))
        assert got == want


def test_lifecycle_moves_forward(spark):
    o = [("a", T(1), "ACCUMULATION", 10.0, 10.0), ("a", T(2), "ACCUMULATION", 70.0, 60.0), ("a", T(3), "BREAKOUT_READY", 70.0, 60.0), ("a", T(4), "UPTREND", 70.0, 60.0)]
    df = spark.createDataFrame(o, "entity_id string, at timestamp, state string, score double, confidence double")
    got = [(r.case_number, r.status) for r in lifecycle.advance(df).orderBy("at").collect()]
    assert got == [(1, "DETECTION"), (1, "QUALIFICATION"), (1, "ACTIVE"), (1, "CONCLUDED")]


def test_lifecycle_holds_no_history_whole(spark):
    states_ = ["ACCUMULATION", "ACCUMULATION", "BREAKOUT_READY", "UPTREND"]
    rows = [(e, T(1) + dt.timedelta(days=i), states_[i % 4], 70.0, 60.0) for i in range(40) for e in ("a", "b", None)]
    df = spark.createDataFrame(rows[::-1], "entity_id string, at timestamp, state string, score double, confidence double")
    plan = lifecycle.advance(df)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # histories cross batches
    try:
        got = lifecycle.advance(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    for e in ("a", "b", None):
        mine = sorted((r.at, r.case_number, r.status, r.sequence_number) for r in got if r.entity_id == e)
        assert [x[1:] for x in mine] == [(1 + i // 4, s, i % 4) for i, s in enumerate(["DETECTION", "QUALIFICATION", "ACTIVE", "CONCLUDED"] * 10)]


def test_score_below_first_bucket_is_in_none(spark):
    df = spark.createDataFrame([(19.9,), (20.0,), (90.0,), (100.0,)], "s double").select("s", evaluation.score_bucket(F.col("s")).alias("b"))
    assert [r.b for r in df.orderBy("s").collect()] == [None, 20, 90, 90]


def test_calendar():
    assert quality.easter(2024) == dt.date(2024, 3, 31)
    assert {dt.date(2024, 1, 1), dt.date(2024, 3, 29), dt.date(2024, 11, 28), dt.date(2021, 7, 5)} <= quality.holidays(2024) | quality.holidays(2021)


def test_normalisation(spark):
    df = spark.createDataFrame([("P-Purchase", "items 2.02, 9.01 and 2.02", "2024-07-01", '{"numerator": 2, "denominator": 1}')], "code string, text string, d string, j string")
    r = df.select(normalize.transaction_code(F.col("code")), normalize.item_numbers(F.col("text")), normalize.session_close(F.to_date("d")), normalize.split_ratio(F.col("j"))).first()
    assert tuple(r) == ("P", ["2.02", "9.01"], dt.datetime(2024, 7, 1, 20), 2.0)


def test_first_write_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (None, "m")], "k int, v string")
    assert io.append_new(spark, a, path, ["k"]) == 2
    assert io.append_new(spark, b, path, ["k"]) == 1
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "x"), (None, "n"), (2, "z")}


def test_envelopes(spark):
    df = spark.createDataFrame([('{"data": [{"a": 1}, {"a": 2}]}',), ('[{"a": 3}]',), ('{"Error Message": "no"}',)], "j string")
    assert sorted(r.a for r in io.unwrap(df, "j", "a int").collect()) == [1, 2, 3]


def test_wilson_without_trials_is_everything(spark):
    from tidemark.operators.evaluation import wilson

    low, high = wilson(F.col("s"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (5, 10)], "s long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert tuple(got[0]) == (0.0, 1.0) and 0.2 < got[1].l < 0.5 < got[1].h < 0.8


def test_validate_bars_knows_actions_and_duplicates(spark):
    import datetime as dt

    from tidemark.operators.quality import validate_bars

    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, day(1), 10.0), (1, day(2), 20.0), (1, day(3), 5.0), (1, day(3), 5.0)]
    bars = spark.createDataFrame([(e, t, c, c, c, c, 1) for e, t, c in rows], "entity_id int, event_time timestamp, open double, high double, low double, close double, volume long")
    actions = spark.createDataFrame([(1, day(2))], "entity_id int, effective_date timestamp")
    got = validate_bars(bars, actions).orderBy("event_time", "accepted").collect()
    assert [r.jump for r in got] == [False, False, False, True] and [list(r.fatal) for r in got] == [[], [], ["duplicate"], []]


def test_lifecycle_gates_and_retreats(spark):
    import datetime as dt

    from tidemark.operators import lifecycle

    steps = [("CONSOLIDATION", 70.0, 60.0, None, 0), ("CONSOLIDATION", None, 60.0, None, 0), ("CONSOLIDATION", 70.0, 60.0, None, 0), ("BREAKOUT_READY", 70.0, 60.0, None, 1),
             ("CONSOLIDATION", 70.0, 60.0, None, 2), ("CONSOLIDATION", 70.0, 60.0, None, 2), ("CONSOLIDATION", 70.0, 60.0, "LOST_ELIGIBILITY", 2), ("ACCUMULATION", 70.0, 60.0, "INELIGIBLE", 2)]
    rows = [(1, dt.datetime(2024, 1, 1 + i), *s) for i, s in enumerate(steps)]
    schema = "entity_id int, at timestamp, state string, score double, confidence double, decision string, backward_transitions int"
    got = [(r.at.day, r.status, r.reason) for r in lifecycle.advance(spark.createDataFrame(rows, schema)).orderBy("at").collect()]
    assert got == [(1, "DETECTION", "consolidation"), (3, "QUALIFICATION", "score"), (4, "ACTIVE", "breakout_ready"), (5, "ACTIVE", "retreat"), (7, "CONCLUDED", "lost_eligibility")]


def test_lifecycle_stream_gives_what_the_batch_gives(spark, tmp_path):
    import datetime as dt

    from tidemark.operators import lifecycle

    states = ["CONSOLIDATION", "CONSOLIDATION", "BREAKOUT_READY", "UPTREND", "ACCUMULATION"]
    rows = [(e, dt.datetime(2024, 1, 1 + i), s, 70.0, 60.0) for e in (1, 2) for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "entity_id int, at timestamp, state string, score double, confidence double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lifecycle.advance_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    columns = ["entity_id", "case_number", "at", "status", "reason"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    assert got == sorted(map(tuple, lifecycle.advance(df).select(*columns).collect())) and len(got) == 10


def test_exchanges_and_codes(spark):
    from tidemark.functions import normalize

    names = {"NYSE ARCA": "NYSE_ARCA", "American Stock Exchange": "NYSE_AMERICAN", "Pink": "OTC", "NDQ": "NASDAQ", " new  york stock exchange": "NYSE", "Moon": "UNKNOWN"}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.x for r in df.select("n", normalize.exchange(F.col("n")).alias("x")).collect()} == names


def test_terminal_and_event_records(spark):
    from tidemark.functions import translate

    raw = spark.createDataFrame([('{"symbol":"aa","date":"2024-01-02","gradingCompany":"X","newGrade":"Buy"}',), ('{"symbol":"bb","gradingCompany":"Y"}',)], "payload string")
    good, bad = translate.quarantine(translate.terminal(raw, "grade"))
    assert [(r.symbol, r.firm, r.after) for r in good.collect()] == [("AA", "X", "Buy")] and [r.rejected for r in bad.collect()] == ["no_time"]
    insider = spark.createDataFrame([('{"symbol":"aa","transactionDate":"2024-01-02","transactionType":"P-Purchase","securitiesTransacted":"5"}',)], "payload string")
    r = translate.insider_trades(insider).first()
    assert (r.transaction_code, r.quantity, str(r.observation_time), r.rejected) == ("P", 5.0, "2024-01-04 00:00:00", None)
    held = spark.createDataFrame([('{"symbol":"aa","year":2024,"quarter":1,"investorsHolding":7}',), ('{"symbol":"aa","year":2024,"quarter":9}',)], "payload string")
    h = translate.holdings(held).collect()
    assert str(h[0].observation_time) == "2024-05-15 00:00:00" and h[0].investors == 7 and h[1].rejected == "no_quarter"
    filing = spark.createDataFrame([('{"symbol":"aa","acceptedDate":"2024-01-02 10:00:00","items":"Item 5.02, Item 1.01 and 5.02"}',)], "payload string")
    assert translate.filings(filing).first().items == ["5.02", "1.01"]


def test_sinks(spark, tmp_path):
    from tidemark.sources import sinks

    s = spark.createDataFrame([(1, "2024-01-01", "v1", None), (1, "2024-01-01", "v1", None), (2, "2024-01-01", "v1", 7)], "entity_id int, scan_date string, version string, supersedes int")
    assert sinks.append_signals(spark, s, str(tmp_path / "s")) == 2 and sinks.append_signals(spark, s, str(tmp_path / "s")) == 0
    f = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), (None, "z")], "link string, title string")
    assert sinks.append_linked(spark, f, str(tmp_path / "f"), "link", ["link"], ["title"]) == 2
    v = spark.createDataFrame([(1, 1, 0.5, None), (2, 1, None, None)], "entity_id int, event_time int, x double, y double")
    assert [r.features for r in sinks.vector_rows(v, ["x", "y"], "1").collect()] == ['{"x":0.5}']
    p = spark.createDataFrame([("a", 1), ("b", 2)], "chart string, n int")
    sinks.replace_partition(p, str(tmp_path / "p"), "chart")
    sinks.replace_partition(p.where("chart = 'a'").withColumn("n", F.lit(9)), str(tmp_path / "p"), "chart")
    assert {(r.chart, r.n) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 9), ("b", 2)}


def test_as_of_dispatch(spark):
    import datetime as dt

    from tidemark.operators import identity

    day = lambda d: dt.datetime(2024, 1, d)
    bars = spark.createDataFrame([(1, day(1), day(2), 10.0), (1, day(1), day(5), 11.0)], "entity_id int, event_time timestamp, availability_time timestamp, close double")
    at = lambda d: identity.as_of({"bar": bars}, "bar", [1], day(d)).collect()
    assert [r.close for r in at(3)] == [10.0] and [r.close for r in at(6)] == [11.0] and at(1) == []


def test_outstanding_pairs_of_packs_of_receivers(spark, monkeypatch):
    monkeypatch.setattr(states, "PACK", 3)
    m = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "m string")
    r = spark.createDataFrame([(i,) for i in range(10)] + [(1,)], "r long")
    sent = [("a", i) for i in range(10)] + [("a", 77), ("b", 3), ("b", 3), ("b", 78)]
    s = spark.createDataFrame(sent, "m string, r long")
    want = {(x, i) for x in "abc" for i in range(10)} - set(sent)
    got = [tuple(x) for x in states.outstanding(m, r, s, "m", "r").collect()]
    assert len(got) == len(want) and set(got) == want
    assert states.outstanding(m, r.where("false"), s, "m", "r").count() == 0
    assert states.outstanding(m, r, s.where("false"), "m", "r").count() == 30


def test_ties_go_to_the_order_of_the_other_columns(spark):
    rows = [("k", 1, 5, x) for x in (2, 9, 4)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, "k string, p int, seen int, x int").repartition(3)
        assert [r.x for r in reads.per_period(df, "k", "p", "seen").collect()] == [9]
        assert [r.x for r in sinks.projection(df, "k", ["p", "seen"]).collect()] == [9]
        assert [r.x for r in evaluation.first_source(df, df.withColumn("x", F.lit(1)), key="k").collect()] == [2]
