"""Operators that spread one large group over many tasks, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, quantiles, rank, reports


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(3000):
        kind = i % 4
        x = [rng.gauss(0, 1), float(rng.randrange(3)), rng.choice([1e300, -1e300, 1e-300, 0.0, -0.0]), None if i % 3 else rng.random()][kind]
        y = None if i % 5 == 0 else rng.expovariate(1)
        out.append((i, ["a", None, "c", "d"][kind], x, y))
    return [*out, (3000, "few", 1.5, None), (3001, "few", 2.5, None), (3002, "none", None, None)]


@pytest.mark.parametrize("gather", [1, 40, 100_000])
def test_percentiles(spark, rows, gather):
    df = spark.createDataFrame(rows, "i int, g string, x double, y double")
    probabilities = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r for r in quantiles.percentiles(df, ["x", "y"], probabilities, ["g"], gather=gather).collect()}
    assert "none" not in got and len(got) == 5
    for g in {r[1] for r in rows} - {"none"}:
        for k, name in ((2, "x"), (3, "y")):
            values = [r[k] for r in rows if r[1] == g and r[k] is not None]
            have = got[g][name]
            if not values:
                assert have is None or have == [None] * 5
                continue
            assert have == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12, abs=1e-300)
    whole = quantiles.percentiles(df, ["y"], [0.5], gather=gather).first()["y"][0]
    assert whole == pytest.approx(np.median([r[3] for r in rows if r[3] is not None]), rel=1e-12)
    assert quantiles.percentiles(df.where("false"), ["x"], [0.5], gather=gather).count() == 0


def test_percentiles_put_nan_last_and_pass_over_heavy_values(spark):
    values = [1.0] * 500 + [2.0] * 499 + [float("nan")]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = quantiles.percentiles(df, ["x"], [0.0, 499.5 / 999, 0.6, 1.0], gather=10).first()["x"]
    assert got[:3] == [1.0, 1.5, 2.0] and math.isnan(got[3])


def test_no_task_sorts_a_large_group(spark, rows):
    """The selecting plan has no exact percentile, and cells are gathered only below the bound."""
    df = spark.createDataFrame(rows, "i int, g string, x double, y double")
    plan = quantiles.percentiles(df, ["x"], [0.5], gather=10)._jdf.queryExecution().toString()
    assert "percentile(" not in plan


@pytest.mark.parametrize("by", [None, ["g"]])
def test_drawdown(spark, by):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], rng.choice([None, rng.gauss(0, 1)])) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, g string, x double")
    got = {r["g"] if by else None: r["max_drawdown"] for r in quantiles.drawdown(df, "x", ["i"], by).collect()}
    for g in "ab" if by else [None]:
        line = np.cumsum([x for _, k, x in sorted(rows) if x is not None and g in (None, k)])
        assert got[g] == pytest.approx((line - np.maximum.accumulate(line)).min(), abs=1e-9)
    rising = df.where("i < 3").select("i", F.lit(1.0).alias("x"))
    assert quantiles.drawdown(rising, "x", ["i"]).first()["max_drawdown"] == 0.0


def test_metric_suite_without_groups_has_a_drawdown(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, 1, at + dt.timedelta(days=i), at, i if i % 4 else None, 50.0, "SUCCESS" if i % 3 else "FAILED", 0.2, -0.1, (-1) ** i * i / 10, "R") for i in range(30)]
    cases = spark.createDataFrame(rows, "case_id int, entity_id int, detected_at timestamp, concluded_at timestamp, signal_id int, score double, status string, mfe double, mae double, relative_return double, regime string")
    one, grouped = reports.metric_suite(cases).first(), reports.metric_suite(cases.withColumn("key", F.lit("x")), ["key"]).first()
    line = np.cumsum([r[9] for r in rows if r[4] is not None])
    assert one["max_drawdown"] == pytest.approx((line - np.maximum.accumulate(line)).min()) == grouped["max_drawdown"]
    assert one["median_relative_return"] == pytest.approx(np.median([r[9] for r in rows if r[4] is not None]))


def test_report_reads_its_cases_once(spark):
    rows = [(i, i % 3, dt.datetime(2024, 1, 1), i, float(i % 101), "SUCCESS", 0.2, -0.1, 0.1, None) for i in range(200)]
    cases = spark.createDataFrame(rows, "case_id int, entity_id int, detected_at timestamp, signal_id int, score double, status string, mfe double, mae double, relative_return double, regime string")
    out = reports.report(cases)
    assert {(r.dimension, r.key): r.n for r in out.collect()}["all", "all"] == 200
    assert "LocalTableScan" not in out._jdf.queryExecution().toString() and "Scan ExistingRDD" not in out._jdf.queryExecution().toString()


def test_walk_forward_has_all_windows(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2000-01-01', DATE '2012-12-31')) AS day")
    out = evaluation.walk_forward(days, "day", "2000-01-01", "2012-12-31", train=2, test=1, step=2)
    span = (dt.date(2012, 12, 31) - dt.date(2000, 1, 1)).days
    assert out.select("window").distinct().count() == (span - 3) // 2 + 1 > 1000
    assert evaluation.walk_forward(days, "day", "2012-12-30", "2012-12-31").count() == 0


def test_quantile_buckets_of_nothing(spark):
    out = rank.quantile_buckets(spark.createDataFrame([(1, None), (2, None)], "i int, x double"), "x", "b").collect()
    assert [r.b for r in out] == [None, None]
