"""Evaluation reports: the metric suite per split, breakdowns, and published charts.

Rows are evaluated cases: case_id, entity_id, detected_at, concluded_at, signal_id (null: not
committed to), score, status, mfe, mae, relative_return, regime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import store
from .evaluation import Z95, score_bucket, wilson
from .evidence import RESOLVED, evidence_scope
from .quantiles import drawdown, join_on, percentiles
from .rank import running

MEDIANS = ["relative_return", "mfe", "mae"]
STATUSES = ["SUCCESS", "FAILED", "EXPIRED", "INVALIDATED", "NO_VALID_OUTCOME"]
FLOOR, PUBLIC_FLOOR, POINTS, TOP, TOP_RETURN = 20, 30, 2000, 20, 0.5


def metric_suite(cases: DataFrame, by: list[str] | None = None, *, floor: int = FLOOR) -> DataFrame:
    """One row per group: sample size, confusion counts, counts by status; below the floor all other
    metrics are null. Returns, excursions and drawdown are those of committed cases."""
    by = by or []
    took = F.col("signal_id").isNotNull()
    resolved, won = F.col("status").isin(RESOLVED), F.col("status") == "SUCCESS"
    rel = F.when(took, F.col("relative_return"))
    mfe, mae = F.when(took, F.col("mfe")), F.when(took, F.col("mae"))
    medians = percentiles(cases.where(took).select(*by, *[F.col(c).alias("_q_" + c) for c in MEDIANS]), ["_q_" + c for c in MEDIANS], [0.5], by)
    line = cases.where(took).select(*by, "detected_at", "case_id", F.coalesce("relative_return", F.lit(0.0)).alias("_x"))
    falls = drawdown(line, "_x", ["detected_at", "case_id"], by)
    d = cases.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(resolved & took & won).alias("tp"), F.count_if(resolved & took & ~won).alias("fp"),
        F.count_if(resolved & ~took & won).alias("fn"), F.count_if(resolved & ~took & ~won).alias("tn"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in STATUSES],
        F.count(rel).alias("_k"), F.count_if(rel > 0).alias("_hits"), F.avg(rel).alias("expectancy"), F.stddev_samp(rel).alias("_sd"),
        F.avg(mfe).alias("mean_mfe"), F.avg(mae).alias("mean_mae"), F.min(mae).alias("worst_mae"))
    for found in (medians, falls):
        d = join_on(d, found, by, "left") if by else d.join(F.broadcast(found), F.lit(True), "left")
    d = d.withColumns({f"median_{c}": F.get("_q_" + c, F.lit(0)) for c in MEDIANS})
    div = lambda a, b: a / F.nullif(b, F.lit(0))
    half = F.when(F.col("_k") >= 2, Z95 * F.col("_sd") / F.sqrt("_k")).otherwise(0.0)
    tp, fp, fn, tn, k, hits = (F.col(c) for c in ("tp", "fp", "fn", "tn", "_k", "_hits"))
    d = d.withColumns({
        "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "false_positive_rate": div(fp, fp + tn), "hit_rate": div(hits, k),
        "precision_low": wilson(tp, tp + fp)[0], "precision_high": wilson(tp, tp + fp)[1], "recall_low": wilson(tp, tp + fn)[0], "recall_high": wilson(tp, tp + fn)[1],
        "hit_low": wilson(hits, k)[0], "hit_high": wilson(hits, k)[1],
        "expectancy_low": F.col("expectancy") - half, "expectancy_high": F.col("expectancy") + half, "mfe_mae_ratio": div(F.col("mean_mfe"), F.abs("mean_mae"))})
    always = [*by, "n", "tp", "fp", "fn", "tn", *[f"n_{s.lower()}" for s in STATUSES]]
    gated = [c for c in d.columns if c not in always and not c.startswith("_")]
    return d.select(*always, (F.col("n") >= floor).alias("sufficient"), *[F.when(F.col("n") >= floor, F.col(c)).alias(c) for c in gated])


def regimes(cases: DataFrame) -> DataFrame:
    return cases.withColumn("regime", F.coalesce("regime", F.lit("UNRECORDED")))


def by_regime(cases: DataFrame, **options) -> DataFrame:
    return metric_suite(regimes(cases), ["regime"], **options)


def by_evidence_scope(cases: DataFrame, **options) -> DataFrame:
    return metric_suite(evidence_scope(cases), ["evidence_scope"], **options)


def by_regime_and_bucket(cases: DataFrame, **options) -> DataFrame:
    rows = regimes(cases).withColumn("bucket", score_bucket(F.col("score"))).where("bucket is not null")
    return metric_suite(rows, ["regime", "bucket"], **options)


def report(cases: DataFrame, **options) -> DataFrame:
    """All splits in one long table: dimension, key and the suite.

    The cases are read once: each goes to its group of every dimension, and the rows that this gives, with the
    columns a suite needs, are stored for its aggregations."""
    keys = {
        "all": F.lit("all"), "regime": F.coalesce("regime", F.lit("UNRECORDED")), "evidence_scope": F.col("evidence_scope"),
        "bucket": score_bucket(F.col("score")).cast("string"),
    }
    groups = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("key")) for k, v in keys.items()])
    needed = ["case_id", "detected_at", "signal_id", "status", *MEDIANS]
    rows = evidence_scope(cases).select(*needed, F.inline(groups)).where("key is not null")
    return metric_suite(store(rows), ["dimension", "key"], **options)


def win_rate(cases: DataFrame, *, floor: int = PUBLIC_FLOOR) -> DataFrame:
    """Every status with its count and share of all; the share only from the floor on."""
    n = cases.groupBy("status").agg(F.count("*").alias("n"))
    total = cases.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total)).select("status", "n", "total", F.when(F.col("total") >= floor, F.col("n") / F.col("total")).alias("share"))


def cumulative(cases: DataFrame, *, points: int = POINTS) -> DataFrame:
    """The sum of relative returns of committed cases in the order they concluded, thinned to `points`
    points: every nth one, the first and the last among them."""
    rows = cases.where("signal_id is not null and relative_return is not null").withColumn("at", F.coalesce("concluded_at", "detected_at")).where("at is not null")
    order = [F.col("at").asc(), F.col("case_id").asc()]
    line = running(rows.select("at", "case_id", "relative_return"), order, nth=F.lit(1), cumulative_relative_return=F.col("relative_return"))
    total = line.agg(F.count("*").alias("total"))
    line = line.join(F.broadcast(total))
    step = F.col("total") / F.lit(float(points - 1))
    slot = F.ceil((F.col("nth") - 1) / step)  # the first slot whose place is not before this point
    keep = (F.col("total") <= points) | (F.col("nth") == F.col("total")) | ((slot < points - 1) & (F.floor(slot * step) == F.col("nth") - 1))
    return line.where(keep).select("at", "case_id", F.col("nth").cast("bigint").alias("outcome_index"), "cumulative_relative_return")


def top_performers(cases: DataFrame, *, least: float = TOP_RETURN, n: int = TOP) -> DataFrame:
    """The n best successes with a return of `least` or more."""
    return cases.where((F.col("status") == "SUCCESS") & (F.col("realized_return") >= least)).orderBy(F.desc("realized_return"), "case_id").limit(n)


def counts_with_zeros(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """How many rows have each of the stated values, 0 included."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{col} string")
    return every.join(df.groupBy(col).agg(F.count("*").alias("n")), col, "left").select(col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
