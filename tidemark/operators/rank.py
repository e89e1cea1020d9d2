"""Cross-section ranking, candidate detection and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import store
from .quantiles import percentiles


def percent_rank(df: DataFrame, col: str, out: str, *, descending: bool = False, by: list[str] | None = None) -> DataFrame:
    """Percentile rank with average ties over rows with a value; nulls stay null.

    Counts per value are aggregated first. Without `by` the values are ranged over partitions and
    each range starts at the count of the ranges before it, so no task sees all of them."""
    keys = by or []
    per = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    order = F.col(col).desc() if descending else F.col(col).asc()
    if keys:
        w = Window.partitionBy(*keys).orderBy(order)
        up_to = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        ranked = per.withColumn("_to", up_to).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    else:
        ranked = running(per, [order], _to=F.col("_n")).join(F.broadcast(per.agg(F.sum("_n").alias("_all"))))
    ranked = ranked.select(*keys, col, ((F.col("_to") - F.col("_n") + (F.col("_n") + 1) / 2) / F.col("_all")).alias(out))
    return df.join(ranked, [*keys, col], "left")


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Adds, by name, sums of the values so far in one global order. Ranges of rows are summed by
    themselves and start at the sums of the ranges before them, so no task sees all rows.

    Ranges are stored with their numbers, as they are read twice and bounds drawn anew might differ."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(df.withColumns({f"_v_{k}": v for k, v in values.items()}).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranged.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values]).select(
        "_range", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in values])
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"_v_{k}": F.sum(f"_v_{k}").over(w) for k in values}).join(F.broadcast(starts), "_range")
    return out.withColumns({k: F.col(f"_s_{k}") + F.col(f"_v_{k}") for k in values}).drop("_range", *[f"_{x}_{k}" for k in values for x in "vs"])


def top_fraction(df: DataFrame, col: str, fraction: float, tie: str) -> DataFrame:
    """The best max(1, half-even round(n * fraction)) rows; ties by id."""
    ranked = df.where(F.col(col).isNotNull())
    n = F.greatest(F.lit(1), F.bround(F.count("*") * fraction)).alias("_k")
    at = running(ranked, [F.desc(col), F.asc(tie)], _nth=F.lit(1))
    return at.join(F.broadcast(ranked.agg(n))).where(F.col("_nth") <= F.col("_k")).drop("_nth", "_k")


#: Components of candidate detection and whether small values rank high.
COMPONENTS = {
    "drawdown_pct": True, "volatility_compression": True, "volume_contraction": True, "higher_low_development": False, "resistance_pressure": False,
}


def detect_candidates(vectors: DataFrame, *, components: dict[str, bool] | None = None, least: int = 2, fraction: float = 0.10) -> DataFrame:
    """entity_id, rank per component, score and reason: `sparse`, `not_in_decline`, `below_cut` or null (a candidate)."""
    components = components or COMPONENTS
    have = sum((F.col(c).isNotNull().cast("int") for c in components), F.lit(0))
    first = next(iter(components))
    out = vectors.withColumn(
        "reason", F.when(have < least, "sparse").when(~(F.col(first) < 0) | F.col(first).isNull(), "not_in_decline"))
    pool = out.where("reason is null")
    for c, small in components.items():
        pool = percent_rank(pool, c, f"rank_{c}", descending=small)
    ranks = [F.col(f"rank_{c}") for c in components]
    n = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    pool = pool.withColumn("score", sum((F.coalesce(r, F.lit(0.0)) for r in ranks), F.lit(0.0)) / n)
    best = top_fraction(pool, "score", fraction, "entity_id").select(F.col("entity_id").alias("_id"))
    pool = pool.join(best, F.col("entity_id") == F.col("_id"), "left").withColumn("reason", F.when(F.col("_id").isNull(), "below_cut")).drop("_id")
    return pool.unionByName(out.where("reason is not null"), allowMissingColumns=True)


CRITICAL = ["drawdown_pct", "atr", "realized_volatility", "rvol", "avg_dollar_volume"]


def gates(rows: DataFrame, *, features: list[str], min_history: float = 1.0, min_complete: float = 0.70, min_volume: float = 50_000.0, min_analogues: int = 5) -> DataFrame:
    """One row per entity and gate: gate, passed, detail. Columns read: history_coverage, the features,
    avg_dollar_volume, analogues, distress (number of signals), listing_status, evidence_known."""
    complete = sum((F.col(f).isNotNull().cast("double") for f in features), F.lit(0.0)) / len(features)
    critical = F.lit(True)
    for f in CRITICAL:
        critical = critical & (F.col(f).isNotNull() if f in features else F.lit(True))
    checks = {
        "DATA_HISTORY": F.col("history_coverage") >= min_history,
        "DATA_QUALITY": (complete >= min_complete) & critical,
        "LIQUIDITY": F.col("avg_dollar_volume") >= min_volume,
        "BANKRUPTCY": F.col("distress") < 2,
        "MIN_ANALOGUES": F.col("analogues") >= min_analogues,
        "VALID_IDENTITY": F.col("listing_status").isin("LISTED", "SUSPENDED") & F.col("evidence_known"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    return rows.select("entity_id", F.inline(each))


def distress_signals(f: DataFrame) -> DataFrame:
    """Adds distress: how many of four warnings a company's latest statements raise."""
    flags = [
        F.col("equity") < 0,
        (F.col("operating_cash_flow") < 0) & (F.col("cash") / F.abs("operating_cash_flow") < 4),
        F.col("total_debt") / F.nullif(F.col("total_assets"), F.lit(0.0)) > 0.9,
        F.col("shares") / F.nullif(F.col("shares_year_ago"), F.lit(0.0)) - 1 > 1.0,
    ]
    return f.withColumn("distress", sum((F.coalesce(x, F.lit(False)).cast("int") for x in flags), F.lit(0)))


def quantile_buckets(df: DataFrame, col: str, out: str, probabilities=(0.25, 0.5, 0.75)) -> DataFrame:
    """Right-closed quantile buckets from 0, equal edges merged; null stays null."""
    found = percentiles(df.select(F.col(col).alias("_q")), ["_q"], [0.0, *probabilities, 1.0])
    edges = found.agg(F.array_distinct(F.any_value("_q")).alias("_e"))  # a row in any case
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    bucket = F.size(F.filter(inner, lambda e: F.col(col) > e))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(col).isNotNull(), bucket)).drop("_e")


def peers(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds analogues: other rows with the same key."""
    n = df.groupBy(*keys).agg((F.count("*") - 1).alias("analogues"))
    return df.join(n, keys)


def gate_failures(results: DataFrame) -> DataFrame:
    return results.where("not passed").groupBy("gate").agg(F.count("*").alias("failures"))


def refresh_due(members: DataFrame, last: DataFrame, target: Column, days: dict[str, int]) -> DataFrame:
    """Adds decision: never, escalation (the tier changed), elapsed or current."""
    interval = F.element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), F.col("tier"))
    j = members.join(last.select("entity_id", F.col("tier").alias("last_tier"), "refreshed_on"), "entity_id", "left")
    return j.withColumn(
        "decision",
        F.when(F.col("refreshed_on").isNull(), "never")
        .when(interval < F.element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), F.col("last_tier")), "escalation")
        .when(F.datediff(target, "refreshed_on") >= interval, "elapsed").otherwise("current"))
