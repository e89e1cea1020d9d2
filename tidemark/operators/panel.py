"""Price panels: as-of bars, densified, split-adjusted, resampled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import knowable, latest


def load_panel(bars: DataFrame, as_of, *, actions: DataFrame | None = None, start=None, lookback: int | None = None, period: str = "day") -> DataFrame:
    """Latest knowable version of each bar, on the union of all dates of the panel. With `lookback` only what that many
    bars before as_of (a datetime) can need is read."""
    if start is None and lookback is not None:
        start = history_start(as_of, lookback, period)
    known = bars if start is None else bars.where(F.col("event_time") >= start)
    known = latest(known, ["entity_id", "event_time"], as_of)
    dense = densify(known)
    return adjust_splits(dense, knowable(actions, as_of)) if actions is not None else dense


def load_panel_at(bars: DataFrame, instants: list, *, actions: DataFrame | None = None, lookback: int | None = None, period: str = "day") -> DataFrame:
    """The knowable bars at each of many instants, in one pass: as_of and the columns of bars; with `actions` adjusted for the splits known then.

    A version of a bar is the newest from when it is available until the next one is. So versions are put in order
    once, and each goes to the instants of its span; with `lookback` to those that reach back to it. Of versions available
    at once the last in order of their columns counts."""
    kind = dict(bars.dtypes)["availability_time"]
    others = [c for c in bars.columns if c not in ("entity_id", "event_time", "availability_time")]
    order = Window.partitionBy("entity_id", "event_time").orderBy("availability_time", *others)
    versions = bars.where("availability_time is not null").withColumn("_until", F.lead("availability_time").over(order))
    days = None if lookback is None else F.expr(f"INTERVAL {(instants[0] - history_start(instants[0], lookback, period)).days if instants else 0} DAYS")
    times = F.array(*[F.lit(t).cast(kind) for t in instants]).cast(f"array<{kind}>")

    def sees(t):
        newest = (F.col("availability_time") <= t) & (F.col("_until").isNull() | (F.col("_until") > t))
        return newest if days is None else newest & (F.col("event_time") >= t - days)

    out = versions.withColumn("as_of", F.explode(F.filter(times, sees))).drop("_until")
    if actions is None:
        return out
    known = actions.withColumn("as_of", F.explode(F.filter(times, lambda t: F.col("availability_time") <= t)))
    return adjust_splits(out, known, keys=["as_of", "entity_id"])


def densify(bars: DataFrame) -> DataFrame:
    """One row per entity and event time of the panel; what an entity lacks is null.

    The dates, which the calendar bounds, go to all entities as one array."""
    dates = bars.agg(F.collect_set("event_time").alias("_dates"))
    entities = bars.select("entity_id").distinct()
    every = entities.join(F.broadcast(dates)).select("entity_id", F.explode("_dates").alias("event_time"))
    return every.join(bars, ["entity_id", "event_time"], "left")


def adjust_splits(bars: DataFrame, actions: DataFrame, *, keys=("entity_id",)) -> DataFrame:
    """Divides prices (and multiplies volume) by the ratios of splits that take effect after
    the bar's day. Restatements of an action count once, in their latest version."""
    newest = F.max_by(F.col("ratio").cast("double"), F.struct("availability_time", "ratio"))
    splits = actions.where("ratio > 0").groupBy(*keys, "effective_date").agg(newest.alias("_ratio"))
    splits = splits.select(*keys, F.to_date("effective_date").alias("_d"), F.lit(1).alias("_kind"), "_ratio")
    dated = bars.select(*keys, F.to_date("event_time").alias("_d"), F.lit(0).alias("_kind"), F.struct(*bars.columns).alias("_bar"))
    # from the last day back; bars of a day come before its splits
    later = Window.partitionBy(*keys).orderBy(F.desc("_d"), F.asc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    factor = F.coalesce(F.product(1 / F.col("_ratio")).over(later), F.lit(1.0))
    out = dated.unionByName(splits, allowMissingColumns=True).withColumn("factor", factor).where("_kind = 0").select("_bar.*", "factor")
    f = F.col("factor")
    prices = {c: F.col(c) * f for c in ("open", "high", "low", "close") if c in bars.columns}
    volume = {"volume": F.col("volume") / f} if "volume" in bars.columns else {}
    return out.withColumn("close_raw", F.col("close")).withColumns({**prices, **volume}).drop("factor")


def history_start(as_of, bars: int, period: str = "day"):
    """The date from which `bars` bars before `as_of` are surely covered: calendar days at 1.75 per bar and ten more."""
    from datetime import timedelta

    return as_of - timedelta(days=int(bars * {"day": 1, "week": 5, "month": 21}[period] * 1.75) + 10)


def adjust_all(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Adds *_adjusted: prices times the factors of all splits (1 / ratio) and dividends ((c - amount) / c, c the last
    close before) that take effect after the bar's day, volume times the ratios; six places.

    actions: entity_id, action_type, effective_date, ratio, amount. An action without a usable ratio, amount or
    close counts as none. Bars and actions pass two ordered windows of one partitioning; nothing is joined."""
    b = bars.select("entity_id", F.to_date("event_time").alias("_d"), F.lit(0).alias("_kind"), F.struct(*bars.columns).alias("_bar"), F.col("close").cast("double").alias("_c"))
    a = actions.select("entity_id", F.to_date("effective_date").alias("_d"), F.lit(1).alias("_kind"), "action_type", F.col("ratio").cast("double").alias("ratio"), F.col("amount").cast("double").alias("amount"))
    both = b.unionByName(a, allowMissingColumns=True)
    # an action looks at the closes of days before its own
    before = Window.partitionBy("entity_id").orderBy(F.col("_d"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    close = F.last("_c", ignorenulls=True).over(before)
    both = both.withColumn("_p", close)
    split = (F.col("action_type") == "SPLIT") & (F.col("ratio") > 0)
    paid = (F.col("action_type") == "DIVIDEND") & (F.col("amount") > 0) & (F.col("_p") > 0) & (F.col("amount") < F.col("_p"))
    log = F.when(split, -F.log("ratio")).when(paid, F.log((F.col("_p") - F.col("amount")) / F.col("_p"))).otherwise(0.0)
    both = both.withColumns({"_f": F.coalesce(log, F.lit(0.0)), "_g": F.coalesce(F.when(split, F.log("ratio")), F.lit(0.0))})
    # a bar takes the factors of later days: from the end, bars of a day before its actions
    later = Window.partitionBy("entity_id").orderBy(F.desc("_d"), F.asc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"_pf": F.exp(F.sum("_f").over(later)), "_vf": F.exp(F.sum("_g").over(later))}).where("_kind = 0")
    prices = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    return out.select("_bar.*", *[F.round(F.col(f"_bar.{c}").cast("double") * F.col("_pf"), 6).alias(f"{c}_adjusted") for c in prices],
                      *([F.round(F.col("_bar.volume") * F.col("_vf"), 6).alias("volume_adjusted")] if "volume" in bars.columns else []))


def attach_benchmarks(panel: DataFrame, benchmarks: DataFrame, groups: DataFrame, names: tuple[str, ...] = ("sector", "industry")) -> DataFrame:
    """Adds market, sector and industry: closes of the benchmarks an entity is mapped to, on its own dates; null where
    it has none. benchmarks: benchmark_id, event_time, close. groups: entity_id and a benchmark_id per name (and market)."""
    out = panel.join(groups, "entity_id", "left")
    for name in ("market", *names):
        b = benchmarks.select(F.col("benchmark_id").alias("_b"), F.col("event_time").alias("_t"), F.col("close").alias(f"_{name}"))
        out = out.join(b, (F.col(f"{name}_id") == F.col("_b")) & (F.col("event_time") == F.col("_t")), "left").drop("_b", "_t").withColumnRenamed(f"_{name}", name)
    return out.drop(*[f"{n}_id" for n in ("market", *names)])


def resample(bars: DataFrame, period: str) -> DataFrame:
    """Weekly (ending Friday) or monthly bars; a last period whose label is not reached is dropped."""
    day = F.to_date("event_time")
    label = F.next_day(F.date_sub(day, 1), "FRI") if period == "week" else F.last_day(day)
    out = bars.where("close is not null").withColumn("period_end", label).groupBy("entity_id", "period_end").agg(
        F.min_by("open", "event_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "event_time").alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
    last = bars.agg(F.max(day).alias("last_day"))
    return out.join(F.broadcast(last), F.col("period_end") <= F.col("last_day")).drop("last_day")
