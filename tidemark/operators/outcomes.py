"""Outcomes of cases: excursions inside a horizon, first crossings, status, why a case failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import store
from .asof import asof_join
from .intervals import interval_join

TARGET_ATR, STOP_ATR, HORIZON, MIN_BARS = 1.5, -0.75, 60, 2
EXPANSION_ATR, BREAKDOWN_ATR, ILLIQUID, CATALYST_DAYS = 0.45, -2.25, 250_000.0, 5
#: Ends of tracking for reasons outside price.
INVALIDATIONS = ["invalidated", "gate_invalidated", "lost_eligibility", "ineligible"]


def measure(cases: DataFrame, bars: DataFrame, *, horizon: int = HORIZON, target: float = TARGET_ATR, stop: float = STOP_ATR) -> DataFrame:
    """Per case: entry, bars seen, MFE and MAE with the bars they took, realized return, also relative to the
    benchmark (column `market` of bars, if there) and over entry ATR, and the first bars that reached target
    or stop. The entry bar is the first at or after detection and does not count itself; a case without one, or
    without a bar after it, stays with 0 bars and no valid outcome.

    Bars are numbered per entity once. A case gets the number of its entry bar in the same ordered
    window, and then joins exactly the `horizon` bars after it, by number."""
    values = ["high", "low", "close", "atr"] + (["market"] if "market" in bars.columns else [])
    order = Window.partitionBy("entity_id").orderBy("event_time")
    numbered = bars.withColumn("bar", F.row_number().over(order)).select("entity_id", F.col("event_time").alias("_t"), "bar", *values)
    b = numbered.select("entity_id", "_t", F.lit(1).alias("_kind"), F.struct("bar", "_t", *values).alias("_bar"))
    c = cases.select("entity_id", F.col("detected_at").alias("_t"), F.lit(0).alias("_kind"), "case_id")
    ahead = Window.partitionBy("entity_id").orderBy("_t", "_kind").rowsBetween(0, Window.unboundedFollowing)
    entry = b.unionByName(c, allowMissingColumns=True).withColumn("_first", F.first("_bar", ignorenulls=True).over(ahead)).where("_kind = 0")
    entry = entry.select(
        "case_id", "entity_id", F.col("_first.bar").alias("bar0"), F.col("_first._t").alias("entry_at"), F.col("_first.close").alias("entry"), F.col("_first.atr").alias("atr0"),
        *([F.col("_first.market").alias("market0")] if "market" in values else []))
    steps = entry.withColumn("bar", F.explode_outer(F.sequence(F.col("bar0") + 1, F.col("bar0") + horizon)))
    after = steps.join(numbered, ["entity_id", "bar"], "left")
    step = F.col("bar") - F.col("bar0")
    up, down = F.col("high") / F.col("entry") - 1, F.col("low") / F.col("entry") - 1
    goal, floor = target * F.col("atr0") / F.col("entry"), stop * F.col("atr0") / F.col("entry")
    seen = F.when(F.col("_t").isNotNull(), F.col("bar"))
    last = F.max_by("close", seen) / F.col("entry") - 1
    keys = ["case_id", "entity_id", "entry_at", "entry", "atr0"] + (["market0"] if "market" in values else [])
    out = after.groupBy(*keys).agg(
        F.count("_t").alias("bars"), F.max(up).alias("mfe"), F.min(down).alias("mae"),
        F.min_by(step, F.when(up.isNotNull(), F.struct(-up, step))).alias("bars_to_mfe"), F.min_by(step, F.when(down.isNotNull(), F.struct(down, step))).alias("bars_to_mae"),
        F.min_by("_t", F.when(up.isNotNull(), F.struct(-up, step))).alias("peak_at"),
        last.alias("realized_return"), F.max("_t").alias("window_end"),
        F.min(F.when(up >= goal, step)).alias("target_bar"), F.min(F.when(down <= floor, step)).alias("stop_bar"),
        *([(last - (F.max_by("market", seen) / F.col("market0") - 1)).alias("relative_return")] if "market" in values else []))
    atr = F.col("atr0") / F.nullif(F.col("entry"), F.lit(0.0))
    return out.drop("market0").withColumns({"atr_fraction": atr, "volatility_adjusted": F.col("realized_return") / F.nullif(atr, F.lit(0.0))}).withColumn("status", status())


def horizons(calendar: DataFrame, days: int = HORIZON) -> DataFrame:
    """d, horizon: for every date from the calendar's first to its last the `days`-th trading day after it, null where
    the calendar (one row per trading day, column `day`) does not reach so far. As many rows as the calendar has dates."""
    trading = calendar.select(F.to_date("day").alias("day")).distinct()
    n = trading.select("day", F.row_number().over(Window.orderBy("day")).alias("n"))
    every = trading.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("d"))
    passed = every.join(n, F.col("d") == F.col("day"), "left").select("d", F.last("n", ignorenulls=True).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("passed"))
    return passed.join(F.broadcast(n), F.col("passed") + days == F.col("n"), "left").select("d", F.col("day").alias("horizon"))


def windows(cases: DataFrame, calendar: DataFrame, *, days: int = HORIZON) -> DataFrame:
    """Adds ends_at and ends_because to cases (entry_at, terminal_at): the terminal event, or `days` trading days after
    entry at its time of day if that is earlier. A case that never activated (null entry_at or terminal_at) has no window."""
    h = horizons(calendar, days).select("d", F.col("horizon").cast("timestamp_ntz").alias("_h"))  # bounded by the calendar
    out = cases.join(F.broadcast(h), F.to_date("entry_at") == F.col("d"), "left")
    kind = dict(cases.dtypes)["entry_at"]
    ahead = (F.col("_h") + (F.col("entry_at").cast("timestamp_ntz") - F.date_trunc("day", "entry_at").cast("timestamp_ntz"))).cast(kind)
    entered = F.col("entry_at").isNotNull() & F.col("terminal_at").isNotNull()
    terminal = ahead.isNull() | (F.col("terminal_at") <= ahead)
    return out.withColumns({
        "ends_at": F.when(entered, F.when(terminal, F.col("terminal_at")).otherwise(ahead)), "ends_because": F.when(entered, F.when(terminal, "terminal_event").otherwise("horizon"))}).drop("d", "_h")


def excursions(cases: DataFrame, bars: DataFrame, calendar: DataFrame, benchmarks: DataFrame | None = None, *, days: int = HORIZON, target: float = TARGET_ATR, stop: float = STOP_ATR,
               least: int = MIN_BARS, per_year: int = 252) -> DataFrame:
    """Outcome of each case over its window; every case stays, measured or not.

    cases: case_id, entity_id, entry_at, terminal_at, terminal_event (and benchmark_id). bars: entity_id, event_time, high, low,
    close, atr. benchmarks: benchmark_id, event_time, close. The entry bar is the last at or before entry; excursions are those of
    the bars after it, through ends_at. `bars` counts the entry bar. `unavailable` says why a case has no outcome. volatility_adjusted
    is the return over the window's annualised volatility. Entry bars come from one as-of pass, bars meet windows by
    buckets of time, and what a case gathers is aggregated where it is found."""
    own = windows(cases.select("case_id", "entity_id", "entry_at", "terminal_at", "terminal_event", *(["benchmark_id"] if benchmarks is not None else [])), calendar, days=days)
    whole = bars.where("high is not null and low is not null and close is not null")
    steps = whole.withColumn("_lr", F.log(F.col("close") / F.lag("close").over(Window.partitionBy("entity_id").orderBy("event_time"))))
    at = asof_join(own, whole.select("entity_id", F.col("event_time").alias("_t0"), F.col("close").alias("_entry"), F.col("atr").alias("_atr")), "entity_id", "entry_at", "_t0")
    at = store(at)  # read by both joins and the result
    goal = F.when(F.col("_atr") > 0, F.col("_atr") / F.nullif(F.col("_entry"), F.lit(0.0)))
    spans = at.where("_t0 is not null and ends_at is not null").select("case_id", "entity_id", "entry_at", "_t0", "ends_at", "_entry", goal.alias("_goal"))
    seen = interval_join(steps.select("entity_id", "event_time", "high", "low", "close", "_lr"), spans, ["entity_id"], "event_time", "_t0", "ends_at", closed=True)
    after = F.col("event_time") > F.col("_t0")
    up, down = F.when(after, F.col("high") / F.col("_entry") - 1), F.when(after, F.col("low") / F.col("_entry") - 1)
    since = lambda t: (t.cast("timestamp").cast("double") - F.first("entry_at").cast("timestamp").cast("double")) / 86400
    found = seen.groupBy("case_id").agg(
        F.count("*").alias("bars"), F.max(up).alias("mfe"), F.min(down).alias("mae"), F.max_by("close", "event_time").alias("exit"), F.stddev_samp(F.when(after, F.col("_lr"))).alias("_sd"),
        since(F.min_by("event_time", F.when(after, F.struct(-up, "event_time")))).alias("days_to_mfe"), since(F.min_by("event_time", F.when(after, F.struct(down, "event_time")))).alias("days_to_mae"),
        F.min(F.when(up >= target * F.col("_goal"), F.col("event_time"))).alias("target_at"), F.min(F.when(down <= stop * F.col("_goal"), F.col("event_time"))).alias("stop_at"))
    out = at.join(found, "case_id", "left").withColumn("bars", F.coalesce("bars", F.lit(0)))
    why = F.when(F.col("ends_at").isNull(), "no_entry_event").when(F.col("bars") == 0, "no_bars").when(F.col("bars") < least, "too_few_bars").when(~(F.col("_entry") > 0), "no_entry_price")
    out = out.withColumn("unavailable", why)
    measured = F.col("unavailable").isNull()
    realized = F.col("exit") / F.col("_entry") - 1
    out = out.withColumns({
        **{c: F.when(measured, F.col(c)) for c in ("mfe", "mae", "exit", "days_to_mfe", "days_to_mae", "target_at", "stop_at")}, "entry": F.when(measured, F.col("_entry")), "atr_fraction": F.when(measured, goal),
        "realized_return": F.when(measured, realized), "volatility_adjusted": F.when(measured & (F.col("_sd") > 0), realized / (F.col("_sd") * per_year**0.5))})
    if benchmarks is not None:
        spans = at.where("ends_at is not null and benchmark_id is not null").select("case_id", "benchmark_id", "entry_at", "ends_at")
        line = interval_join(benchmarks.where("close is not null").select("benchmark_id", F.col("event_time").alias("_t"), "close"), spans, ["benchmark_id"], "_t", "entry_at", "ends_at", closed=True)
        ends = line.groupBy("case_id").agg(F.count("*").alias("_n"), F.min_by("close", "_t").alias("_a"), F.max_by("close", "_t").alias("_b"))
        market = ends.where((F.col("_n") >= least) & (F.col("_a") > 0)).select("case_id", (F.col("_b") / F.col("_a") - 1).alias("_market"))
        out = out.join(market, "case_id", "left").withColumn("relative_return", F.col("realized_return") - F.col("_market")).drop("_market")
    first = F.when(~measured, "NO_VALID_OUTCOME").when(F.col("stop_at").isNotNull() & (F.col("target_at").isNull() | (F.col("stop_at") <= F.col("target_at"))), "FAILED").when(F.col("target_at").isNotNull(), "SUCCESS")
    return out.withColumn("status", first.when(F.col("terminal_event").isin(INVALIDATIONS), "INVALIDATED").otherwise("EXPIRED")).drop("_t0", "_entry", "_atr", "_sd")


def status(activated: Column | None = None, terminal: Column | None = None) -> Column:
    """A bar that reaches both counts as stopped. terminal: the event that ended tracking, if known."""
    target, stop = F.col("target_bar"), F.col("stop_bar")
    out = F.when(~F.coalesce(activated if activated is not None else F.lit(True), F.lit(False)) | F.col("bars").isNull() | (F.col("bars") < MIN_BARS), "NO_VALID_OUTCOME")
    out = out.when(stop.isNotNull() & (target.isNull() | (stop <= target)), "FAILED").when(target.isNotNull(), "SUCCESS")
    if terminal is not None:
        out = out.when(terminal.isin(INVALIDATIONS), "INVALIDATED")
    return out.otherwise("EXPIRED")


def within(cases: DataFrame, events: DataFrame, time: str, *, start: str = "entry_at", end: str = "window_end") -> DataFrame:
    """(case_id, the event's columns) of an entity's events inside each case's window, both ends included."""
    windows = cases.where(F.col(end).isNotNull()).select("entity_id", F.col("case_id").alias("_case"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    pairs = interval_join(events, windows, ["entity_id"], time, "_start", "_end", closed=True)
    return pairs.select(F.col("_case").alias("case_id"), *[c for c in events.columns if c != "entity_id"])


def near_peak(cases: DataFrame, events: DataFrame, time: str, *, days: int = CATALYST_DAYS) -> DataFrame:
    """case_ids with an event of their entity within `days` of the peak excursion."""
    span = F.expr(f"INTERVAL {days} DAYS")
    peaks = cases.where("peak_at is not null").select("case_id", "entity_id", (F.col("peak_at") - span).alias("_a"), (F.col("peak_at") + span).alias("_b"))
    return within(peaks, events.select("entity_id", time), time, start="_a", end="_b").select("case_id").distinct()


def classify(measured: DataFrame, *, actions: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Adds false_positive (A to G, in order of precedence; null for a success or where no scale is known) and
    review_confidence. Reads activated and avg_dollar_volume where the table has them."""
    out = measured
    has = set(out.columns)
    activated = F.coalesce(F.col("activated"), F.lit(False)) if "activated" in has else F.lit(True)
    volume = F.col("avg_dollar_volume") if "avg_dollar_volume" in has else F.lit(None).cast("double")

    def mark(name: str, ids: DataFrame | None) -> Column:
        nonlocal out
        if ids is None:
            return F.lit(False)
        out = out.join(ids.select("case_id", F.lit(True).alias(name)).distinct(), "case_id", "left")
        return F.coalesce(F.col(name), F.lit(False))

    acted = mark("_acted", None if actions is None else within(measured, actions, "effective_date"))
    catalyst = mark("_catalyst", None if events is None else near_peak(measured, events, "scheduled_for"))
    atr = F.col("atr_fraction")
    kind = (
        F.when(F.col("status") == "SUCCESS", F.lit(None)).when(~activated, "A_NO_PATTERN").when(acted, "G_CORPORATE_ACTION_DISTORTION")
        .when(volume < ILLIQUID, "F_ILLIQUID_DISTORTION").when(catalyst, "E_CATALYST_DRIVEN").when(atr.isNull(), F.lit(None))
        .when(F.col("realized_return") <= BREAKDOWN_ATR * atr, "D_BREAKDOWN").when(F.col("mfe") >= EXPANSION_ATR * atr, "C_FALSE_BREAKOUT").otherwise("B_PATTERN_NO_EXPANSION")
    )
    out = out.withColumn("false_positive", kind)
    missing = F.col("bars").isNull() | (F.col("bars") < MIN_BARS) | atr.isNull()
    odd = F.coalesce(F.col("false_positive").substr(1, 1).isin("E", "F", "G"), F.lit(False))
    review = F.when(missing & activated, "LOW").when(odd, "MEDIUM").when(F.col("status").isin("SUCCESS", "FAILED"), "HIGH").otherwise("MEDIUM")
    return out.withColumn("review_confidence", review).drop("_acted", "_catalyst")


def stage_checklist(events: DataFrame, stages: list[str], *, key: str = "case_id") -> DataFrame:
    """Per case the first time of each stage and how many retreats were recorded."""
    return events.groupBy(key).agg(
        *[F.min(F.when(F.col("status") == s, F.col("at"))).alias(f"{s.lower()}_at") for s in stages], F.count_if(F.col("reason") == "retreat").alias("retreats"))


def pending(concluded: DataFrame, outcomes: DataFrame, key: str = "case_id") -> DataFrame:
    """Concluded cases without an outcome so far."""
    return concluded.join(outcomes.select(key).distinct(), key, "left_anti")
