"""Market states, transitions, gaps and islands, risk flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State, inputs, predicate; the first that holds wins.
STATES: list[tuple[str, list[str]]] = [
    ("DISTRIBUTION", ["momentum_improvement", "drawdown_pct", "higher_high_frequency"]),
    ("UPTREND", ["resistance_breakout_pct", "acceptance_followthrough"]),
    ("BREAKOUT_READY", ["resistance_pressure", "time_in_upper_range", "resistance_breakout_pct"]),
    ("BREAKOUT_WATCH", ["volatility_reexpansion", "volume_expansion", "resistance_pressure"]),
    ("ACCUMULATION", ["volatility_compression", "atr_percentile", "normalized_range_width", "higher_low_development", "support_test_count"]),
    ("CONSOLIDATION", ["volatility_compression", "atr_percentile", "normalized_range_width"]),
    ("BASE_FORMING", ["downside_momentum_reduction", "volatility_contraction_onset"]),
    ("DOWN_TREND", ["structure_transition", "lower_low_frequency"]),
]
CYCLE = ["DOWN_TREND", "BASE_FORMING", "CONSOLIDATION", "ACCUMULATION", "BREAKOUT_WATCH", "BREAKOUT_READY", "UPTREND", "DISTRIBUTION"]
MIN_EVIDENCE = 0.60


def predicates() -> dict[str, Column]:
    quiet = (F.col("volatility_compression") <= 1.05) & (F.col("atr_percentile") <= 0.40) & (F.col("normalized_range_width") <= 0.25)
    return {
        "DISTRIBUTION": (F.col("momentum_improvement") < 0) & F.col("drawdown_pct").between(-0.15, 0) & (F.col("higher_high_frequency") < 0.40),
        "UPTREND": (F.col("resistance_breakout_pct") > 0) & (F.col("acceptance_followthrough") >= 0.40),
        "BREAKOUT_READY": (F.col("resistance_pressure") >= 0.85) & (F.col("time_in_upper_range") >= 0.50) & (F.col("resistance_breakout_pct") <= 0),
        "BREAKOUT_WATCH": (F.col("volatility_reexpansion") >= 1.10) & (F.col("volume_expansion") >= 1.15) & (F.col("resistance_pressure") >= 0.60),
        "ACCUMULATION": quiet & (F.col("higher_low_development") > 0) & (F.col("support_test_count") >= 2),
        "CONSOLIDATION": quiet,
        "BASE_FORMING": (F.col("downside_momentum_reduction") > 0) & (F.col("volatility_contraction_onset") < 1.0),
        "DOWN_TREND": (F.col("structure_transition") < 0) & (F.col("lower_low_frequency") >= 0.20),
    }


def classify(vectors: DataFrame) -> DataFrame:
    """Adds state (null if none) and unmatched: `thin_evidence` or `no_predicate`."""
    tests = predicates()
    state, any_evidence = F.lit(None).cast("string"), F.lit(False)
    chosen = []
    for name, inputs in STATES:
        enough = sum((F.col(i).isNotNull().cast("double") for i in inputs), F.lit(0.0)) / len(inputs) >= MIN_EVIDENCE
        any_evidence = any_evidence | enough
        chosen.append(F.when(enough & F.coalesce(tests[name], F.lit(False)), F.lit(name)))
    state = F.coalesce(*chosen)
    return vectors.withColumn("state", state).withColumn(
        "unmatched", F.when(F.col("state").isNull(), F.when(any_evidence, "no_predicate").otherwise("thin_evidence")))


def _ramp(x: Column, full: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / full)))


def mean_available(parts: list[Column]) -> Column:
    n = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]) / F.nullif(n, F.lit(0))


QUALITY_INPUTS = ["peak_to_trough_decline", "downside_momentum_reduction", "volatility_compression", "normalized_range_width", "volume_expansion", "resistance_pressure"]


def quality(vectors: DataFrame) -> DataFrame:
    """Adds quality (mean of those of four components that are known: decline, stabilization, consolidation,
    awakening), input_coverage, and advances (quality >= 0.6 on 60 % of the inputs or more)."""
    parts = [
        _ramp(-F.col("peak_to_trough_decline"), 0.60),
        _ramp(F.col("downside_momentum_reduction"), 1.0),
        mean_available([_ramp(1 - F.col("volatility_compression"), 0.50), _ramp(1 - F.col("normalized_range_width"), 1.0)]),
        mean_available([_ramp(F.col("volume_expansion") - 1, 1.0), _ramp(F.col("resistance_pressure"), 1.0)]),
    ]
    coverage = reduce(lambda a, b: a + b, [F.col(i).isNotNull().cast("double") for i in QUALITY_INPUTS]) / len(QUALITY_INPUTS)
    out = vectors.withColumn("quality", mean_available(parts)).withColumn("input_coverage", coverage)
    return out.withColumn("advances", (F.col("quality") >= 0.6) & (F.col("input_coverage") >= MIN_EVIDENCE))


def transitions(log: DataFrame, key: str, state: str, order: list[str], time: str) -> DataFrame:
    """Rows where a key's state changes: from_state, to_state, at and seconds spent in the state before."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = log.withColumn("_from", F.lag(state).over(w)).where(F.col("_from").isNull() | (F.col("_from") != F.col(state)))
    seconds = F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.lag(time).over(w).cast("timestamp"))
    return changed.select(key, F.col("_from").alias("from_state"), F.col(state).alias("to_state"), F.col(time).alias("at"), seconds.cast("bigint").alias("seconds_before"))


def is_backward(cycle: list[str] = CYCLE) -> Column:
    order = F.array(*map(F.lit, cycle))
    a, b = F.array_position(order, F.col("from_state")), F.array_position(order, F.col("to_state"))
    return (a > 0) & (b > 0) & (b < a)


def islands(log: DataFrame, key: str, state: str, order: list[str], time: str) -> DataFrame:
    """Runs of equal state: start, end and number of rows."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(1))
    runs = log.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run", state).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def risk_flags(df: DataFrame) -> DataFrame:
    """Tri-state flags: null where the inputs leave them undetermined."""
    shortfall = F.when(F.col("avg_dollar_volume").isNotNull(), 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("avg_dollar_volume")) / 1e6))
    return df.withColumns({
        "liquidity_shortfall": shortfall,
        "volatility_spike": (F.col("atr_percentile") >= 0.90) & (F.col("volatility_reexpansion") >= 1.5),
        "event_near": F.when(F.col("events_covered"), F.coalesce(F.col("days_to_event") <= 14, F.lit(False))),
    })


def history_counts(log: DataFrame, key: str = "entity_id", cycle: list[str] = CYCLE) -> DataFrame:
    """Per key from transitions: how many, how many entries into the first state of the cycle, how many backward moves, the last one."""
    return log.groupBy(key).agg(
        F.count("*").alias("transitions"), F.count_if(F.col("to_state") == cycle[0]).alias("cycles"), F.count_if(F.coalesce(is_backward(cycle), F.lit(False))).alias("backward"), F.max("at").alias("last_at"))


def watchlists(latest: DataFrame, lists: dict[str, str], state: str = "state") -> DataFrame:
    """Adds watchlist, the list of each row's state; rows of states without a list go."""
    pairs = F.create_map(*[F.lit(x) for kv in lists.items() for x in kv])
    return latest.withColumn("watchlist", F.try_element_at(pairs, F.col(state))).where("watchlist is not null")


def marks(log: DataFrame) -> DataFrame:
    """Chart marks of transitions: at, a label and a direction (up, down, or start for a first state)."""
    order = F.array(*map(F.lit, CYCLE))
    step = F.array_position(order, F.col("to_state")) - F.array_position(order, F.col("from_state"))
    return log.withColumns({
        "label": F.concat_ws(" > ", "from_state", "to_state"),
        "direction": F.when(F.col("from_state").isNull(), "start").when(step >= 0, "up").otherwise("down")})


def in_session(log: DataFrame, close: Column, time: str = "at") -> DataFrame:
    """Rows from a session's close up to, without, one day later."""
    return log.where((F.col(time) >= close) & (F.col(time) < close + F.expr("INTERVAL 1 DAY")))


#: Receivers that a message meets in one row.
PACK = 1000


def _every(messages: DataFrame, receivers: DataFrame, sent: DataFrame, message: str, receiver: str) -> DataFrame:
    """Each message that some receiver lacks, with every receiver. A null is a receiver like others, of whom nobody knows that they have it."""
    n = receivers.count()
    if not n:
        return messages.limit(0).join(receivers, F.lit(False))
    have = sent.select(message, receiver).distinct().join(receivers, receiver, "left_semi").groupBy(message).agg(F.count("*").alias("_have"))
    lacking = messages.join(have, message, "left").where(F.coalesce("_have", F.lit(0)) < n).select(message)
    packs = -(-n // PACK)
    each = lacking.withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    of = F.pmod(F.xxhash64(receiver), F.lit(packs)).cast("int").alias("_pack")
    packed = receivers.groupBy(of).agg(F.collect_list(F.struct(receiver)).alias("_all"))
    return each.join(packed, "_pack").select(message, F.inline("_all"))


def outstanding(messages: DataFrame, receivers: DataFrame, sent: DataFrame, message: str, receiver: str, *, by: str | None = None) -> DataFrame:
    """(message, receiver) pairs that are due and not sent: of equal `by`, or of all receivers. Messages that all
    receivers have are left out then before the others meet the receivers, who come in packs of some `PACK`."""
    m, r = messages.select(message, *([by] if by else [])).distinct(), receivers.select(receiver, *([by] if by else [])).distinct()
    due = m.join(r, by) if by else _every(m, r, sent, message, receiver)
    return due.select(message, receiver).distinct().join(sent.select(message, receiver), [message, receiver], "left_anti")


def newly_failed(results: DataFrame) -> DataFrame:
    """Per entity and run the gates that it failed and had not failed in its run before."""
    runs = results.groupBy("entity_id", "run_at").agg(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("gate")))).alias("failed"))
    before = F.lag("failed").over(Window.partitionBy("entity_id").orderBy("run_at"))
    return runs.withColumn("newly_failed", F.when(before.isNotNull(), F.array_except("failed", before)).otherwise(F.col("failed")))


def risk_context(entities: DataFrame, flags: DataFrame, trend: DataFrame, counts: DataFrame) -> DataFrame:
    """Flags, eligibility trend (NEVER_EVALUATED without results) and backward moves of each entity, and whether any of them invalidates."""
    out = entities.join(flags, "entity_id", "left").join(trend, "entity_id", "left").join(counts, "entity_id", "left")
    out = out.withColumns({"trend": F.coalesce("trend", F.lit("NEVER_EVALUATED")), "backward": F.coalesce("backward", F.lit(0))})
    return out.withColumn("invalidates", (F.col("trend") == "LOST") | (F.col("backward") > 0))


def eligibility_trend(results: DataFrame) -> DataFrame:
    """Per entity from gate results per run: NEVER_EVALUATED is left to a left join; PASSING, LOST or NEVER_ELIGIBLE."""
    runs = results.groupBy("entity_id", "run_at").agg(F.bool_and("passed").alias("ok"))
    out = runs.groupBy("entity_id").agg(F.max_by("ok", "run_at").alias("now"), F.bool_or("ok").alias("ever"))
    return out.select("entity_id", F.when(F.col("now"), "PASSING").when(F.col("ever"), "LOST").otherwise("NEVER_ELIGIBLE").alias("trend"))
