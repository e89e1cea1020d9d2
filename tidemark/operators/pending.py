"""Events that are scheduled and known: what is coming up, as seen from an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .intervals import interval_join

HORIZON_DAYS = 45


def first_known(events: DataFrame) -> DataFrame:
    """One row per entity, event_type and scheduled_for, with known_from: the earliest time it was available, as
    knowledge is not unlearned. Of rows available at once the last in order of their other columns stays."""
    keys = ["entity_id", "event_type", "scheduled_for"]
    others = [c for c in events.columns if c not in (*keys, "availability_time")]
    first = F.min_by(F.struct(*others, "availability_time"), F.struct("availability_time", *others)) if others else F.struct(F.min("availability_time").alias("availability_time"))
    return events.groupBy(*keys).agg(first.alias("_f")).select(*keys, *[F.col("_f")[c].alias(c) for c in others], F.col("_f.availability_time").alias("known_from"))


def upcoming(events: DataFrame, asks: DataFrame, *, days: int = HORIZON_DAYS) -> DataFrame:
    """(ask_id, event) for each ask (ask_id, entity_id, as_of): events known by then and scheduled within `days`, both ends included.

    An event is pending from when it is known, but no earlier than `days` before its date, until its date: an interval
    that asks meet by buckets of time."""
    span = F.expr(f"INTERVAL {days} DAYS")
    known = first_known(events).withColumn("_from", F.greatest("known_from", F.col("scheduled_for") - span))
    pairs = interval_join(asks.select("ask_id", "entity_id", "as_of"), known.where("scheduled_for is not null and known_from is not null"), ["entity_id"], "as_of", "_from", "scheduled_for", closed=True)
    return pairs.drop("_from")


def pending_events(events: DataFrame, asks: DataFrame, *, days: int = HORIZON_DAYS) -> DataFrame:
    """Each ask with coverage: KNOWN (something is pending), NONE_SCHEDULED (the calendar was known and is empty) or UNAVAILABLE
    (miss_reason: never_ingested, not_yet_available); the number of pending events, the next one's date and type, days
    to it, when the calendar was last observed, and events_covered (null where nobody can know)."""
    e = upcoming(events, asks, days=days).groupBy("ask_id").agg(
        F.count("*").alias("_n"), F.min("scheduled_for").alias("next_at"), F.min_by("event_type", F.struct("scheduled_for", "event_type")).alias("next_type"))
    seen = events.where("availability_time is not null").groupBy("entity_id").agg(F.min("availability_time").alias("_first"))
    times = events.select("entity_id", F.col("availability_time").alias("observed_at")).distinct()
    out = asof_join(asks, times, "entity_id", "as_of", "observed_at").join(seen, "entity_id", "left").join(e, "ask_id", "left")
    reason = F.when(F.col("_first").isNull(), "never_ingested").when(F.col("_first") > F.col("as_of"), "not_yet_available")
    out = out.withColumn("miss_reason", reason).withColumn("pending", F.coalesce("_n", F.lit(0)))
    covered = F.col("miss_reason").isNull()
    return out.withColumns({
        "coverage": F.when(~covered, "UNAVAILABLE").when(F.col("pending") > 0, "KNOWN").otherwise("NONE_SCHEDULED"), "events_covered": F.when(covered, F.lit(True)),
        "days_to_event": F.datediff("next_at", "as_of")}).drop("_n", "_first")
