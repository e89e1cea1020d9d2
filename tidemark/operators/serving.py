"""What is served from stored records: merged metrics, the health of scans, release windows, staleness of published figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import knowable

STUCK_HOURS, REFRESH_HOURS = 6.0, 24.0


def merged_metrics(records: DataFrame, kinds: list[str], as_of) -> DataFrame:
    """entity_id, metric, value (text) and source: of the latest knowable record of each kind the fields of its JSON; where
    several kinds have a field, the first of `kinds` wins, absent (null) ones giving way. Ties of records: the last in order of data."""
    known = knowable(records, as_of).where(F.col("statement_type").isin(kinds))
    latest = known.groupBy("entity_id", "statement_type").agg(F.max(F.struct("fiscal_period_end", "availability_time", "data")).alias("_r"))
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("statement_type"))
    each = latest.select("entity_id", "statement_type", place.alias("_place"), F.explode(F.from_json(F.col("_r.data"), "map<string,string>")).alias("metric", "value"))
    first = F.min(F.struct("_place", "value", "statement_type")).alias("_f")
    return each.where("value is not null").groupBy("entity_id", "metric").agg(first).select("entity_id", "metric", "_f.value", F.col("_f.statement_type").alias("source"))


def scan_status(runs: DataFrame, now: Column, *, hours: float = STUCK_HOURS) -> DataFrame:
    """Per status how many runs, and how many of them are stuck: running, never finished, and as of more than `hours` ago."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("as_of").cast("timestamp"))) / 3600
    stuck = (F.col("status") == "RUNNING") & F.col("finished_at").isNull() & (age > hours)
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.count_if(stuck).alias("stuck"), F.max("as_of").alias("latest"))


def persistent_exclusions(runs: DataFrame) -> DataFrame:
    """Entities that more than one run left out (array `excluded`): how often, and from when to when; the most frequent are those never looked at."""
    each = runs.select("scan_date", F.explode("excluded").alias("entity_id"))
    return each.groupBy("entity_id").agg(F.count("*").alias("days"), F.min("scan_date").alias("first_date"), F.max("scan_date").alias("last_date")).where("days > 1")


def current_decisions(decisions: DataFrame, keys: list[str], *, sequence: str = "sequence_number") -> DataFrame:
    """The decision that stands for each key: the last one, whatever came before."""
    w = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return decisions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def approved(decisions: DataFrame, keys: list[str], **options) -> DataFrame:
    """Keys whose current decision is APPROVED: what was approved and rejected later is not among them."""
    return current_decisions(decisions, keys, **options).where("status = 'APPROVED'")


def staleness(snapshots: DataFrame, releases: DataFrame, now: Column, *, key: str = "snapshot_id", member: str = "included", hours: float = REFRESH_HOURS) -> DataFrame:
    """Each snapshot with serving: withdrawn (it rests on something no longer approved), incomplete (more is approved by
    now), outdated (computed over `hours` ago) or current.

    releases: one column, the approved ids. Members meet them by id; only counts come back to the snapshots."""
    ids = releases.select(F.col(releases.columns[0]).alias("_id")).distinct().withColumn("_ok", F.lit(True))
    held = snapshots.select(key, F.explode(F.array_distinct(member)).alias("_id")).join(ids, "_id", "left")
    counts = held.groupBy(key).agg(F.count("*").alias("_held"), F.count("_ok").alias("_approved"))
    total = ids.agg(F.count("*").alias("_total"))
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("computed_at").cast("timestamp"))) / 3600
    out = snapshots.join(counts, key, "left").crossJoin(F.broadcast(total))
    have, ok = F.coalesce("_held", F.lit(0)), F.coalesce("_approved", F.lit(0))
    serving = F.when(ok < have, "withdrawn").when(ok < F.col("_total"), "incomplete").when(age > hours, "outdated").otherwise("current")
    return out.withColumn("serving", serving).drop("_held", "_approved", "_total")
