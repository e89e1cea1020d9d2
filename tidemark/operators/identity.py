"""Identities over time: ticker intervals, resolution, superseded records, one entry to all as-of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof


def ticker_intervals(changes: DataFrame) -> DataFrame:
    """Half-open intervals from an append-only log (entity_id, symbol, at): a change closes what the entity had
    and opens the new one. Repeats of the same symbol in a row change nothing."""
    w = Window.partitionBy("entity_id").orderBy("at", "symbol")
    new = changes.withColumn("_p", F.lag("symbol").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("symbol")))
    return new.select("entity_id", "symbol", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"))


def resolve(identities: DataFrame, symbols: DataFrame, at: Column | None = None) -> DataFrame:
    """Each symbol with its entity: at a time the interval that holds it, else the open one or the latest. Null if none."""
    i = identities if at is None else asof.valid_at(identities, at)
    w = Window.partitionBy("symbol").orderBy(F.col("valid_to").isNull().desc(), F.desc("valid_from"), "entity_id")
    best = i.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol", "entity_id")
    return symbols.select("symbol").distinct().join(best, "symbol", "left")


def register(identities: DataFrame, symbols: DataFrame, at: Column, new_id: Column) -> DataFrame:
    """Rows to append for symbols that nobody holds at that time: an open interval from then on."""
    held = asof.valid_at(identities, at).select("symbol")
    fresh = symbols.select("symbol").distinct().join(held, "symbol", "left_anti")
    return fresh.select(new_id.alias("entity_id"), "symbol", at.alias("valid_from"), F.lit(None).cast(dict(identities.dtypes)["valid_to"]).alias("valid_to"))


def standing(records: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Records that no other one supersedes."""
    gone = records.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return records.join(gone, key, "left_anti")


#: What as_of() reads: the key and the precedence of each kind of record, newest availability last.
KINDS: dict[str, tuple[list[str], list[str]]] = {
    "bar": (["entity_id", "event_time"], []), "fundamental": (["entity_id", "statement_type", "fiscal_period_end"], []),
    "latest_fundamental": (["entity_id", "statement_type"], ["fiscal_period_end"]), "feature_vector": (["entity_id"], ["event_time"]),
    "snapshot": (["entity_id", "kind"], []), "grade": (["entity_id", "firm"], ["event_time"]), "indicator": (["entity_id", "name", "event_time"], []),
}


def as_of(tables: dict[str, DataFrame], kind: str, entities: list | None, at) -> DataFrame:
    """The knowable record of a kind: the newest per key, all of them for actions and news, the valid one for membership."""
    df = tables[kind] if entities is None else tables[kind].where(F.col("entity_id").isin(entities))
    if kind in ("action", "news"):
        return asof.knowable(df, at)
    if kind == "membership":
        return asof.valid_at(asof.knowable(df, at), at, start="listed_from", end="listed_to")
    keys, precedence = KINDS[kind]
    return asof.latest(df, keys, at, precedence=precedence)
