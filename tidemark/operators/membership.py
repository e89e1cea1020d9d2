"""Membership built from listings: admission, dated listing intervals, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import suffix

#: Venues that are admitted, and symbol suffixes of venues elsewhere.
VENUES = ["NYSE", "NASDAQ"]
FOREIGN_SUFFIXES = [
    "AS", "AX", "BO", "BR", "CO", "DE", "F", "HE", "HK", "IR", "JK", "KS", "KQ", "L", "LS", "MC", "MI", "MX", "NS", "NZ", "OL", "PA", "SA", "SI", "SS", "ST",
    "SW", "SZ", "T", "TA", "TO", "TW", "V", "VI", "WA",
]


def exclusion_reason(exchange: Column, symbol: Column) -> Column:
    """The first rule that keeps a listing out, null if it is admitted. exchange: a canonical venue."""
    foreign = F.coalesce(suffix(symbol).isin(FOREIGN_SUFFIXES), F.lit(False))
    venue = F.coalesce(exchange, F.lit("UNKNOWN"))
    return (
        F.when(F.coalesce(F.char_length(symbol), F.lit(0)) == 0, "missing_symbol").when(venue == "UNKNOWN", "unknown_exchange")
        .when(~venue.isin(VENUES), "non_universe_exchange").when(foreign, "foreign_symbol_suffix")
    )


def admission_report(listings: DataFrame, *, exchange: str = "exchange", symbol: str = "symbol", samples: int = 25) -> DataFrame:
    """Per venue and reason (null: admitted): how many, and the first `samples` symbols."""
    rows = listings.select(F.col(exchange).alias("exchange"), exclusion_reason(F.col(exchange), F.col(symbol)).alias("reason"), F.col(symbol).alias("symbol"))
    w = Window.partitionBy("exchange", "reason").orderBy("symbol")
    counts = rows.groupBy("exchange", "reason").agg(F.count("*").alias("n"))
    first = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples).groupBy("exchange", "reason").agg(
        F.array_sort(F.collect_list("symbol")).alias("samples"))
    same = counts["exchange"].eqNullSafe(first["exchange"]) & counts["reason"].eqNullSafe(first["reason"])
    return counts.join(first, same, "left").select(counts["exchange"], counts["reason"], "n", "samples")


def top_labels(listings: DataFrame, label: str, *, n: int = 20) -> DataFrame:
    """The n most frequent labels, ties by name."""
    return listings.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(n)


def bar_date_bounds(bars: DataFrame, *, entity: str = "entity_id", time: str = "event_time") -> DataFrame:
    return bars.groupBy(entity).agg(F.to_date(F.min(time)).alias("first_bar"), F.to_date(F.max(time)).alias("last_bar"))


def observations(listed: DataFrame, delisted: DataFrame) -> DataFrame:
    """One table of both feeds: entity_id, symbol, exchange, ipo_date, delisted_date, is_delisted."""
    now = listed.select("entity_id", "symbol", "exchange", F.lit(None).cast("date").alias("ipo_date"), F.lit(None).cast("date").alias("delisted_date"), F.lit(False).alias("is_delisted"))
    gone = delisted.select("entity_id", "symbol", "exchange", "ipo_date", "delisted_date", F.lit(True).alias("is_delisted"))
    return now.unionByName(gone)


def listing_intervals(observed: DataFrame, bounds: DataFrame, observed_at: Column) -> DataFrame:
    """Half-open intervals with what each end rests on: the feed, else price history, else the
    time of observation. A security that came back has two intervals, with the gap between them."""
    day = lambda c: c.cast("timestamp")
    o = observed.join(bounds, "entity_id", "left")
    back = F.max(F.when(F.col("is_delisted"), F.col("delisted_date"))).over(Window.partitionBy("entity_id"))
    o = o.withColumns({"_at": observed_at.cast("timestamp"), "_back": back})
    gone = F.col("is_delisted")
    end = F.when(gone, F.coalesce(day(F.col("delisted_date")), day(F.col("last_bar")), F.col("_at")))
    to_evidence = F.when(gone & F.col("delisted_date").isNotNull(), "delisted_feed").when(gone & F.col("last_bar").isNotNull(), "price_history").otherwise("missing")
    start = F.when(gone, F.coalesce(day(F.col("ipo_date")), day(F.col("first_bar")), day(F.coalesce("delisted_date", F.to_date("_at"))))).otherwise(
        F.coalesce(day(F.col("first_bar")), F.col("_at")))
    from_evidence = F.when(gone & F.col("ipo_date").isNotNull(), "delisted_feed").when(F.col("first_bar").isNotNull(), "price_history").otherwise(
        F.when(gone, "missing").otherwise("first_observed"))
    o = o.withColumns({"_start": start, "listed_to": end, "_from_evidence": from_evidence, "to_evidence": to_evidence})
    late = ~gone & F.coalesce(F.col("_start") < day(F.col("_back")), F.lit(False))
    return o.select(
        "entity_id", "symbol", "exchange",
        F.when(gone & (F.col("listed_to") <= F.col("_start")), F.col("listed_to") - F.expr("INTERVAL 1 DAY")).when(late, day(F.col("_back"))).otherwise(F.col("_start")).alias("listed_from"),
        "listed_to", F.when(gone, "DELISTED").otherwise("LISTED").alias("listing_status"),
        F.when(late, "missing").otherwise(F.col("_from_evidence")).alias("from_evidence"), "to_evidence")


def covering(intervals: DataFrame, moment: Column) -> DataFrame:
    """Per entity the interval that covers the moment; of several the one that began last."""
    live = intervals.where((F.col("listed_from") <= moment) & (F.col("listed_to").isNull() | (F.col("listed_to") > moment)))
    w = Window.partitionBy("entity_id").orderBy(F.desc("listed_from"), "symbol", "listing_status")
    return live.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def checksum(intervals: DataFrame, columns: list[str]) -> DataFrame:
    """members and a SHA-256 of the content that does not depend on order: sums of the four
    32-bit parts of each row's MD5, so no row meets another in one task."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]).cast("binary"))
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return intervals.agg(F.count("*").alias("members"), F.sha2(F.concat_ws(",", F.count("*"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("checksum"))


def reuse_version(versions: DataFrame, sums: DataFrame, as_of: Column) -> DataFrame:
    """The checksum with the version of that date and content that is stored already, if any."""
    have = versions.where(F.col("as_of_date") == as_of).groupBy("checksum").agg(F.min("version_id").alias("version_id"))
    return sums.join(F.broadcast(have), "checksum", "left").withColumn("reused", F.col("version_id").isNotNull())
