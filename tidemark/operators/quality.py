"""Data quality: bar validation, gaps, duplicates, freshness, lag, calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import percentiles, with_percentiles


def validate_bars(bars: DataFrame, actions: DataFrame | None = None, *, jump: float = 0.5) -> DataFrame:
    """Adds fatal (array of issues), jump (a change of over `jump` against the previous accepted close, unless an
    action (entity_id, effective_date) takes effect that day) and accepted. Of bars with one key and time the
    first in order of its values is kept, the others are `duplicate`."""
    c = F.col
    again = F.row_number().over(Window.partitionBy("entity_id", "event_time").orderBy("open", "high", "low", "close", "volume")) > 1
    issues = F.filter(F.array(
        F.when(c("close").isNull() | c("open").isNull() | c("high").isNull() | c("low").isNull(), "missing_price"),
        F.when(F.least("open", "high", "low", "close") <= 0, "non_positive"),
        F.when(c("high") < c("low"), "high_below_low"),
        F.when((c("close") > c("high")) | (c("close") < c("low")), "close_outside"),
        F.when((c("open") > c("high")) | (c("open") < c("low")), "open_outside"),
        F.when(c("volume") < 0, "negative_volume"),
        F.when(c("_again"), "duplicate"),
    ), lambda x: x.isNotNull())
    out = bars.withColumn("_again", again).withColumn("fatal", issues).withColumn("accepted", F.size("fatal") == 0).drop("_again")
    w = Window.partitionBy("entity_id").orderBy("event_time").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(c("accepted"), c("close")), ignorenulls=True).over(w)
    out = out.withColumn("jump", F.coalesce(c("accepted") & (F.abs(c("close") / before - 1) > jump), F.lit(False)))
    if actions is None:
        return out
    days = actions.select(c("entity_id").alias("_e"), F.to_date("effective_date").alias("_d"), F.lit(True).alias("_acted")).distinct()
    out = out.join(days, (c("entity_id") == c("_e")) & (F.to_date("event_time") == c("_d")), "left")
    return out.withColumn("jump", c("jump") & c("_acted").isNull()).drop("_e", "_d", "_acted")


def gaps(dates: DataFrame, key: str, day: str, calendar: DataFrame) -> DataFrame:
    """Expected days between a key's first and last day that it lacks."""
    span = dates.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    want = span.join(F.broadcast(calendar.select(F.col("day").alias("_d"))), F.col("_d").between(F.col("_a"), F.col("_b"))).select(key, F.col("_d").alias(day))
    return want.join(dates.select(key, day).distinct(), [key, day], "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def identical_restatements(rows: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """Keys with more than one version whose values equal those of the first (by `order`): n versions like the first."""
    # rows with equal values are counted first, so that no task holds a key's versions; nulls come first in a struct as in an order
    versions = rows.groupBy(*keys, *values).agg(F.min(F.struct(order)).alias("_at"), F.count("*").alias("_n"))
    first = versions.groupBy(*keys).agg(F.min(F.struct("_at", *values, "_n")).alias("_first"))
    return first.select(*keys, F.col("_first._n").alias("n")).where("n > 1")


def feed_status(latest, now, *, fresh_hours: float = 26, stale_hours: float = 80):
    """FRESH, DELAYED, STALE, or UNAVAILABLE where nothing came, from the latest time of a feed."""
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(latest.cast("timestamp"))) / 3600
    return F.when(hours.isNull(), "UNAVAILABLE").when(hours <= fresh_hours, "FRESH").when(hours <= stale_hours, "DELAYED").otherwise("STALE")


def freshness(df: DataFrame, time: str, now, by: list[str] | None = None, **limits) -> DataFrame:
    """Per feed its latest time, rows and status; without `by` all rows are one feed, which may be empty."""
    return df.groupBy(*(by or [])).agg(F.max(time).alias("latest"), F.count("*").alias("n")).withColumn("status", feed_status(F.col("latest"), now, **limits))


def lag_summary(df: DataFrame, start: str, end: str, by: list[str] | None = None) -> DataFrame:
    seconds = F.unix_timestamp(F.col(end).cast("timestamp")) - F.unix_timestamp(F.col(start).cast("timestamp"))
    rows = df.select(*(by or []), seconds.alias("_q"))
    g = rows.groupBy(*(by or [])).agg(F.max("_q").alias("max_s"), F.count("_q").alias("n"))
    return with_percentiles(g, percentiles(rows, ["_q"], [0.5], by), by or [], median_s=F.get("_q", F.lit(0)))


def coverage(members: DataFrame, delivered: DataFrame, key: str, least: float = 0.80) -> DataFrame:
    """Members, how many of them were delivered, the share, and ready."""
    d = delivered.select(key).distinct().withColumn("_d", F.lit(1))
    return members.select(key).distinct().join(d, key, "left").agg(F.count("*").alias("members"), F.count("_d").alias("delivered")).withColumn(
        "share", F.col("delivered") / F.nullif(F.col("members"), F.lit(0))).withColumn("ready", F.coalesce(F.col("share") >= least, F.lit(False)))


def state_gaps(df: DataFrame, payload: str, field: str, key: str, time: str, *, n: int = 20) -> DataFrame:
    """The n most frequent values of a JSON field: rows, keys, first and last time; ties by value."""
    v = F.get_json_object(payload, f"$.{field}")
    return df.select(v.alias("value"), key, time).where("value is not null").groupBy("value").agg(
        F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.min(time).alias("first"), F.max(time).alias("last")).orderBy(F.desc("n"), "value").limit(n)


def stuck(runs: DataFrame, now, *, hours: float = 6) -> DataFrame:
    """Runs that began over `hours` ago and have not ended."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))) / 3600
    return runs.where(F.col("ended_at").isNull() & (age > hours)).withColumn("hours", age)


def repeated_exclusions(runs: DataFrame, items: str = "excluded", run: str = "run_id", *, least: int = 2) -> DataFrame:
    """Members that `least` runs or more left out."""
    each = runs.select(run, F.explode(items).alias("member")).distinct()
    return each.groupBy("member").agg(F.count("*").alias("runs")).where(F.col("runs") >= least)


def growth(df: DataFrame, time: str, by: list[str] | None = None) -> DataFrame:
    """Rows, first and last time, and rows a day over the span (of one day at least)."""
    days = F.greatest(F.lit(1.0), (F.unix_timestamp(F.max(time).cast("timestamp")) - F.unix_timestamp(F.min(time).cast("timestamp"))) / 86400)
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), (F.count("*") / days).alias("rows_per_day"))


def version_drift(df: DataFrame, versions: list[str], time: str) -> DataFrame:
    """Every combination of versions with its span and rows, and whether another one was recorded inside that span."""
    w = Window.orderBy("first", *versions)  # a handful of combinations
    g = df.groupBy(*versions).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))
    return g.withColumn("overlaps", F.coalesce(F.lead("first").over(w) < F.col("last"), F.lit(False)) | F.coalesce(
        F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("first"), F.lit(False)))


def _observed(d: dt.date) -> dt.date:
    return d - dt.timedelta(1) if d.weekday() == 5 else d + dt.timedelta(1) if d.weekday() == 6 else d


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    if n > 0:
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = (first + dt.timedelta(31)).replace(day=1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def easter(year: int) -> dt.date:
    """Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return dt.date(year, month, day + 1)


def holidays(year: int) -> set[dt.date]:
    """US market holidays of a year."""
    out = {
        _observed(dt.date(year, 7, 4)), _observed(dt.date(year, 12, 25)), _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _nth(year, 5, 0, -1),
        _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), easter(year) - dt.timedelta(2),
    }
    if dt.date(year, 1, 1).weekday() != 5:
        out.add(_observed(dt.date(year, 1, 1)))
    if year >= 2022:
        out.add(_observed(dt.date(year, 6, 19)))
    return out


def trading_days(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    closed = {d for y in range(start.year, end.year + 1) for d in holidays(y)}
    days = (start + dt.timedelta(i) for i in range((end - start).days + 1))
    return spark.createDataFrame([(d,) for d in days if d.weekday() < 5 and d not in closed], "day date")
