"""Signals from counted events: volume against a baseline, distinct actors, period trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def volume_signal(events: DataFrame, key: str, time: str, day, *, baseline_days: int = 30, multiple: float = 3.0) -> DataFrame:
    """Per key: today's count, mean of the days before, first day known, and raised: null without a full
    baseline of history, any event if the baseline is empty, else today >= multiple * mean."""
    d = F.to_date(time)
    today = F.count_if(d == F.lit(day).cast("date"))
    base = F.count_if((d < F.lit(day).cast("date")) & (d >= F.date_sub(F.lit(day).cast("date"), baseline_days)))
    out = events.where(d <= F.lit(day).cast("date")).groupBy(key).agg(today.alias("today"), base.alias("baseline_total"), F.min(d).alias("first_day"))
    full = F.col("first_day") <= F.date_sub(F.lit(day).cast("date"), baseline_days)
    raised = F.when(F.col("baseline_total") == 0, F.col("today") > 0).otherwise(F.col("today") >= multiple * F.col("baseline_total") / baseline_days)
    return out.withColumn("raised", F.when(full, raised))


def cluster_signal(trades: DataFrame, key: str, actor: str, time: str, code: str, day, *, wanted: str = "P", days: int = 30, least: int = 2) -> DataFrame:
    """Distinct actors with the wanted code in the last days, the day included; raised at `least`."""
    d = F.to_date(time)
    inside = (d >= F.date_sub(F.lit(day).cast("date"), days)) & (d <= F.lit(day).cast("date"))
    return trades.groupBy(key).agg(F.countDistinct(F.when(inside & (F.col(code) == wanted), F.col(actor))).alias("actors")).withColumn("raised", F.col("actors") >= least)


def period_trend(df: DataFrame, key: str, period: list[str], value: str) -> DataFrame:
    """The newest two periods per key and the change between them."""
    w = Window.partitionBy(key).orderBy(*[F.desc(p) for p in period])
    r = df.withColumn("_nth", F.row_number().over(w)).where("_nth <= 2")
    out = r.groupBy(key).agg(F.max(F.when(F.col("_nth") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("_nth") == 2, F.col(value))).alias("previous"))
    return out.withColumn("change", F.col("latest") - F.col("previous"))
