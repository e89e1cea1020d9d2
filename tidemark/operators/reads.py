"""Serving reads over stored tables: search, series, latest blocks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(names: DataFrame, text: str, *, symbol: str = "symbol", name: str = "name", n: int = 30) -> DataFrame:
    """The n best matches: symbols that begin with the text first, then names that contain it; case does not count."""
    t = text.strip()
    starts, inside = F.startswith(F.upper(F.col(symbol)), F.lit(t.upper())), F.contains(F.lower(F.col(name)), F.lit(t.lower()))
    return names.where(starts | inside).withColumn("_k", F.when(starts, 0).otherwise(1)).orderBy("_k", symbol).limit(n).drop("_k")


def signals_of(scan: DataFrame, *, score: str = "score", tie: str = "signal_id", n: int = 100) -> DataFrame:
    return scan.orderBy(F.col(score).desc_nulls_last(), tie).limit(n)


def per_period(rows: DataFrame, key: str, period: str, observed: str) -> DataFrame:
    """Of each key and period the version that was observed last; of several, the last in order of its columns."""
    others = [c for c in rows.columns if c not in (key, period, observed)]
    w = Window.partitionBy(key, period).orderBy(F.desc(observed), *map(F.desc, others))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def series(rows: DataFrame, key: str, time: str, values: list[str], *, n: int) -> DataFrame:
    """The n newest points of each key, as one array in order of time. n bounds what a row holds."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *values)
    top = rows.select(key, time, *values).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(time, *values))).alias("points"))


def ratios(statements: DataFrame) -> DataFrame:
    """Margins and growth against the period before (columns revenue, gross_profit, net_income)."""
    w = Window.partitionBy("entity_id").orderBy("fiscal_period_end")
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    before = F.lag("revenue").over(w)
    return statements.withColumns({
        "gross_margin": over("gross_profit", "revenue"), "net_margin": over("net_income", "revenue"), "revenue_growth": F.col("revenue") / F.nullif(before, F.lit(0.0)) - 1})


def peers(members: DataFrame, key: str, groups: list[str], size: str, *, n: int = 10) -> DataFrame:
    """For each member of a group the n others that come next by size: by rank within the group, not by pairs."""
    w = Window.partitionBy(*groups).orderBy(F.desc(size), key)
    near = [x for i in range(1, n // 2 + 1) for x in (F.lag(key, i).over(w), F.lead(key, i).over(w))]
    return members.select(key, *groups, F.array_compact(F.array(*near)).alias("peers"))


def ordered_items(rows: DataFrame, key: str, items: str, keep: Column | None = None) -> DataFrame:
    """Distinct items of a key's arrays, of the rows to keep."""
    rows = rows if keep is None else rows.where(keep)
    return rows.select(key, F.explode(items).alias("_i")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_i")).alias(items))


def filed_on(filings: DataFrame, members: DataFrame, day: str, *, key: str = "entity_id", time: str = "observation_time", items: str = "items") -> DataFrame:
    """Every member with whether it filed that day and which items."""
    today = ordered_items(filings, key, items, F.to_date(time) == F.lit(day).cast("date"))
    return members.select(key).distinct().join(today, key, "left").withColumn("filed", F.col(items).isNotNull())


def failures_since_success(attempts: DataFrame, key: str, time: str, ok: str, since: Column) -> DataFrame:
    """Failed attempts of each key after its last success, from `since` on."""
    w = Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    recent = attempts.where(F.col(time) >= since)
    last = F.max(F.when(F.col(ok), F.col(time))).over(w)
    return recent.withColumn("_last", last).groupBy(key).agg(F.count_if(~F.col(ok) & (F.col("_last").isNull() | (F.col(time) > F.col("_last")))).alias("failures"))
