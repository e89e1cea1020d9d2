"""Rolling-window expressions over a dense panel (one row per entity and event time).

Rules: a rolling value is null unless all n rows are present and not null; a comparison
with null is false, not null; percentile ranks always divide by n; of equal extremes the
earliest counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ENTITY, TIME = "entity_id", "event_time"


def history() -> WindowSpec:
    return Window.partitionBy(ENTITY).orderBy(TIME)


def rows(n: int) -> WindowSpec:
    return history().rowsBetween(-(n - 1), 0)


def full(col: Column, n: int, agg: Callable[[Column], Column]) -> Column:
    """agg over the last n rows, null unless all n have a value."""
    return F.when(F.count(col).over(rows(n)) == n, agg(col).over(rows(n)))


def mean(col: Column, n: int) -> Column:
    return full(col, n, F.avg)


def std(col: Column, n: int) -> Column:
    return full(col, n, F.stddev_samp)


def highest(col: Column, n: int) -> Column:
    return full(col, n, F.max)


def lowest(col: Column, n: int) -> Column:
    return full(col, n, F.min)


def total(col: Column, n: int) -> Column:
    return full(col, n, F.sum)


def share(condition: Column, n: int) -> Column:
    """Share of the last n rows in which the condition holds; null comparisons do not hold."""
    return mean(F.coalesce(condition, F.lit(False)).cast("double"), n)


def number(condition: Column, n: int) -> Column:
    return total(F.coalesce(condition, F.lit(False)).cast("double"), n)


def expanding_max(col: Column) -> Column:
    return F.max(col).over(history().rowsBetween(Window.unboundedPreceding, 0))


def shift(col: Column, n: int = 1) -> Column:
    return F.lag(col, n).over(history())


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def change(col: Column, n: int) -> Column:
    return ratio(col, shift(col, n)) - 1


def log_return(close: Column) -> Column:
    ok = (close > 0) & (shift(close) > 0)
    return F.when(ok, F.ln(close / shift(close)))


def true_range(high: Column, low: Column, close: Column) -> Column:
    """Largest of the three ranges; null if any input is (so on the first bar)."""
    before = shift(close)
    parts = [high - low, F.abs(high - before), F.abs(low - before)]
    return F.when(high.isNotNull() & low.isNotNull() & before.isNotNull(), F.greatest(*parts))


def _join(older: Column, newer: Column) -> Column:
    """Extremes of two runs of rows, of which the newer begins no later than a row after the older ends.

    The runs may overlap: if both have the same first maximum it lies in the newer one, which knows all that follows it."""
    higher, lower = newer["hi"] > older["hi"], newer["lo"] < older["lo"]
    after = F.least(older["after"], newer["lo"])  # least skips nulls
    return F.struct(
        F.greatest(older["hi"], newer["hi"]).alias("hi"),
        F.when(higher, newer["hi_at"]).otherwise(older["hi_at"]).alias("hi_at"),
        F.when(higher | (newer["hi_at"] == older["hi_at"]), newer["after"]).otherwise(after).alias("after"),
        F.least(older["lo"], newer["lo"]).alias("lo"),
        F.when(lower, newer["lo_at"]).otherwise(older["lo_at"]).alias("lo_at"),
    )


def extremes(df: DataFrame, col: str, n: int) -> DataFrame:
    """Adds, over the last n rows and null unless all have a value: `_highest`, `_lowest`, `_since_max` and
    `_since_min` (rows since the first of them), and `_after_max`, the lowest value strictly after the first
    maximum, or the maximum if that is last. The panel has the row's number as `_bar`.

    By doubling: each step joins what a row knows of the 2^k rows up to it with what the row 2^k before knows of
    its own, and the last step lets the two overlap. So a row holds five numbers and costs log2(n) joins."""
    value = F.col(col)
    one = F.struct(
        value.alias("hi"), F.col("_bar").alias("hi_at"), F.lit(None).cast(df.schema[col].dataType).alias("after"), value.alias("lo"),
        F.col("_bar").alias("lo_at"),
    )
    out = df.withColumn("_run", one).withColumn("_seen", F.count(value).over(history()))
    size = 1
    while size < n:
        step = min(size, n - size)
        out = out.withColumn("_older", shift(F.col("_run"), step)).withColumn("_run", _join(F.col("_older"), F.col("_run")))
        size += step
    out = out.withColumn("_before", F.coalesce(shift(F.col("_seen"), n), F.lit(0)))
    whole, run = F.col("_seen") - F.col("_before") == n, F.col("_run")
    return out.withColumns({
        "_highest": F.when(whole, run["hi"]), "_lowest": F.when(whole, run["lo"]),
        "_since_max": F.when(whole, (F.col("_bar") - run["hi_at"]).cast("double")),
        "_since_min": F.when(whole, (F.col("_bar") - run["lo_at"]).cast("double")),
        "_after_max": F.when(whole, F.coalesce(run["after"], run["hi"])),
    }).drop("_run", "_older", "_seen", "_before")


def percentile_rank(col: Column, n: int) -> Column:
    """Share of the window at or below the current value; 0 where the current value is null."""
    v = F.collect_list(col).over(rows(n))
    at = F.coalesce(F.size(F.filter(v, lambda x: x <= col)), F.lit(0)) / F.lit(float(n))
    return F.when(F.row_number().over(history()) >= n, F.when(col.isNull(), F.lit(0.0)).otherwise(at))


def slope(col: Column, n: int) -> Column:
    """Least-squares slope against the bar index, which the panel has as `_bar`."""
    return F.when(F.count(col).over(rows(n)) == n, F.regr_slope(col, F.col("_bar")).over(rows(n)))
