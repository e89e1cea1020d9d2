"""As-of reads of append-only tables: what was knowable at an instant.

Every row has availability_time; the bound is inclusive. Intervals are half-open, a null
end is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join


def _instant(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t)


def knowable(df: DataFrame, as_of, *, availability: str = "availability_time") -> DataFrame:
    """All versions that were available at as_of."""
    return df.where(F.col(availability) <= _instant(as_of))


def latest(df: DataFrame, keys: list[str], as_of=None, *, precedence=(), availability: str = "availability_time", ties=()) -> DataFrame:
    """The newest knowable row per key: by precedence, then availability, then ties, all descending."""
    known = df if as_of is None else knowable(df, as_of, availability=availability)
    order = [F.col(c).desc_nulls_last() for c in (*precedence, availability, *ties)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return known.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def newest(df: DataFrame, keys: list[str], n: int, as_of=None, **kwargs) -> DataFrame:
    """The n newest knowable rows per key, numbered from 1 in column `nth`."""
    availability = kwargs.get("availability", "availability_time")
    known = df if as_of is None else knowable(df, as_of, availability=availability)
    order = [F.col(c).desc_nulls_last() for c in (*kwargs.get("precedence", ()), availability, *kwargs.get("ties", ()))]
    return known.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def earliest_knowledge(df: DataFrame, keys: list[str], as_of, *, availability: str = "availability_time") -> DataFrame:
    """Per key the version that was known first; of several known at once the first in order of its columns."""
    others = [c for c in df.columns if c not in (*keys, availability)]
    w = Window.partitionBy(*keys).orderBy(availability, *others)
    return knowable(df, as_of, availability=availability).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def covers(start: str, end: str, t: Column) -> Column:
    return (F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t))


def valid_at(df: DataFrame, t, *, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return df.where(covers(start, end, _instant(t)))


def label_as_of(facts: DataFrame, intervals: DataFrame, key: str, time: str, *, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Left join of each fact to the intervals of its key that hold its time."""
    return interval_join(facts, intervals, [key], time, start, end, how="left")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, ties=(), *, slices: int = 1) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time (null if none)."""
    return bitemporal_join(left, right, key, left_time, right_time, right_time, ties, slices=slices)


def bitemporal_join(left: DataFrame, right: DataFrame, key: str, left_time: str, event: str, availability: str, ties=(), *, slices: int = 1) -> DataFrame:
    """Each left row with the right row of its key that has the newest event among those whose event and availability
    both are at or before its time (null if none); of one event the version that became available last, then ties.

    A right row is seen from the later of its two times on. So both sides go through one shuffle by key and one window
    in that order, in which the newest event so far is a running maximum: versions that come late or restate an older
    event need no second pass, and no left row meets more than one right row. With `slices` time is cut at
    quantiles, a key's slices are tasks of their own, and what a slice has seen last is handed to all later ones."""
    values = [c for c in right.columns if c != key]
    ranks = F.struct(F.col(event).alias("event"), F.col(availability).alias("availability"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)])
    usable = F.col(key).isNotNull() & F.col(event).isNotNull() & F.col(availability).isNotNull()
    r = right.where(usable).select(F.col(key), F.greatest(event, availability).alias("_t") if event != availability else F.col(event).alias("_t"), F.lit(0).alias("_side"), ranks.alias("_rank"), F.struct(*values).alias("_r"))
    kind = r.schema["_r"].dataType
    l = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))  # noqa: E741
    parts = [key]
    if slices > 1:
        bounds = r.agg(F.percentile_approx("_t", [i / slices for i in range(1, slices)], 1000).alias("_bounds"))
        later = sum((F.coalesce(F.col("_t") > F.get("_bounds", F.lit(i)), F.lit(False)).cast("int") for i in range(slices - 1)), F.lit(0))
        r, l = (x.crossJoin(F.broadcast(bounds)).withColumn("_slice", later).drop("_bounds") for x in (r, l))  # noqa: E741
        seen = r.where(F.col("_slice") < slices - 1).groupBy(key, "_slice").agg(F.max_by("_r", "_rank").alias("_r"), F.max("_rank").alias("_rank"))
        handed = seen.select(key, F.explode(F.sequence(F.col("_slice") + 1, F.lit(slices - 1))).alias("_slice"), F.lit(0).alias("_side"), "_rank", "_r")
        r = r.unionByName(handed, allowMissingColumns=True)
        parts.append("_slice")
    both = r.unionByName(l, allowMissingColumns=True)
    w = Window.partitionBy(*parts).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.max_by("_r", "_rank").over(w).cast(kind)).where("_side = 1")
    return out.select("_l.*", *[F.col("_r")[c].alias(c if c not in left.columns else c + "_right") for c in values])


def why_empty(df: DataFrame, as_of, *, availability: str = "availability_time") -> DataFrame:
    """One row: whether nothing was ever stored, nothing was available yet, or there is data."""
    n, known = F.count("*"), F.count_if(F.col(availability) <= _instant(as_of))
    return df.agg(F.when(n == 0, "never_ingested").when(known == 0, "not_yet_available").otherwise("available").alias("reason"), n.alias("n"), known.alias("n_known"))


def overlaps(df: DataFrame, key: str, *, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(key).orderBy(start, F.col(end).asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.coalesce(F.col(end), F.lit("9999-12-31").cast("timestamp_ntz"))).over(before)
    return df.where(F.col(start).isNotNull()).withColumn("_reach", reach).where(F.col(start) < F.col("_reach")).drop("_reach")
