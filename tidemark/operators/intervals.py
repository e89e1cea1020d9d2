"""Joins of points in time with intervals, by buckets of time: an equi-join, whatever the intervals' lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import store

#: Widths of buckets in days; an interval goes to the narrowest ones that are as wide as it is long, one that
#: is longer or open to a bucket that holds all time.
WIDTHS = [1, 8, 64, 512, 4096]
ALL = len(WIDTHS)


def day(time: Column) -> Column:
    """The number of a time's day; it never falls as times rise, whatever the type and the time zone."""
    return F.unix_date(F.to_date(time))


def _level(length: Column) -> Column:
    out = F.when(length <= WIDTHS[0], 0)
    for i, width in enumerate(WIDTHS[1:], 1):
        out = out.when(length <= width, i)
    return out.otherwise(ALL)


def _bucket(at: Column, level: Column) -> Column:
    width = F.element_at(F.array(*[F.lit(w) for w in WIDTHS], F.lit(1 << 30)), level + 1)
    return F.when(level == ALL, 0).otherwise(F.floor(at / width)).cast("int")


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, *, closed: bool = False, how: str = "inner") -> DataFrame:
    """Points with the intervals of their key that hold their time: [start, end), with `closed` [start, end]; a null
    end is open, a null start holds nothing. how: `inner` or `left`. Columns of intervals that points have, too, end in _right.

    An interval has one width of buckets and touches two of them at most, a point goes to its bucket of each width in
    use. So each pair meets once, on (key, width, bucket), and a key with many rows on both sides is spread over its
    buckets. For a left join the points are stored with a number first, as all widths must agree on what has no match.
    It shuffles its pairs; where a point has many and only totals are wanted, interval_totals shuffles none."""
    left = how == "left"
    if left:
        points = _numbered(points)
    pairs, added = _pairs(points, intervals, keys, time, start, end, closed, ["_id"] if left else points.columns)
    if not left:
        return pairs.select("_p.*", *added)
    return points.join(pairs.select(F.col("_p._id").alias("_match"), "_i"), F.col("_id") == F.col("_match"), "left").select(
        *[c for c in points.columns if c != "_id"], *added)


def interval_totals(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, totals: dict[str, Column], *, closed: bool = False) -> DataFrame:
    """Every point with aggregates over the intervals that interval_join gives it, nulls (0 for a count) where there are none.

    totals: aggregates of columns of the intervals by name. They are begun where the pairs meet, so that a point is
    shuffled once for each width of buckets, however many intervals hold it."""
    points = _numbered(points)
    pairs, added = _pairs(points.select("_id", *keys, F.col(time).alias("_at")), intervals, keys, "_at", start, end, closed, ["_id"])
    sums = pairs.select(F.col("_p._id").alias("_match"), *added).groupBy("_match").agg(*[c.alias(f"_t_{n}") for n, c in totals.items()])
    none = points.limit(0).select(F.lit(None).cast("bigint").alias("_match"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in intervals.schema if f.name not in keys])
    empty = none.agg(*[c.alias(f"_e_{n}") for n, c in totals.items()])
    out = points.join(sums, F.col("_id") == F.col("_match"), "left").join(F.broadcast(empty))
    return out.select(*[c for c in points.columns if c != "_id"], *[F.when(F.col("_match").isNull(), F.col(f"_e_{n}")).otherwise(F.col(f"_t_{n}")).alias(n) for n in totals])


def _numbered(points: DataFrame) -> DataFrame:
    return store(points.withColumn("_id", F.monotonically_increasing_id()))


def _pairs(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, closed: bool, own: list[str]) -> tuple[DataFrame, list[Column]]:
    """(_p, _i) of points (their columns `own`) and their intervals, and the intervals' columns as they are named beside a point's."""
    length = day(F.col(end)) - day(F.col(start))
    i = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | ((F.col(end) >= F.col(start)) if closed else (F.col(end) > F.col(start)))))
    names = [c for c in intervals.columns if c not in keys]
    i = i.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(start).alias("_from"), F.col(end).alias("_to"), F.struct(*names).alias("_i"), _level(length).alias("_level"))
    first, last = _bucket(day(F.col("_from")), F.col("_level")), _bucket(day(F.coalesce("_to", "_from")), F.col("_level"))
    i = i.withColumn("_bucket", F.explode(F.sequence(first, last)))
    levels = sorted(r[0] for r in i.select("_level").distinct().collect())  # six at most
    p = points.select(*keys, F.col(time).alias("_time"), F.struct(*own).alias("_p"))
    p = p.withColumn("_plevel", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_pbucket", _bucket(day(F.col("_time")), F.col("_plevel")))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{n}") for n, k in enumerate(keys)])
    on = on & (F.col("_level") == F.col("_plevel")) & (F.col("_bucket") == F.col("_pbucket"))
    before_end = F.col("_time") <= F.col("_to") if closed else F.col("_time") < F.col("_to")
    pairs = p.join(i, on & (F.col("_from") <= F.col("_time")) & (F.col("_to").isNull() | before_end)).select("_p", "_i")
    added = [F.col("_i")[c].alias(c + "_right" if c in points.columns else c) for c in names]
    return pairs, added
