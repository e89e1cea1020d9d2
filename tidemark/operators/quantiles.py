"""Exact percentiles, prefix sums and drawdowns of groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import store

#: Values that one task may sort; larger groups are narrowed first.
GATHER = 100_000
#: Cells of a range histogram, and how well a sketch places their edges.
GRID, ACCURACY = 32, 1000


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra=None) -> DataFrame:
    """Join on keys, null equal to null; the right side's keys go. extra: a further condition."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return left.join(r, on if extra is None else on & extra, how).drop(*[f"_r_{k}" for k in keys])


def percentiles(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None, *, gather: int = GATHER) -> DataFrame:
    """Per group an array of interpolated percentiles for each column, as `percentile` gives them. Nulls are
    passed over, NaN is above all numbers; groups without any value have no row.

    Groups of `gather` values at most are sorted where they are. Beyond that, ranks are selected: the range of
    a group's column is cut into cells by a sketch of its quantiles, the cells (edges apart from what lies
    between them) are counted exactly, and each wanted rank goes on in the one cell that holds it, until that
    is one value or small enough to sort. The sketch only speeds this up: the counts decide. Values are spread over all
    tasks in each pass; what is shuffled are counts of cells, and in the last pass the cells with a wanted rank."""
    by = by or []
    counts = df.groupBy(*by).agg(F.array_max(F.array(*[F.count(F.col(c)) for c in columns])).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) > gather:
        return _selected(df, columns, probabilities, by, gather)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    out = df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(c) for c in columns])
    return out.where(F.coalesce(*[F.col(c) for c in columns]).isNotNull())


def _selected(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str], gather: int) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("_c"), (F.col(c).cast("double") + 0.0).alias("_x")) for i, c in enumerate(columns)])
    # ranks need the same values in each pass
    values = store(df.select(*by, F.inline(each)).where("_x is not null"))
    keys = [*by, "_c"]
    sizes = store(values.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*[f(x).cast("bigint") for x in at for f in (F.floor, F.ceil)]))
    state = store(sizes.select(*keys, F.explode(ranks).alias("_k"), F.lit(0).cast("bigint").alias("_before"), "_n", "_lo", "_hi"))
    wide = (F.col("_n") > gather) & (F.col("_lo") < F.col("_hi"))
    while not state.where(wide).isEmpty():
        state = store(state.where(~wide).unionByName(_narrowed(values, state.where(wide), keys)))
    bracket = [*keys, "_lo", "_hi"]
    several = F.col("_lo") < F.col("_hi")
    sorted_cells = _within(values, state.where(several).select(*bracket).distinct(), keys).groupBy(*bracket).agg(F.sort_array(F.collect_list("_x")).alias("_sorted"))
    found = join_on(state, sorted_cells, bracket, "left").select(
        *keys, "_k", F.when(several, F.get("_sorted", (F.col("_k") - F.col("_before")).cast("int"))).otherwise(F.col("_lo")).alias("_v"))
    known = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_at"))
    both = join_on(sizes, known, keys)
    value = lambda k: F.element_at("_at", k.cast("bigint"))

    def between(x: Column) -> Column:
        low, high = F.floor(x), F.ceil(x)
        return F.when(value(low) == value(high), value(low)).otherwise((high - x) * value(low) + (x - low) * value(high))

    result = F.array(*[between(x) for x in at])
    return both.groupBy(*by).agg(*[F.any_value(F.when(F.col("_c") == i, result), True).alias(c) for i, c in enumerate(columns)])


def _within(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    return join_on(values, brackets, keys, extra=F.col("_x").between(F.col("_lo"), F.col("_hi")))


def _narrowed(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Each wanted rank with the cell of its bracket that holds it, as the new bracket."""
    bracket = [*keys, "_lo", "_hi"]
    cuts = [i / GRID for i in range(1, GRID)]
    edges = store(_within(values, wanted.select(*bracket).distinct(), keys).groupBy(*bracket).agg(F.percentile_approx("_x", cuts, ACCURACY).alias("_edges")))
    edge = [F.get("_edges", F.lit(i)) for i in range(len(cuts))]
    above = sum(((F.col("_x") > e).cast("int") for e in edge), F.lit(0))
    on_edge = reduce(lambda a, b: a | b, [F.col("_x") == e for e in edge])
    cells = _within(values, edges, keys).withColumn("_cell", 2 * above + on_edge.cast("int")).groupBy(*bracket, "_cell").agg(
        F.count("*").alias("_in"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
    before = Window.partitionBy(*bracket).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # 63 cells at most
    cells = cells.withColumn("_less", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    start = F.col("_before") + F.col("_less")
    held = join_on(wanted, cells, bracket, extra=(F.col("_k") >= start) & (F.col("_k") < start + F.col("_in")))
    return held.select(*keys, "_k", start.alias("_before"), F.col("_in").alias("_n"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"))


def with_percentiles(groups: DataFrame, found: DataFrame, by: list[str], **names: Column) -> DataFrame:
    """The rows of an aggregation by `by` with columns made of the percentiles of their groups."""
    out = join_on(groups, found, by, "left") if by else groups.join(F.broadcast(found), F.lit(True), "left")
    return out.withColumns(names).drop(*[c for c in found.columns if c not in by])


def drawdown(df: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group the largest fall of the running sum below its running maximum, which starts at the first value;
    rows without a value change nothing.

    Rows are ranged by group and order over all tasks. A range of a group is summed up as (sum, highest, lowest
    running sum, largest fall inside), and such summaries merge in order: a fall may begin in one range and end in a later one."""
    by = by or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_x"))
    ranged = ranged.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id())
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("_sum", F.sum("_x").over(w)).withColumn("_peak", F.max("_sum").over(w))
    part = ranged.groupBy(*by, "_range").agg(
        F.sum("_x").alias("_all"), F.max("_sum").alias("_high"), F.min("_sum").alias("_low"), F.min(F.col("_sum") - F.col("_peak")).alias("_fall"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    part = part.withColumn("_start", F.coalesce(F.sum("_all").over(earlier), F.lit(0.0)))
    part = part.withColumn("_top", F.max(F.col("_start") + F.col("_high")).over(earlier))
    return part.groupBy(*by).agg(F.min(F.least("_fall", F.col("_start") + F.col("_low") - F.col("_top"))).alias("max_drawdown"))
