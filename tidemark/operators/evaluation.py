"""Outcome statistics and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import drawdown, percentiles, with_percentiles

Z95 = 1.959963984540054


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """Wilson interval, clipped to [0, 1]; the whole of it for no trials."""
    n, p = F.nullif(total, F.lit(0)).cast("double"), successes / F.nullif(total, F.lit(0))
    mid = (p + Z95**2 / (2 * n)) / (1 + Z95**2 / n)
    half = Z95 / (1 + Z95**2 / n) * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n))
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)  # these pass over nulls


def distribution(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Mean, its normal 95 % interval (a point below two values) and percentiles 10 to 90."""
    x = F.col(col)
    n, mean = F.count(x), F.avg(x)
    half = F.when(n >= 2, Z95 * F.stddev_samp(x) / F.sqrt(n)).otherwise(0.0)
    points = (10, 25, 50, 75, 90)
    groups = df.groupBy(*(by or [])).agg(n.alias("n"), mean.alias("mean"), (mean - half).alias("mean_low"), (mean + half).alias("mean_high"))
    found = percentiles(df.select(*(by or []), x.alias("_q")), ["_q"], [p / 100 for p in points], by)
    return with_percentiles(groups, found, by or [], **{f"p{p}": F.get("_q", F.lit(i)) for i, p in enumerate(points)})


def sufficiency(n: Column, least: int = 5, preferred: int = 30) -> Column:
    return F.when(n < least, "INSUFFICIENT").when(n < preferred, "SPARSE").otherwise("ADEQUATE")


def confusion(df: DataFrame, predicted: Column, actual: Column, resolved: Column, by: list[str] | None = None) -> DataFrame:
    count = lambda c: F.count_if(resolved & c)
    return df.groupBy(*(by or [])).agg(
        count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"),
        count(~predicted & actual).alias("fn"), count(~predicted & ~actual).alias("tn"))


def rates(confused: DataFrame) -> DataFrame:
    div = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confused.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "false_positive_rate": div(fp, fp + tn)})


def max_drawdown(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Largest fall of the running sum below its running maximum, which starts at the first value."""
    return drawdown(df, value, order, by)


EDGES = [20, 40, 60, 80, 90, 100]


def score_bucket(score: Column, edges: list[float] = EDGES) -> Column:
    """Lower edge of the half-open bucket (the last is closed); null below the first."""
    out = F.when((score >= edges[-2]) & (score <= edges[-1]), edges[-2])
    for a, b in zip(edges[:-2], edges[1:-1]):
        out = out.when((score >= a) & (score < b), a)
    return out


def monotonicity(buckets: DataFrame, order: str, value: str, tolerance: float = 0.02) -> DataFrame:
    """Adjacent violations, top less bottom, and Spearman correlation of bucket order and value."""
    w = Window.orderBy(order)  # a handful of buckets
    r = buckets.withColumn("_v", (F.col(value) < F.lag(value).over(w) - tolerance).cast("int")).withColumn("_ro", F.rank().over(w))
    r = r.withColumn("_rv", F.rank().over(Window.orderBy(value)) + (F.count("*").over(Window.partitionBy(value)) - 1) / 2)
    return r.agg(
        F.coalesce(F.sum("_v"), F.lit(0)).alias("violations"), (F.max_by(value, order) - F.min_by(value, order)).alias("top_less_bottom"),
        F.corr("_ro", "_rv").alias("spearman"))


def calibration(df: DataFrame, score: str, outcome: Column, bins: int = 10, high: float = 100.0, least: int = 10) -> DataFrame:
    """Equal bins of the score with their mean score and, from `least` rows on, the rate of the outcome."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) / (high / bins))).cast("int")
    return df.where(F.col(score).between(0, high)).groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.when(F.count("*") >= least, F.avg(outcome.cast("double"))).alias("rate"))


def walk_forward(df: DataFrame, time: str, start: str, end: str, *, train: int = 730, test: int = 365, step: int = 365) -> DataFrame:
    """Each row once per window and split it falls in; both ends belong to a split."""
    spark = df.sparkSession
    days = f"datediff(DATE '{end}', DATE '{start}') - {train + test}"  # of the last window's start
    rows = spark.sql(
        f"SELECT CAST(i AS INT) AS window, DATE '{start}' + CAST(i * {step} AS INT) AS a FROM (SELECT explode(sequence(0, greatest(0, {days}) DIV {step})) AS i WHERE {days} >= 0)")
    splits = rows.select("window", F.inline(F.array(
        F.struct(F.lit("train").alias("split"), F.col("a").alias("lo"), F.date_add("a", train).alias("hi")),
        F.struct(F.lit("test").alias("split"), F.date_add("a", train).alias("lo"), F.date_add("a", train + test).alias("hi")))))
    day = F.to_date(time)
    return df.join(F.broadcast(splits), (day >= F.col("lo")) & (day <= F.col("hi"))).drop("lo", "hi")


def histogram(df: DataFrame, col: str, *, bins: int = 12, clip: float = 2.0) -> DataFrame:
    """Clipped histogram with all bins, the last one closed."""
    width = 2 * clip / bins
    x = F.least(F.lit(clip), F.greatest(F.lit(-clip), F.col(col)))
    b = F.least(F.lit(bins - 1), F.floor((x + clip) / width)).cast("int")
    have = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(have, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def first_source(*sources: DataFrame, key: str) -> DataFrame:
    """Union of sources; of rows with one key that of the first source stays, and of its rows the first in order of its columns."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        out = s if out is None else out.unionByName(s)
    w = Window.partitionBy(key).orderBy("_source", *[c for c in sources[0].columns if c != key])
    return out.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_source")
