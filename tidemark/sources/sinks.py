"""Tables that are only appended to, or rebuilt whole, on Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .io import append_new
from .shared import store


def append_linked(spark: SparkSession, new: DataFrame, path: str, link: str, with_link: list[str], without: list[str]) -> int:
    """Insert-only with two identities: rows with a link by `with_link`, the others by `without`. Gives rows written."""
    return append_new(spark, new.where(F.col(link).isNotNull()), path, with_link) + append_new(spark, new.where(F.col(link).isNull()), path, [*without, link])


def projection(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key of an append-only log; of several, the last in order of its columns."""
    others = [c for c in log.columns if c not in (key, *order)]
    w = Window.partitionBy(key).orderBy(*map(F.desc, (*order, *others)))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def vector_rows(features: DataFrame, names: list[str], version: str) -> DataFrame:
    """Feature vectors to store: one JSON of what is known; an entity with nothing known has none."""
    known = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]), lambda k, v: v.isNotNull())
    out = features.select("entity_id", "event_time", F.lit(version).alias("version"), F.to_json(known).alias("features"), F.size(known).alias("n"))
    return out.where("n > 0").drop("n")


def gate_rows(wide: DataFrame, gates: list[str], keys: list[str]) -> DataFrame:
    """One row per key and gate (gate, passed) from a column per gate."""
    return wide.unpivot(keys, gates, "gate", "passed")


def append_signals(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Signals of one identity (entity_id, scan_date, version) are written once; one that supersedes another is
    a record of its own, by what it supersedes."""
    first = append_new(spark, new.where("supersedes is null"), path, ["entity_id", "scan_date", "version", "supersedes"])
    return first + append_new(spark, new.where("supersedes is not null"), path, ["supersedes"])


def sequenced(new: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New events with sequence numbers that go on from the stored ones of their key."""
    top = stored.groupBy(key).agg(F.max("sequence_number").alias("_top"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.withColumn("_nth", nth).join(top, key, "left").withColumn("sequence_number", (F.coalesce("_top", F.lit(-1)) + F.col("_nth")).cast("int")).drop("_nth", "_top")


def concluded(cases: DataFrame, events: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases with concluded_at, the time of their CONCLUDED event."""
    ends = events.where("status = 'CONCLUDED'").groupBy(key).agg(F.min("at").alias("concluded_at"))
    return cases.drop("concluded_at").join(ends, key, "left")


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """The partitions that df has are replaced by its rows; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


#: Folders by which keyed appends find stored keys: an append reads those its own keys fall into.
BUCKETS = 64


def append_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], *, order: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Insert-only append of one micro-batch (for foreachBatch): rows lie under key_bucket=b/batch_id=n. Of rows with one key
    the first (by `order`) of the earliest batch stays; keys compare null-safe.

    A batch that comes again, after a failure, gives the same rows, as it is compared with those of earlier batches only, and
    its folders replace those it wrote before. Batches are numbered by the stream's checkpoint, so one checkpoint belongs
    to one table. Stored keys are read from the batch's buckets only."""
    spark = batch.sparkSession
    w = Window.partitionBy(*keys).orderBy(*(order or keys))
    new = batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    new = store(new.withColumns({"key_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), "batch_id": F.lit(batch_id).cast("bigint")}))
    old = stored_rows(spark, path, new)
    if old is not None:
        touched = [r[0] for r in new.select("key_bucket").distinct().collect()]  # `buckets` at most
        earlier = old.where(F.col("key_bucket").isin(touched) & (F.col("batch_id") < batch_id)).select(*[F.col(k).alias("_" + k) for k in keys], F.col("key_bucket").alias("_b"))
        same = F.col("key_bucket") == F.col("_b")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col("_" + k))
        new = store(new.join(earlier, same, "left_anti"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket", "batch_id").parquet(path)


def stored_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The table at path, with the schema of `like`; None where nothing is stored."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, **options):
    """Starts an insert-only append of a stream that no restart repeats."""
    writer = stream.writeStream.foreachBatch(lambda batch, n: append_batch(batch, n, path, keys, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
