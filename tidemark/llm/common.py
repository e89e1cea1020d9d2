"""Helpers shared by the text operators: word splitting, ASCII lower case, the
shared scratch folder, and a way to run an expression on every row exactly once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the word contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column, pattern: str = SPACE_WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. `lower` does the same on pure ASCII and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def windows(items: Column, size: int) -> Column:
    """64-bit hashes of all runs of `size` consecutive items; empty if there are fewer."""
    n = F.size(items)
    return F.when(
        n >= size,
        F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(items, i, size))),
    ).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; an expression named inside a lambda would
    otherwise run again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see. Where that is unset
    a temporary folder takes its place on a single machine; a cluster refuses to go on."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            base = kept.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes to the shared folder and reads back: cuts lineage, survives lost
    executors, and gives the planner real sizes."""
    path = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that start in this block hand texts to Python in batches of so many rows, not 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def threshold(df: DataFrame, count: str, most: int) -> int:
    """The smallest count that at most `most` rows reach (from a table of counts of counts, so no row moves for it)."""
    kept, least = 0, None
    # counts above 1000 in steps of a thousandth
    size = F.col(count).cast("double")
    step = F.when(size <= 1000, size).otherwise(F.floor(F.log(size / 1000) * 1000) + 1001).cast("int")
    for r in df.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min(count).alias("c")).orderBy(F.desc("s")).toLocalIterator():
        if kept + r["n"] > most:
            break
        kept, least = kept + r["n"], r["c"]
    return least if least is not None else 1 << 62


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a variant that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
