"""Tables between two steps of one query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a single machine takes a temporary
    folder, and a cluster refuses to go on, as its executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        base = context.getCheckpointDir().get()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Writes df and reads it back: what follows sees the same rows however often it reads them, lost
    executors included, and the planner sees real sizes."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
