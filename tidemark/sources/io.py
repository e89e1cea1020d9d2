"""Sources and sinks: provider files, envelopes, append-only and last-write-wins tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "history": "symbol string, date date, open decimal(20,6), high decimal(20,6), low decimal(20,6), close decimal(20,6), volume bigint",
    "eod_bulk": "symbol string, date date, open decimal(20,6), low decimal(20,6), high decimal(20,6), close decimal(20,6), adjClose decimal(20,6), volume bigint",
    "stock_list": "symbol string, name string, exchange string, exchangeShortName string, type string, price double",
    "delisted": "symbol string, companyName string, exchange string, ipoDate date, delistedDate date",
    "splits": "symbol string, date date, numerator int, denominator int",
    "dividends": "symbol string, date date, recordDate date, paymentDate date, declarationDate date, adjDividend double, dividend double, yield double, frequency string",
    "income": "symbol string, date date, period string, reportedCurrency string, acceptedDate timestamp, filingDate date, cik string, revenue bigint, grossProfit bigint, netIncome bigint, eps double",
    "news": "symbol string, publishedDate timestamp, title string, site string, url string, text string, image string",
    "earnings": "symbol string, date date, epsActual double, epsEstimated double, revenueActual bigint, revenueEstimated bigint, time string",
}
ENVELOPES = ("historical", "data", "results", "items")


def read_provider(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Recorded provider files: JSON arrays or CSV (by suffix), with the kind's fixed schema."""
    reader = spark.read.schema(SCHEMAS[kind])
    return reader.csv(path, header=True) if path.endswith(".csv") else reader.json(path, multiLine=True)


def unwrap(payloads: DataFrame, col: str, schema: str) -> DataFrame:
    """Rows of JSON payloads that are a list or hold one under a known key; an error object gives none."""
    body = F.coalesce(*[F.get_json_object(col, f"$.{k}") for k in ENVELOPES], F.when(F.trim(F.col(col)).startswith("["), F.col(col)))
    return payloads.select("*", F.inline(F.from_json(body, f"array<struct<{','.join(':'.join(p.strip().split(' ', 1)) for p in schema.split(', '))}>>")))


def append_new(spark: SparkSession, new: DataFrame, path: str, keys: list[str], *, order: list[str] | None = None) -> int:
    """Insert-only: of rows with one key the first stays, those stored before win; keys compare null-safe. Gives rows written."""
    w = Window.partitionBy(*keys).orderBy(*(order or keys))
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    try:
        old = spark.read.parquet(path).select(*[F.col(k).alias("_" + k) for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col("_" + k))
        first = first.join(old, same, "left_anti")
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    first = first.persist()
    n = first.count()
    first.write.mode("append").parquet(path)
    first.unpersist()
    return n


def upsert_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Last write wins per partition value; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
