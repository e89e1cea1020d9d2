"""Recorded provider responses of all kinds, in batch and as a stream: files of JSON become rows of the translators.

A file holds a list of records, an object with the list under a known key, or one record. An error object, and what
is no JSON, gives no row. Files are read by Spark's own text source, so they may lie in any store that Spark reads, and a
stream with a checkpoint takes each file once."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, translate
from .io import ENVELOPES

#: Names under which an object says that there is no data.
ERRORS = ("Error Message", "error", "errorMessage", "Information")


def _listing(raw: DataFrame) -> DataFrame:
    p = F.col("payload")
    return raw.select(
        normalize.symbol(F.col("symbol")).alias("symbol"), normalize.field(p, "name", "companyName").alias("name"), normalize.field(p, "exchangeShortName", "exchange").alias("exchange"),
        normalize.field(p, "type").alias("type"), F.to_date(normalize.timestamp(normalize.field(p, "ipoDate"))).alias("listed_from"), F.to_date(normalize.timestamp(normalize.field(p, "delistedDate"))).alias("listed_to"),
        F.when(F.coalesce(F.trim("symbol"), F.lit("")) == "", "no_symbol").alias("rejected"))


def _scheduled(raw: DataFrame, kind: str) -> DataFrame:
    """Calendar entries: an event of a day, as of whenever the caller fetched it."""
    at = F.to_date("date").cast("timestamp")
    return raw.select(normalize.symbol(F.col("symbol")).alias("symbol"), F.lit(kind).alias("event_type"), at.alias("scheduled_for"), F.col("payload").alias("details"), F.when(at.isNull(), "no_date").alias("rejected"))


def _merger(raw: DataFrame) -> DataFrame:
    p = F.col("payload")
    at = normalize.timestamp(normalize.field(p, "acceptedDate", "transactionDate"))
    return raw.select(
        normalize.symbol(F.col("symbol")).alias("symbol"), F.lit("MERGER").alias("action_type"), F.to_date(normalize.timestamp(normalize.field(p, "transactionDate"))).alias("effective_date"), at.alias("observation_time"),
        normalize.field(p, "targetedSymbol").alias("target"), p.alias("details"), F.when(at.isNull(), "no_time").alias("rejected"))


def _snapshot(raw: DataFrame, kind: str) -> DataFrame:
    """Records kept whole: ratios, metrics, scores, profiles."""
    at = normalize.timestamp(F.coalesce(normalize.field(F.col("payload"), "acceptedDate", "filingDate"), F.col("date")))
    return raw.select(normalize.symbol(F.col("symbol")).alias("symbol"), F.lit(kind).alias("kind"), F.to_date("date").alias("fiscal_period_end"), at.alias("observation_time"), F.col("payload").alias("data"),
                      F.when(F.coalesce(F.trim("symbol"), F.lit("")) == "", "no_symbol").alias("rejected"))


def _fields(raw: DataFrame, *names: str) -> DataFrame:
    return raw.select("symbol", "date", *[normalize.field(F.col("payload"), n).alias(n) for n in names])


#: What becomes of the records of each kind (symbol, date, period, payload).
KINDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "stock_list": _listing, "screener": _listing, "delisted": _listing,
    "history": lambda r: translate.bars(_fields(r, "open", "high", "low", "close", "volume").withColumn("date", F.to_date("date"))),
    "income": partial(translate.fundamentals, statement="INCOME"), "balance_sheet": partial(translate.fundamentals, statement="BALANCE_SHEET"),
    "cash_flow": partial(translate.fundamentals, statement="CASH_FLOW"),
    "profile": partial(_snapshot, kind="profile"), "key_metrics": partial(_snapshot, kind="key_metrics"), "ratios": partial(_snapshot, kind="ratios"), "scores": partial(_snapshot, kind="scores"),
    "splits": partial(translate.actions, kind="SPLIT"), "dividends": partial(translate.actions, kind="DIVIDEND"), "mergers": _merger,
    "earnings": partial(_scheduled, kind="EARNINGS"),
    "news": lambda r: translate.news(_fields(r, "publishedDate", "title", "site", "url", "text")),
    "ownership": translate.holdings, "insider": translate.insider_trades, "filings": translate.filings,
    **{kind: partial(translate.terminal, kind=kind) for kind in translate.TERMINAL},
}


def records(files: DataFrame, col: str = "value") -> DataFrame:
    """symbol, date, period and payload (its JSON) of each record of whole files."""
    text = F.trim(F.col(col))
    under = F.coalesce(*[F.when(F.get_json_object(text, f"$.{k}").startswith("["), F.get_json_object(text, f"$.{k}")) for k in ENVELOPES])
    failed = F.coalesce(*[F.get_json_object(text, f"$['{e}']") for e in ERRORS]).isNotNull()
    listed = F.coalesce(under, F.when(text.startswith("["), text))
    each = F.when(listed.isNotNull(), F.from_json(listed, "array<string>")).when(text.startswith("{") & ~failed, F.array(text))
    # an envelope may name the symbol for all of its records
    owner = F.when(text.startswith("{"), F.get_json_object(text, "$.symbol"))
    rows = files.select(owner.alias("_owner"), F.explode(each).alias("payload")).where(F.col("payload").startswith("{"))
    p = F.col("payload")
    return rows.select(
        F.coalesce(normalize.field(p, "symbol"), F.col("_owner")).alias("symbol"), normalize.field(p, "date").alias("date"), normalize.field(p, "period").alias("period"), "payload")


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Canonical rows of the recorded files of a kind; unusable ones say why in `rejected`."""
    return KINDS[kind](records(spark.read.text(path, wholetext=True)))


def load_stream(spark: SparkSession, path: str, kind: str, *, files_per_trigger: int = 100) -> DataFrame:
    """The same as files arrive."""
    return KINDS[kind](records(spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).text(path)))
