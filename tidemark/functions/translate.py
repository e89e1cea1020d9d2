"""Provider records made canonical rows. Each translator keeps every row: `rejected` says why one is unusable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import interval_join
from .normalize import field, fingerprint, item_numbers, session_close, split_ratio, symbol, timestamp, transaction_code

END_OF_DAY = "INTERVAL '23:59:59' HOUR TO SECOND"


def _clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("rejected is null").drop("rejected"), df.where("rejected is not null")


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows) of a translator's result."""
    return _clean(df)


def bars(raw: DataFrame) -> DataFrame:
    """Daily bars (symbol, date, open, high, low, close, volume): known at the session's close; no
    volume is none traded, a missing price makes the bar unusable."""
    prices = [F.col(c).cast("decimal(20,6)") for c in ("open", "high", "low", "close")]
    missing = F.greatest(*[p.isNull().cast("int") for p in prices]) == 1
    at = session_close(F.col("date"))
    return raw.select(
        symbol(F.col("symbol")).alias("symbol"), at.alias("event_time"), at.alias("observation_time"), *[p.alias(f"{n}_raw") for p, n in zip(prices, ("open", "high", "low", "close"))],
        F.coalesce(F.col("volume").cast("bigint"), F.lit(0)).alias("volume_raw"),
        F.when(F.col("date").isNull(), "no_date").when(missing, "missing_price").alias("rejected"))


def fundamentals(raw: DataFrame, statement: str) -> DataFrame:
    """Statements (symbol, date, period, payload as JSON): known when accepted, else at the end of
    the filing day; with neither they are unusable."""
    accepted = timestamp(field(F.col("payload"), "acceptedDate"))
    filed = F.to_date(timestamp(field(F.col("payload"), "filingDate", "fillingDate"))).cast("timestamp") + F.expr(END_OF_DAY)
    at = F.coalesce(accepted, filed)
    return raw.select(
        symbol(F.col("symbol")).alias("symbol"), F.lit(statement).alias("statement_type"), F.col("period").alias("fiscal_period"), F.to_date("date").alias("fiscal_period_end"),
        at.alias("observation_time"), F.col("payload").alias("data"),
        F.when(F.to_date("date").isNull(), "no_period").when(at.isNull(), "no_observation_time").alias("rejected"))


def actions(raw: DataFrame, kind: str) -> DataFrame:
    """Splits and dividends (symbol, date, payload): a split needs a positive ratio, a dividend an amount."""
    ratio = split_ratio(F.col("payload"))
    amount = field(F.col("payload"), "dividend", "adjDividend", "amount").try_cast("double")
    bad = F.when(ratio.isNull(), "no_ratio") if kind == "SPLIT" else F.when(~F.coalesce(amount > 0, F.lit(False)), "no_amount")
    declared = timestamp(field(F.col("payload"), "declarationDate"))
    return raw.select(
        symbol(F.col("symbol")).alias("symbol"), F.lit(kind).alias("action_type"), F.to_date("date").alias("effective_date"),
        F.coalesce(declared, F.to_date("date").cast("timestamp")).alias("observation_time"), ratio.alias("ratio"), amount.alias("amount"), F.col("payload").alias("details"),
        F.coalesce(F.when(F.to_date("date").isNull(), "no_date"), bad).alias("rejected"))


def news(raw: DataFrame) -> DataFrame:
    at = timestamp(F.col("publishedDate").cast("string"))
    return raw.select(
        symbol(F.col("symbol")).alias("symbol"), at.alias("observation_time"), F.trim("title").alias("headline"), F.col("site").alias("source_site"), "url", F.col("text").alias("summary"),
        F.when(at.isNull(), "no_time").when(F.coalesce(F.trim("title"), F.lit("")) == "", "no_headline").alias("rejected"))


def insider_trades(raw: DataFrame, lag: str = "48 HOURS") -> DataFrame:
    """Form 4 rows (payload): one per transaction; known `lag` after the filing where that is stated as a day only."""
    p = F.col("payload")
    filed, traded = timestamp(field(p, "filingDate", "acceptedDate")), F.to_date(timestamp(field(p, "transactionDate")))
    at = F.coalesce(filed, traded.cast("timestamp") + F.expr(f"INTERVAL {lag}"))
    code = transaction_code(field(p, "transactionType", "transactionCode"))
    return raw.select(
        symbol(field(p, "symbol")).alias("symbol"), field(p, "reportingName", "reportingPerson").alias("reporting_person"), code.alias("transaction_code"), traded.alias("transaction_date"),
        field(p, "securitiesTransacted", "quantity").try_cast("double").alias("quantity"), field(p, "price").try_cast("double").alias("price"), at.alias("observation_time"),
        F.when(traded.isNull(), "no_date").when(code.isNull(), "unknown_code").alias("rejected"))


def holdings(raw: DataFrame, lag_days: int = 45) -> DataFrame:
    """Quarterly institutional summaries (payload): known `lag_days` after the quarter unless a filing time
    is stated; the fingerprint tells restated content apart."""
    p = F.col("payload")
    year, quarter = field(p, "year").try_cast("int"), field(p, "quarter").try_cast("int")
    end = F.last_day(F.make_date(year, F.when(quarter.between(1, 4), quarter * 3), F.lit(1)))
    at = F.coalesce(timestamp(field(p, "filingDate")), F.date_add(end, lag_days).cast("timestamp"))
    return raw.select(
        symbol(field(p, "symbol")).alias("symbol"), year.alias("year"), quarter.alias("quarter"), field(p, "investorsHolding").try_cast("bigint").alias("investors"),
        field(p, "numberOf13Fshares", "shares").try_cast("double").alias("shares"), at.alias("observation_time"), fingerprint(p).alias("content_fingerprint"),
        F.when(end.isNull(), "no_quarter").alias("rejected"))


def filings(raw: DataFrame) -> DataFrame:
    """8-K rows (payload) with their item numbers in order of mention."""
    p = F.col("payload")
    at = timestamp(field(p, "acceptedDate", "filingDate"))
    return raw.select(
        symbol(field(p, "symbol")).alias("symbol"), field(p, "formType", "type").alias("form"), field(p, "finalLink", "link").alias("link"), at.alias("observation_time"),
        item_numbers(F.coalesce(field(p, "items"), F.lit(""))).alias("items"), F.when(at.isNull(), "no_time").alias("rejected"))


#: Terminal records: the time's aliases, then column: (type, aliases in order).
TERMINAL: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, tuple[str, ...]]]]] = {
    "estimate": (("date",), {"revenue": ("double", ("revenueAvg", "estimatedRevenueAvg")), "eps": ("double", ("epsAvg", "estimatedEpsAvg")), "analysts": ("int", ("numAnalystsEps", "numberAnalystsEstimatedEps"))}),
    "compensation": (("acceptedDate", "filingDate"), {"person": ("string", ("nameAndPosition",)), "year": ("int", ("year",)), "salary": ("double", ("salary",)), "total": ("double", ("total",))}),
    "transcript": (("date",), {"year": ("int", ("year",)), "quarter": ("int", ("quarter", "period")), "content": ("string", ("content",))}),
    "price_target": (("lastUpdated", "date"), {"high": ("double", ("targetHigh",)), "low": ("double", ("targetLow",)), "consensus": ("double", ("targetConsensus",)), "median": ("double", ("targetMedian",))}),
    "peers": (("date",), {"peer": ("string", ("peersList", "symbol"))}),
    "fund_holding": (("acceptedDate", "date"), {"fund": ("string", ("holder", "fundName")), "shares": ("double", ("sharesNumber", "shares")), "weight": ("double", ("weightPercentage",))}),
    "grade": (("date",), {"firm": ("string", ("gradingCompany",)), "before": ("string", ("previousGrade",)), "after": ("string", ("newGrade",)), "action": ("string", ("action",))}),
    "indicator": (("date",), {"value": ("double", ("value", "sma", "ema", "wma", "dema", "tema", "rsi", "standardDeviation", "williams", "adx"))}),
}


def terminal(raw: DataFrame, kind: str) -> DataFrame:
    """Records of one terminal kind (payload): typed columns by alias; fields that do not parse are null."""
    times, columns = TERMINAL[kind]
    p = F.col("payload")
    at = timestamp(field(p, *times))
    return raw.select(
        symbol(field(p, "symbol")).alias("symbol"), F.lit(kind).alias("kind"), at.alias("observation_time"),
        *[field(p, *aliases).try_cast(to).alias(name) for name, (to, aliases) in columns.items()], F.when(at.isNull(), "no_time").alias("rejected"))


def resolved(rows: DataFrame, identities: DataFrame, at: str = "observation_time") -> DataFrame:
    """Rows with the entity that had their symbol then; without one they are rejected."""
    i = identities.select("symbol", "entity_id", F.col("valid_from").alias("_a"), F.col("valid_to").alias("_b"))
    out = interval_join(rows, i, ["symbol"], at, "_a", "_b", how="left").drop("_a", "_b")
    return out.withColumn("rejected", F.coalesce(F.col("rejected"), F.when(F.col("entity_id").isNull(), "unresolved_identity")))
