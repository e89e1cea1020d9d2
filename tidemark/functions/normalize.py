"""Normalisation of provider records: times, codes, names, payload fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_close(day: Column) -> Column:
    """16:00 in New York on that day, in UTC."""
    return F.to_utc_timestamp(F.date_trunc("day", day.cast("timestamp")) + F.expr("INTERVAL 16 HOURS"), "America/New_York")


def availability(observed: Column, lag: str) -> Column:
    return F.greatest(observed, observed + F.expr(f"INTERVAL {lag}"))


def field(payload: Column, *aliases: str) -> Column:
    """The first alias that a JSON payload has."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{a}") for a in aliases])


def split_ratio(payload: Column) -> Column:
    """numerator / denominator, or ratio; null unless positive."""
    r = F.coalesce(field(payload, "numerator").try_cast("double") / F.nullif(field(payload, "denominator").try_cast("double"), F.lit(0.0)), field(payload, "ratio", "splitRatio").try_cast("double"))
    return F.when(r > 0, r)


#: Words for transaction codes.
CODE_WORDS = {
    "PURCHASE": "P", "BUY": "P", "BOUGHT": "P", "SALE": "S", "SELL": "S", "SOLD": "S", "AWARD": "A", "GRANT": "A", "EXEMPT": "M", "EXERCISE": "M", "GIFT": "G",
}


def transaction_code(text: Column) -> Column:
    """`P-Purchase`, `Purchase-P`, `purchase` and `p` alike as P; null for what is not known."""
    t = F.upper(F.trim(text))
    words = F.create_map(*[F.lit(x) for kv in CODE_WORDS.items() for x in kv])
    head, tail = F.substring_index(t, "-", 1), F.regexp_extract(t, "^[^-]*-(.*)$", 1)
    letter = "^[A-Z]$"
    return F.when(head.rlike(letter), head).when(tail.rlike(letter), tail).otherwise(F.try_element_at(words, t))


def item_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}\.\d{2})\b"), F.lit(1)))


def timestamp(text: Column) -> Column:
    """Tolerant: full timestamps, ISO with T, and dates, which mean the end of their day."""
    t = F.trim(text)
    day = F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")), day + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))


#: Label patterns in order; the first that the lower-case label contains wins.
EXCHANGES = [
    ("nasdaq global select", "NASDAQ"), ("nasdaq global market", "NASDAQ"), ("nasdaq capital market", "NASDAQ"), ("nasdaq", "NASDAQ"), ("ndq", "NASDAQ"),
    ("nyse arca", "NYSE_ARCA"), ("arca", "NYSE_ARCA"), ("nyse american", "NYSE_AMERICAN"), ("amex", "NYSE_AMERICAN"), ("american stock exchange", "NYSE_AMERICAN"),
    ("new york stock exchange", "NYSE"), ("nyse", "NYSE"), ("otc", "OTC"), ("pink", "OTC"),
]


def exchange(name: Column, short_name: Column | None = None) -> Column:
    """The venue of a label, else of the short one, else UNKNOWN."""

    def match(label: Column) -> Column:
        n = F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))
        out = F
        for pattern, code in EXCHANGES:
            out = out.when(n.contains(pattern), code)
        return out

    found = match(name) if short_name is None else F.coalesce(match(name), match(short_name))
    return F.coalesce(found, F.lit("UNKNOWN"))


def symbol(text: Column) -> Column:
    return F.upper(F.trim(text))


def suffix(text: Column) -> Column:
    return F.when(F.instr(text, ".") > 0, F.substring_index(symbol(text), ".", -1))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as canonical JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
