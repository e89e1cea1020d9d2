"""Recorded envelopes of every kind, and appends that a replayed batch does not repeat."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import envelopes, sinks

RECORDS = {
    "stock_list": {"symbol": "abc", "name": "Abc", "exchangeShortName": "NYSE", "type": "stock"}, "screener": {"symbol": "abc", "companyName": "Abc"},
    "delisted": {"symbol": "abc", "companyName": "Abc", "ipoDate": "2001-02-03", "delistedDate": "2005-06-07"},
    "history": {"symbol": "abc", "date": "2024-01-02", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 10},
    "income": {"symbol": "abc", "date": "2023-12-31", "period": "FY", "acceptedDate": "2024-02-01 08:00:00", "revenue": 5}, "balance_sheet": {"symbol": "abc", "date": "2023-12-31", "period": "FY", "filingDate": "2024-02-01"},
    "cash_flow": {"symbol": "abc", "date": "2023-12-31", "period": "Q4", "filingDate": "2024-02-01"}, "profile": {"symbol": "abc", "sector": "X"}, "key_metrics": {"symbol": "abc", "date": "2023-12-31"},
    "ratios": {"symbol": "abc", "date": "2023-12-31"}, "scores": {"symbol": "abc", "altmanZScore": 3}, "splits": {"symbol": "abc", "date": "2024-03-01", "numerator": 2, "denominator": 1},
    "dividends": {"symbol": "abc", "date": "2024-03-01", "dividend": 0.5}, "mergers": {"symbol": "abc", "targetedSymbol": "XYZ", "transactionDate": "2024-01-05", "acceptedDate": "2024-01-06 10:00:00"},
    "earnings": {"symbol": "abc", "date": "2024-04-25"}, "news": {"symbol": "abc", "publishedDate": "2024-01-02 03:04:05", "title": "T", "site": "s", "url": "u", "text": "x"},
    "ownership": {"symbol": "abc", "year": 2023, "quarter": 4, "investorsHolding": 7}, "insider": {"symbol": "abc", "filingDate": "2024-01-03", "transactionDate": "2024-01-02", "transactionType": "P-Purchase", "securitiesTransacted": 5},
    "filings": {"symbol": "abc", "acceptedDate": "2024-01-03 10:00:00", "formType": "8-K", "items": "Item 2.02, Item 9.01"}, "estimate": {"symbol": "abc", "date": "2024-12-31", "revenueAvg": 1},
    "compensation": {"symbol": "abc", "acceptedDate": "2024-03-01 00:00:00", "nameAndPosition": "N", "year": 2023, "salary": 1}, "transcript": {"symbol": "abc", "date": "2024-01-30", "year": 2023, "period": "Q4", "content": "c"},
    "price_target": {"symbol": "abc", "lastUpdated": "2024-01-01", "targetHigh": 3}, "peers": {"symbol": "abc", "date": "2024-01-01", "peersList": "B,C"}, "fund_holding": {"symbol": "abc", "date": "2024-01-01", "holder": "H", "shares": 3},
    "grade": {"symbol": "abc", "date": "2024-01-01", "gradingCompany": "G", "previousGrade": "a", "newGrade": "b", "action": "up"}, "indicator": {"symbol": "abc", "date": "2024-01-01", "sma": 3.5},
}


def test_every_kind_has_a_sample():
    assert set(RECORDS) == set(envelopes.KINDS)


@pytest.mark.parametrize("kind", sorted(RECORDS))
def test_kind(spark, tmp_path, kind):
    record = RECORDS[kind]
    (tmp_path / "a.json").write_text(json.dumps([record, record], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"symbol": "abc", "data": [{k: v for k, v in record.items() if k != "symbol"}]}))
    (tmp_path / "c.json").write_text(json.dumps(record))
    (tmp_path / "d.json").write_text('{"Error Message": "limit reached"}')
    (tmp_path / "e.json").write_text("<html>gone</html>")
    (tmp_path / "f.json").write_text("[]")
    out = envelopes.load(spark, str(tmp_path), kind).collect()
    # the translators of ownership, insider, filing and terminal records read the symbol from the record itself
    assert len(out) == 4 and all(r.rejected is None for r in out) and sum(r.symbol == "ABC" for r in out) >= 3


def test_a_resumed_stream_reads_each_file_once(spark, tmp_path):
    source, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    (tmp_path / "in").mkdir()

    def run():
        stream = envelopes.load_stream(spark, source, "grade", files_per_trigger=1)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps([RECORDS["grade"]] * 2))
    assert run() == 4 and run() == 4
    (tmp_path / "in" / "0a.json").write_text(json.dumps(RECORDS["grade"]))
    assert run() == 5


def test_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("a", 1), ("b", 1), (None, 1), ("a", 2)], "k string, v int")
    second = spark.createDataFrame([("b", 5), ("c", 5), (None, 5)], "k string, v int")
    sinks.append_batch(first, 0, path, ["k"], order=["v"])
    for _ in range(2):  # the second comes twice
        sinks.append_batch(second, 1, path, ["k"], order=["v"])
    sinks.append_batch(first, 0, path, ["k"], order=["v"])
    rows = [(r.k, r.v) for r in spark.read.parquet(path).collect()]
    assert sorted(rows, key=str) == [("a", 1), ("b", 1), ("c", 5), (None, 1)]


def test_restarted_stream_writes_no_row_twice(spark, tmp_path):
    source, path, at = (str(tmp_path / n) for n in ("in", "table", "at"))
    schema = "k int, v int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda checkpoint: sinks.write_stream(spark.readStream.schema(schema).parquet(source), path, ["k"], checkpoint, order=["v"]).awaitTermination()
    write([(1, 1), (2, 1), (2, 3)])
    run(at)
    write([(2, 9), (3, 9)])
    run(at)
    run(at)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()) == [(1, 1), (2, 1), (3, 9)]


def test_append_reads_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.append_batch(spark.range(200).withColumn("v", F.lit(1)), 0, path, ["id"])
    new = spark.createDataFrame([(7, 2), (900, 2)], "id bigint, v int")
    sinks.append_batch(new, 1, path, ["id"])
    touched = {r[0] for r in new.select(F.pmod(F.xxhash64("id"), F.lit(sinks.BUCKETS))).collect()}
    assert {r.key_bucket for r in spark.read.parquet(path).where("batch_id = 1").collect()} <= touched
    assert spark.read.parquet(path).where("id = 7").count() == 1 and spark.read.parquet(path).count() == 201
