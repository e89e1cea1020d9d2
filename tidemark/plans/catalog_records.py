"""Queries over records: membership, translation, identities, states, sinks, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize, translate
from ..operators import identity, membership, panel, quality, reads, states
from ..sources import sinks
from .catalog import BARS, bars, query, r, t

_LABELS = ["NASDAQ Global Select", "New York Stock Exchange", "NYSE  ARCA", "NYSE American", "OTC Pink", "Elsewhere", "ndq"]

_LISTINGS = f"""
listings AS (
  SELECT s_suppkey AS entity_id, concat('S', s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '.TO' WHEN s_suppkey % 11 = 0 THEN '.B' ELSE '' END) AS symbol,
         ({_LABELS})[1 + s_suppkey % 7] AS label FROM supplier
), venues AS (
  SELECT *, CASE WHEN label IN ('NASDAQ Global Select', 'ndq') THEN 'NASDAQ' WHEN label = 'New York Stock Exchange' THEN 'NYSE' WHEN label = 'NYSE  ARCA' THEN 'NYSE_ARCA'
    WHEN label = 'NYSE American' THEN 'NYSE_AMERICAN' WHEN label = 'OTC Pink' THEN 'OTC' ELSE 'UNKNOWN' END AS exchange FROM listings
), reasons AS (
  SELECT *, CASE WHEN exchange = 'UNKNOWN' THEN 'unknown_exchange' WHEN exchange NOT IN ('NYSE', 'NASDAQ') THEN 'non_universe_exchange' WHEN symbol LIKE '%.TO' THEN 'foreign_symbol_suffix' END AS reason
  FROM venues
)"""


def listings(spark, sf):
    k = F.col("s_suppkey")
    tail = F.when(k % 7 == 0, ".TO").when(k % 11 == 0, ".B").otherwise("")
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (k % 7 + 1).cast("int"))
    return t(spark, sf, "supplier").select(k.alias("entity_id"), F.concat(F.lit("S"), k.cast("string"), tail).alias("symbol"), label.alias("label"), normalize.exchange(label).alias("exchange"))


@query(f"WITH {_LISTINGS} SELECT entity_id, symbol, exchange, reason FROM reasons")
def u1_admission(spark, sf):
    d = listings(spark, sf)
    return d.select("entity_id", "symbol", "exchange", membership.exclusion_reason(F.col("exchange"), F.col("symbol")).alias("reason"))


@query(f"""WITH {_LISTINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY exchange, reason ORDER BY symbol) AS i FROM reasons)
SELECT exchange, reason, count(*) AS n, array_to_string(list(symbol ORDER BY symbol) FILTER (i <= 25), ',') AS samples FROM n GROUP BY 1, 2""")
def u2_admission_report(spark, sf):
    return membership.admission_report(listings(spark, sf)).withColumn("samples", F.array_join("samples", ","))


_INTERVALS = f"""{_LISTINGS}, bounds AS (SELECT l_suppkey AS entity_id, min(l_shipdate)::DATE AS first_bar, max(l_shipdate)::DATE AS last_bar FROM lineitem GROUP BY 1),
gone AS (SELECT entity_id, symbol, exchange, CASE WHEN entity_id % 8 <> 0 THEN DATE '1990-01-01' + entity_id::INT END AS ipo, CASE WHEN entity_id % 20 <> 0 THEN DATE '1999-01-01' + entity_id::INT END AS out FROM venues WHERE entity_id % 4 = 0),
back AS (SELECT entity_id, max(out) AS back FROM gone GROUP BY 1),
i AS (
  SELECT entity_id, symbol, exchange, coalesce(ipo, first_bar, out, DATE '2002-01-01')::TIMESTAMP AS a, coalesce(out, last_bar, DATE '2002-01-01')::TIMESTAMP AS listed_to, 'DELISTED' AS listing_status,
    CASE WHEN ipo IS NOT NULL THEN 'delisted_feed' WHEN first_bar IS NOT NULL THEN 'price_history' ELSE 'missing' END AS from_evidence,
    CASE WHEN out IS NOT NULL THEN 'delisted_feed' WHEN last_bar IS NOT NULL THEN 'price_history' ELSE 'missing' END AS to_evidence
  FROM gone LEFT JOIN bounds USING (entity_id)
  UNION ALL
  SELECT entity_id, symbol, exchange, greatest(coalesce(first_bar, DATE '2002-01-01'), coalesce(back, DATE '0001-01-01'))::TIMESTAMP, NULL, 'LISTED',
    CASE WHEN coalesce(first_bar, DATE '2002-01-01') < back THEN 'missing' WHEN first_bar IS NOT NULL THEN 'price_history' ELSE 'first_observed' END, 'missing'
  FROM venues LEFT JOIN bounds USING (entity_id) LEFT JOIN back USING (entity_id) WHERE entity_id % 3 <> 0
), intervals AS (SELECT entity_id, symbol, exchange, CASE WHEN listed_to <= a THEN listed_to - INTERVAL 1 DAY ELSE a END AS listed_from, listed_to, listing_status, from_evidence, to_evidence FROM i)"""


def intervals(spark, sf):
    d, k = listings(spark, sf), F.col("entity_id")
    gone = d.where(k % 4 == 0).select(
        "entity_id", "symbol", "exchange", F.when(k % 8 != 0, F.date_add(F.lit("1990-01-01").cast("date"), k.cast("int"))).alias("ipo_date"),
        F.when(k % 20 != 0, F.date_add(F.lit("1999-01-01").cast("date"), k.cast("int"))).alias("delisted_date"))
    b = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.col("l_shipdate").alias("event_time"))
    return membership.listing_intervals(membership.observations(d.where(k % 3 != 0), gone), membership.bar_date_bounds(b), F.lit("2002-01-01"))


@query(f"WITH {_INTERVALS} SELECT entity_id, symbol, listed_from::DATE AS listed_from, listed_to::DATE AS listed_to, listing_status, from_evidence, to_evidence FROM intervals")
def u4_listing_intervals(spark, sf):
    return intervals(spark, sf).withColumns({"listed_from": F.to_date("listed_from"), "listed_to": F.to_date("listed_to")}).drop("exchange")


@query(f"""WITH {_INTERVALS} SELECT entity_id, symbol, listing_status FROM intervals WHERE listed_from <= TIMESTAMP '1999-03-01' AND (listed_to IS NULL OR listed_to > TIMESTAMP '1999-03-01')
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY listed_from DESC, symbol, listing_status) = 1""")
def u5_covering(spark, sf):
    return membership.covering(intervals(spark, sf), F.lit("1999-03-01").cast("timestamp")).select("entity_id", "symbol", "listing_status")


_PART = "sum(('0x' || substr(h, {0}, 8))::BIGINT)::BIGINT"


@query(f"""WITH {_LISTINGS}, m AS (SELECT md5(concat_ws('|', entity_id::VARCHAR, symbol, exchange, coalesce(reason, '\\N'))) AS h FROM reasons)
SELECT count(*) AS members, sha256(concat_ws(',', count(*), {', '.join(_PART.format(1 + 8 * i) for i in range(4))})) AS checksum FROM m""")
def u6_checksum(spark, sf):
    return membership.checksum(u1_admission(spark, sf), ["entity_id", "symbol", "exchange", "reason"])


_ACTIONS = """
actions AS (SELECT s_suppkey % 5 AS entity_id, DATE '1995-02-01' + (s_suppkey * 13 % 2000)::INT AS d, s_suppkey % 2 = 0 AS split, 1 + (s_suppkey % 4) / 50.0 AS ratio, (s_suppkey % 6) * 2.0 AS amount FROM supplier),
prior AS (SELECT a.*, b.close AS p FROM actions a ASOF LEFT JOIN bars b ON a.entity_id = b.entity_id AND a.d::TIMESTAMP > b.event_time),
factors AS (SELECT entity_id, d, CASE WHEN split THEN -ln(ratio) WHEN amount > 0 AND p > 0 AND amount < p THEN ln((p - amount) / p) ELSE 0 END AS f, CASE WHEN split THEN ln(ratio) ELSE 0 END AS g FROM prior)"""


@query(f"""WITH {BARS}, {_ACTIONS}, s AS (
  SELECT b.entity_id, b.event_time, coalesce(sum(f), 0) AS f, coalesce(sum(g), 0) AS g FROM bars b LEFT JOIN factors x ON x.entity_id = b.entity_id AND x.d > b.event_time::DATE GROUP BY 1, 2
) SELECT b.entity_id, b.event_time, round((close * exp(f))::DECIMAL(30, 10), 6)::DOUBLE AS close_adjusted, round((volume * exp(g))::DECIMAL(30, 10), 6)::DOUBLE AS volume_adjusted FROM bars b JOIN s USING (entity_id, event_time)""")
def n13_adjust_all(spark, sf):
    k = F.col("s_suppkey")
    a = t(spark, sf, "supplier").select(
        (k % 5).cast("int").alias("entity_id"), F.date_add(F.lit("1995-02-01").cast("date"), (k * 13 % 2000).cast("int")).alias("effective_date"),
        F.when(k % 2 == 0, "SPLIT").otherwise("DIVIDEND").alias("action_type"), (1 + (k % 4) / 50.0).alias("ratio"), ((k % 6) * 2.0).alias("amount"))
    out = panel.adjust_all(bars(spark, sf), a)
    return out.select("entity_id", "event_time", "close_adjusted", "volume_adjusted")


_CODES = ["P-Purchase", "Sale-S", " bought", "GRANT", "Exempt", "x", "unclear", "M-"]


@query(f"""SELECT o_orderkey, (['P', 'S', 'P', 'A', 'M', 'X', NULL, 'M'])[1 + o_orderkey % 8] AS code FROM orders""")
def n6_transaction_codes(spark, sf):
    text = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t(spark, sf, "orders").select("o_orderkey", normalize.transaction_code(text).alias("code"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 25 THEN l_quantity::BIGINT ELSE 0 END AS volume_raw, round(l_extendedprice, 2) AS close_raw,
CASE WHEN l_discount < 0.05 THEN NULL ELSE 'missing_price' END AS rejected FROM lineitem""")
def n2_translate_bars(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(20,6)")
    raw = t(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_discount") < 0.05, price).alias("open"),
        price.alias("high"), price.alias("low"), price.alias("close"), F.when(F.col("l_quantity") <= 25, F.col("l_quantity")).alias("volume"))
    out = translate.bars(raw)
    at = F.split("symbol", "-")
    return out.select(at[0].cast("bigint").alias("l_orderkey"), at[1].cast("int").alias("l_linenumber"), "volume_raw", F.round(F.col("close_raw").cast("double"), 2).alias("close_raw"), "rejected")



@query("""SELECT o_orderkey, o_orderdate::DATE AS fiscal_period_end, CASE o_orderkey % 4 WHEN 0 THEN 36000 WHEN 3 THEN NULL ELSE 86399 END AS second_of_day,
CASE WHEN o_orderkey % 4 = 3 THEN 'no_observation_time' END AS rejected FROM orders""")
def n3_translate_fundamentals(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    payload = F.when(k % 4 == 0, F.format_string('{"acceptedDate":"%s 10:00:00","filingDate":"%s"}', day, day)).when(
        k % 4 == 3, F.lit("{}")).otherwise(F.format_string('{"filingDate":"%s"}', day))
    raw = t(spark, sf, "orders").select(k.cast("string").alias("symbol"), day.alias("date"), F.lit("FY").alias("period"), payload.alias("payload"))
    out = translate.fundamentals(raw, "income")
    at = F.col("observation_time")
    return out.select(F.col("symbol").cast("bigint").alias("o_orderkey"), "fiscal_period_end", (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).alias("second_of_day"), "rejected")


_CHANGES = """changes AS (SELECT user_id AS entity_id, event_type AS symbol, ts AS t, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS p FROM events),
tickers AS (SELECT entity_id, symbol, t AS valid_from, lead(t) OVER (PARTITION BY entity_id ORDER BY t, symbol) AS valid_to FROM changes WHERE p IS NULL OR p <> symbol)"""


def tickers(spark, sf):
    return identity.ticker_intervals(t(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("symbol"), F.col("ts").alias("at")))


@query(f"WITH {_CHANGES} SELECT * FROM tickers")
def a14_ticker_intervals(spark, sf):
    return tickers(spark, sf)


@query(f"""WITH {_CHANGES}, s AS (SELECT DISTINCT event_type AS symbol FROM events),
b AS (SELECT symbol, entity_id FROM tickers QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY (valid_to IS NULL) DESC, valid_from DESC, entity_id) = 1)
SELECT s.symbol, b.entity_id FROM s LEFT JOIN b USING (symbol)""")
def a13_resolve(spark, sf):
    return identity.resolve(tickers(spark, sf), t(spark, sf, "events").select(F.col("event_type").alias("symbol")))


@query("""SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_id % 10 = 0)""")
def a19_standing(spark, sf):
    e = t(spark, sf, "events").withColumn("supersedes", F.when(F.col("event_id") % 10 == 0, F.col("event_id") - 1))
    return identity.standing(e, "event_id", "supersedes").select("event_id", "user_id")


@query("""SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1""")
def a15_latest_per_period(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("observed", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    return reads.per_period(li, "l_partkey", "l_suppkey", "observed").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def k5_projection(spark, sf):
    return sinks.projection(t(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT p_partkey, gate, passed FROM (SELECT p_partkey, p_size > 20 AS size_gate, p_retailprice > 1000 AS price_gate FROM part) UNPIVOT (passed FOR gate IN (size_gate, price_gate))""")
def k7_gate_rows(spark, sf):
    wide = t(spark, sf, "part").select("p_partkey", (F.col("p_size") > 20).alias("size_gate"), (F.col("p_retailprice") > 1000).alias("price_gate"))
    return sinks.gate_rows(wide, ["size_gate", "price_gate"], ["p_partkey"])


@query("""WITH top AS (SELECT user_id, count(*) - 1 AS top FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT e.user_id, event_id, (coalesce(top, -1) + row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id))::INT AS sequence_number FROM events e LEFT JOIN top USING (user_id) WHERE ts >= TIMESTAMP '2024-01-15'""")
def k10_sequenced(spark, sf):
    e, cut = t(spark, sf, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    old = e.where(F.col("ts") < cut)
    stored = sinks.sequenced(old, old.select("user_id", F.lit(-1).alias("sequence_number")).where("false"), "user_id", ["ts", "event_id"])
    return sinks.sequenced(e.where(F.col("ts") >= cut), stored, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "sequence_number")


_LOG = """s AS (SELECT user_id, ts, event_id, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events), log AS (SELECT user_id AS entity_id, f, s, ts AS t FROM s WHERE f IS NULL OR f <> s),
kinds AS (SELECT list(event_type ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events))"""


def kinds(spark, sf):
    """The event types, a handful, as a cycle."""
    return [x[0] for x in t(spark, sf, "events").select("event_type").distinct().orderBy("event_type").collect()]


def log(spark, sf):
    return states.transitions(t(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], "ts").withColumnRenamed("user_id", "entity_id")


@query(f"""WITH {_LOG} SELECT entity_id, count(*) AS transitions, count(*) FILTER (s = k[1]) AS cycles, count(*) FILTER (list_position(k, s) < list_position(k, f)) AS backward, max(t) AS last_at FROM log, kinds GROUP BY 1""")
def c13_history_counts(spark, sf):
    return states.history_counts(log(spark, sf), cycle=kinds(spark, sf))


@query(f"""WITH {_LOG} SELECT entity_id, t AS "at", s AS to_state FROM log WHERE t >= TIMESTAMP '2024-01-10 21:00:00' AND t < TIMESTAMP '2024-01-11 21:00:00'""")
def c17_in_session(spark, sf):
    return states.in_session(log(spark, sf), F.lit("2024-01-10 21:00:00").cast("timestamp_ntz")).select("entity_id", "at", "to_state")


@query("""SELECT n_nationkey AS message, r_regionkey AS receiver FROM nation, region WHERE (n_nationkey, r_regionkey) NOT IN (SELECT n_nationkey, n_regionkey FROM nation)""")
def c18_outstanding(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("message"), F.col("n_regionkey").alias("receiver"))
    return states.outstanding(n, t(spark, sf, "region").select(F.col("r_regionkey").alias("receiver")), n, "message", "receiver")


_RESULTS = "results AS (SELECT DISTINCT user_id AS entity_id, ts::DATE AS run_at, event_type AS gate, value > 30 AS passed FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY ts DESC, event_id DESC) = 1)"


def results(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("run_at"), F.col("event_type").alias("gate"), (F.col("value") > 30).alias("passed"), F.struct("ts", "event_id").alias("o"))
    return e.groupBy("entity_id", "run_at", "gate").agg(F.max_by("passed", "o").alias("passed"))


@query(f"""WITH {_RESULTS}, runs AS (SELECT entity_id, run_at, coalesce(list_sort(list(gate) FILTER (NOT passed)), []) AS failed FROM results GROUP BY 1, 2),
p AS (SELECT *, lag(failed) OVER (PARTITION BY entity_id ORDER BY run_at) AS b FROM runs)
SELECT entity_id, run_at, array_to_string(failed, ',') AS failed, array_to_string(list_sort(list_filter(failed, lambda x: b IS NULL OR NOT list_contains(b, x))), ',') AS newly_failed FROM p""")
def c20_newly_failed(spark, sf):
    out = states.newly_failed(results(spark, sf))
    return out.select("entity_id", "run_at", F.array_join("failed", ",").alias("failed"), F.array_join(F.array_sort("newly_failed"), ",").alias("newly_failed"))


@query(f"""WITH {_RESULTS}, runs AS (SELECT entity_id, run_at, bool_and(passed) AS ok FROM results GROUP BY 1, 2)
SELECT entity_id, CASE WHEN arg_max(ok, run_at) THEN 'PASSING' WHEN bool_or(ok) THEN 'LOST' ELSE 'NEVER_ELIGIBLE' END AS trend FROM runs GROUP BY 1""")
def c20_eligibility_trend(spark, sf):
    return states.eligibility_trend(results(spark, sf))


@query("""SELECT json_extract_string(props, '$.k') AS value, count(*) AS n, count(DISTINCT user_id) AS keys, min(ts) AS first, max(ts) AS last FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20""")
def q8_state_gaps(spark, sf):
    return quality.state_gaps(t(spark, sf, "events"), "props", "k", "user_id", "ts")


@query("""SELECT o_orderpriority, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last,
round(count(*) / greatest(1.0, (epoch(max(o_orderdate)) - epoch(min(o_orderdate))) / 86400), 6) AS rows_per_day FROM orders GROUP BY 1""")
def q11_growth(spark, sf):
    return quality.growth(t(spark, sf, "orders"), "o_orderdate", ["o_orderpriority"]).withColumn("rows_per_day", F.round("rows_per_day", 6))


@query("""SELECT o_orderkey AS run_id, round((epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) / 3600, 4) AS hours FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '2002-01-01' - INTERVAL 6 HOUR""")
def q9_stuck_runs(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("ended_at"))
    return quality.stuck(o, "2002-01-01").select("run_id", r("hours").alias("hours"))


@query("""WITH v AS (SELECT l_partkey, l_suppkey, l_quantity, l_shipdate, l_orderkey, l_linenumber, first_value(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_quantity) AS f FROM lineitem)
SELECT l_partkey, l_suppkey, count(*) AS n FROM v WHERE l_quantity = f GROUP BY 1, 2 HAVING count(*) > 1""")
def q3_identical_restatements(spark, sf):
    return quality.identical_restatements(t(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], ["l_quantity"], "l_shipdate")


@query("""SELECT p_partkey, p_name FROM (SELECT *, CASE WHEN upper(p_brand) LIKE 'BRAND#1%' THEN 0 ELSE 1 END AS k FROM part WHERE upper(p_brand) LIKE 'BRAND#1%' OR lower(p_name) LIKE '%brand#1%') ORDER BY k, p_brand, p_partkey LIMIT 30""")
def r15_search(spark, sf):
    p = t(spark, sf, "part").withColumn("symbol", F.concat_ws(" ", "p_brand", F.format_string("%012d", "p_partkey")))
    return reads.search(p, " brand#1", name="p_name").select("p_partkey", "p_name")


@query("""SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 100""")
def r14_signals(spark, sf):
    return reads.signals_of(t(spark, sf, "events"), score="value", tie="event_id").select("event_id", "value")


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS items FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def g3_ordered_items(spark, sf):
    o = t(spark, sf, "orders").withColumn("items", F.array("o_orderpriority"))
    return reads.ordered_items(o, "o_custkey", "items", F.col("o_orderstatus") == "F").withColumn("items", F.array_join("items", ","))


@query("""SELECT c_custkey AS entity_id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS items, count(o_orderkey) > 0 AS filed
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate::DATE = DATE '1998-03-03' GROUP BY 1""")
def g30_filed_on(spark, sf):
    f = t(spark, sf, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("observation_time"), F.array("o_orderpriority").alias("items"))
    m = t(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    return reads.filed_on(f, m, "1998-03-03").withColumn("items", F.array_join("items", ","))


@query("""WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1)
SELECT user_id, count(*) FILTER (event_type <> 'purchase' AND (last IS NULL OR ts > last)) AS failures FROM events JOIN l USING (user_id) WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1""")
def g31_failures_since_success(spark, sf):
    e = t(spark, sf, "events").withColumn("ok", F.col("event_type") == "purchase")
    return reads.failures_since_success(e, "user_id", "ts", "ok", F.lit("2024-01-05").cast("timestamp_ntz"))


@query("""SELECT l_linestatus, round(quantile_cont(epoch(l_shipdate) - epoch(o_orderdate), 0.5), 2) AS median_s, max(epoch(l_shipdate) - epoch(o_orderdate))::BIGINT AS max_s, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def q6_lag(spark, sf):
    j = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality.lag_summary(j, "o_orderdate", "l_shipdate", ["l_linestatus"]).withColumn("median_s", F.round(F.col("median_s").cast("double"), 2))


@query("""SELECT k AS o_custkey, arg_min(src, (src, o_orderkey)) AS first_source FROM (SELECT o_custkey AS k, 0 AS src, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""")
def g25_first_source(spark, sf):
    from ..operators import evaluation

    o = t(spark, sf, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select("o_custkey", F.lit(i).alias("first_source")).distinct() for i, s in enumerate("FO"))
    return evaluation.first_source(a, b, key="o_custkey")


@query(f"""WITH {_CHANGES} SELECT e.event_id, k.symbol FROM events e LEFT JOIN tickers k ON k.entity_id = e.user_id AND k.valid_from <= e.ts - INTERVAL 6 HOUR AND (k.valid_to IS NULL OR k.valid_to > e.ts - INTERVAL 6 HOUR)""")
def a12_labels(spark, sf):
    from ..operators import asof

    e = t(spark, sf, "events").select("event_id", F.col("user_id").alias("entity_id"), (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("before"))
    return asof.label_as_of(e, tickers(spark, sf), "entity_id", "before").select("event_id", "symbol")


@query("""SELECT CASE WHEN count(*) = 0 THEN 'never_ingested' WHEN count(*) FILTER (o_orderdate <= TIMESTAMP '1990-01-01') = 0 THEN 'not_yet_available' ELSE 'available' END AS reason, count(*) AS n,
count(*) FILTER (o_orderdate <= TIMESTAMP '1990-01-01') AS n_known FROM orders""")
def a17_why_empty(spark, sf):
    from ..operators import asof

    return asof.why_empty(t(spark, sf, "orders"), F.lit("1990-01-01").cast("timestamp_ntz"), availability="o_orderdate")


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def a18_earliest_knowledge(spark, sf):
    from ..operators import asof

    e = t(spark, sf, "events")
    return asof.earliest_knowledge(e, ["user_id", "event_type"], F.lit("2024-01-20").cast("timestamp_ntz"), availability="ts").select("user_id", "event_type", "event_id")


@query("""WITH i AS (SELECT o_custkey AS k, o_orderdate AS a, o_orderdate + INTERVAL 90 DAY AS b, o_orderkey FROM orders),
r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i) SELECT k, a AS valid_from, b AS valid_to FROM r WHERE a < reach""")
def a9_overlaps(spark, sf):
    from ..operators import asof

    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("valid_to"))
    return asof.overlaps(o, "k").select("k", "valid_from", "valid_to")


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, make_date(year(o_orderdate), 4, 1) AS a, make_date(year(o_orderdate), 10, 31) AS o FROM orders)
SELECT o_orderkey, CASE WHEN d >= a + ((7 - dayofweek(a)) % 7)::INT AND d < o - dayofweek(o)::INT THEN 20 ELSE 21 END AS utc_hour FROM d""")  # the summer time of 1987 to 2006
def n1_session_close(spark, sf):
    at = normalize.session_close(F.to_date("o_orderdate"))
    return t(spark, sf, "orders").select("o_orderkey", F.hour(at).alias("utc_hour"))


_GATE_ROWS = """g AS (SELECT p_partkey AS entity_id, p_retailprice * 50 AS adv, p_partkey % 9 AS analogues, p_partkey % 4 AS distress, (['LISTED', 'SUSPENDED', 'DELISTED'])[1 + p_partkey % 3] AS st, p_size / 40.0 AS history,
CASE WHEN p_partkey % 5 <> 0 THEN 1.0 END AS drawdown_pct, CASE WHEN p_partkey % 7 <> 0 THEN 1.0 END AS atr FROM part),
r AS (SELECT entity_id, unnest(['DATA_HISTORY', 'DATA_QUALITY', 'LIQUIDITY', 'BANKRUPTCY', 'MIN_ANALOGUES', 'VALID_IDENTITY']) AS gate,
  unnest([history >= 1, drawdown_pct IS NOT NULL AND atr IS NOT NULL, adv >= 50000, distress < 2, analogues >= 5, st IN ('LISTED', 'SUSPENDED')]) AS passed FROM g)"""


def gate_results(spark, sf):
    from ..operators import rank

    k = F.col("p_partkey")
    rows = t(spark, sf, "part").select(
        k.alias("entity_id"), (F.col("p_retailprice") * 50).alias("avg_dollar_volume"), (k % 9).alias("analogues"), (k % 4).alias("distress"), F.lit(True).alias("evidence_known"),
        F.element_at(F.array(*map(F.lit, ["LISTED", "SUSPENDED", "DELISTED"])), (k % 3 + 1).cast("int")).alias("listing_status"), (F.col("p_size") / 40.0).alias("history_coverage"),
        F.when(k % 5 != 0, 1.0).alias("drawdown_pct"), F.when(k % 7 != 0, 1.0).alias("atr"), F.lit(1.0).alias("realized_volatility"), F.lit(1.0).alias("rvol"))
    return rank.gates(rows, features=["drawdown_pct", "atr", "realized_volatility", "rvol", "avg_dollar_volume"])


@query(f"WITH {_GATE_ROWS} SELECT * FROM r")
def r5_gates(spark, sf):
    return gate_results(spark, sf)


@query(f"WITH {_GATE_ROWS} SELECT gate, count(*) AS failures FROM r WHERE NOT passed GROUP BY 1")
def r11_gate_failures(spark, sf):
    from ..operators import rank

    return rank.gate_failures(gate_results(spark, sf))


@query("""WITH f AS (SELECT p_partkey AS entity_id, (p_partkey % 11) - 3 AS equity, (p_partkey % 7) - 3 AS ocf, p_partkey % 13 AS cash, p_partkey % 10 AS debt, 10 AS assets, p_size AS shares, p_partkey % 17 AS ago FROM part)
SELECT entity_id, (equity < 0)::INT + coalesce((ocf < 0 AND cash / abs(ocf) < 4)::INT, 0) + (debt / assets > 0.9)::INT + coalesce((shares / nullif(ago, 0) - 1 > 1)::INT, 0) AS distress FROM f""")
def r8_distress(spark, sf):
    from ..operators import rank

    k = F.col("p_partkey").cast("double")
    f = t(spark, sf, "part").select(
        F.col("p_partkey").alias("entity_id"), (k % 11 - 3).alias("equity"), (k % 7 - 3).alias("operating_cash_flow"), (k % 13).alias("cash"), (k % 10).alias("total_debt"), F.lit(10.0).alias("total_assets"),
        F.col("p_size").cast("double").alias("shares"), (k % 17).alias("shares_year_ago"))
    return rank.distress_signals(f).select("entity_id", "distress")


@query("""WITH m AS (SELECT c_custkey AS entity_id, (['hot', 'warm', 'cold'])[1 + c_custkey % 3] AS tier FROM customer), l AS (SELECT o_custkey AS entity_id, max(o_orderdate)::DATE AS refreshed_on, (['hot', 'warm', 'cold'])[1 + max(o_orderkey) % 3] AS last_tier FROM orders GROUP BY 1),
d AS (SELECT m.entity_id, tier, last_tier, refreshed_on, CASE tier WHEN 'hot' THEN 1 WHEN 'warm' THEN 30 ELSE 300 END AS i, CASE last_tier WHEN 'hot' THEN 1 WHEN 'warm' THEN 30 ELSE 300 END AS j FROM m LEFT JOIN l USING (entity_id))
SELECT entity_id, CASE WHEN refreshed_on IS NULL THEN 'never' WHEN i < j THEN 'escalation' WHEN DATE '2001-08-02' - refreshed_on >= i THEN 'elapsed' ELSE 'current' END AS decision FROM d""")
def r16_refresh_due(spark, sf):
    from ..operators import rank

    tier = lambda k: F.element_at(F.array(*map(F.lit, ["hot", "warm", "cold"])), (k % 3 + 1).cast("int"))
    m = t(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), tier(F.col("c_custkey")).alias("tier"))
    last = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.to_date(F.max("o_orderdate")).alias("refreshed_on"), F.max("o_orderkey").alias("k"))
    last = last.select("entity_id", "refreshed_on", tier(F.col("k")).alias("tier"))
    return rank.refresh_due(m, last, F.lit("2001-08-02").cast("date"), {"hot": 1, "warm": 30, "cold": 300}).select("entity_id", "decision")


@query("""SELECT p_partkey AS entity_id, round(1 - least(1.0, greatest(0.0, p_retailprice * 700) / 1e6), 8) AS liquidity_shortfall, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 50.0 >= 0.9 AND (p_partkey % 30) / 10.0 >= 1.5 WHEN (p_partkey % 30) / 10.0 < 1.5 THEN false END AS volatility_spike,
CASE WHEN p_partkey % 3 <> 0 THEN coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 40 END <= 14, false) END AS event_near FROM part""")
def c19_risk_flags(spark, sf):
    k = F.col("p_partkey")
    p = t(spark, sf, "part").select(
        k.alias("entity_id"), (F.col("p_retailprice") * 700).alias("avg_dollar_volume"), F.when(k % 4 != 0, F.col("p_size") / 50.0).alias("atr_percentile"), ((k % 30) / 10.0).alias("volatility_reexpansion"),
        (k % 3 != 0).alias("events_covered"), F.when(k % 5 != 0, k % 40).alias("days_to_event"))
    return states.risk_flags(p).select("entity_id", F.round("liquidity_shortfall", 8).alias("liquidity_shortfall"), "volatility_spike", "event_near")
