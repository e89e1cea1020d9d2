"""Queries over evaluated cases: evidence, metric suites, charts, outcomes, with equivalent SQL.

Cases are made of orders: one case per order, its entity the customer, measures from the key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, evidence, outcomes, panel, reads, reports
from ..functions import windows as w
from ..sources.shared import store
from .catalog import BARS, ORACLES, _full, _H, _TR, bars, dense_panel, query, r, t
from .catalog_records import log  # noqa: F401  its queries come with it

_STATUS = ["SUCCESS", "FAILED", "EXPIRED", "INVALIDATED", "SUCCESS", "FAILED", "NO_VALID_OUTCOME"]

CASES = f"""cases AS (
  SELECT o_orderkey AS case_id, o_custkey AS entity_id, o_orderdate AS detected_at, o_orderdate + INTERVAL 30 DAY AS concluded_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS signal_id,
         (o_orderkey % 101)::DOUBLE AS score, ({_STATUS})[1 + o_orderkey % 7] AS status, (o_orderkey % 97) / 97.0 AS mfe, -(o_orderkey % 89) / 178.0 AS mae,
         (o_orderkey % 83) / 83.0 - 0.4 AS relative_return, (o_orderkey % 79) / 79.0 - 0.3 AS realized_return, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS regime, o_orderpriority AS grp
  FROM orders
)"""


def cases(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(
        k.alias("case_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("detected_at"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("concluded_at"),
        F.when(k % 3 != 0, k).alias("signal_id"), (k % 101).cast("double").alias("score"), F.element_at(F.array(*map(F.lit, _STATUS)), (k % 7 + 1).cast("int")).alias("status"),
        ((k % 97) / 97.0).alias("mfe"), (-(k % 89) / 178.0).alias("mae"), ((k % 83) / 83.0 - 0.4).alias("relative_return"), ((k % 79) / 79.0 - 0.3).alias("realized_return"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("regime"), F.col("o_orderpriority").alias("grp"))


_Z = evaluation.Z95


def _wilson(s: str, n: str, end: str) -> str:
    p, n = f"({s}) / nullif({n}, 0)::DOUBLE", f"nullif({n}, 0)::DOUBLE"
    mid, half = f"(({p}) + {_Z * _Z} / (2 * {n})) / (1 + {_Z * _Z} / {n})", f"{_Z} / (1 + {_Z * _Z} / {n}) * sqrt(({p}) * (1 - ({p})) / {n} + {_Z * _Z} / (4 * {n} * {n}))"
    return f"coalesce(greatest(0.0, {mid} - {half}), 0)" if end == "low" else f"coalesce(least(1.0, {mid} + {half}), 1)"


_NAMES = ["precision", "recall", "false_positive_rate", "hit_rate", "precision_low", "recall_high", "hit_low", "expectancy", "expectancy_low", "median_relative_return", "mean_mfe", "median_mae", "worst_mae", "mfe_mae_ratio", "max_drawdown"]


def _suite(rows: str, key: str) -> str:
    """SQL of metric_suite over the rows of a CTE, by the expression `key`."""
    took, res = "signal_id IS NOT NULL", "status IN ('SUCCESS', 'FAILED')"
    return f"""SELECT key, n, tp, fp, fn, tn, n_success, n_expired, n >= 20 AS sufficient, {', '.join(f'CASE WHEN n >= 20 THEN round({x}, 6) END AS {x}' for x in _NAMES)} FROM (
      SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS false_positive_rate, hits / nullif(k, 0) AS hit_rate,
        {_wilson('tp', 'tp + fp', 'low')} AS precision_low, {_wilson('tp', 'tp + fn', 'high')} AS recall_high, {_wilson('hits', 'k', 'low')} AS hit_low,
        expectancy - CASE WHEN k >= 2 THEN {_Z} * sd / sqrt(k) ELSE 0 END AS expectancy_low, mean_mfe / nullif(abs(mean_mae), 0) AS mfe_mae_ratio FROM (
        SELECT key, count(*) AS n, count(*) FILTER ({res} AND {took} AND status = 'SUCCESS') AS tp, count(*) FILTER ({res} AND {took} AND status <> 'SUCCESS') AS fp,
          count(*) FILTER ({res} AND NOT ({took}) AND status = 'SUCCESS') AS fn, count(*) FILTER ({res} AND NOT ({took}) AND status <> 'SUCCESS') AS tn,
          count(*) FILTER (status = 'SUCCESS') AS n_success, count(*) FILTER (status = 'EXPIRED') AS n_expired, count(*) FILTER ({took}) AS k, count(*) FILTER ({took} AND relative_return > 0) AS hits,
          avg(relative_return) FILTER ({took}) AS expectancy, stddev_samp(relative_return) FILTER ({took}) AS sd, median(relative_return) FILTER ({took}) AS median_relative_return,
          avg(mfe) FILTER ({took}) AS mean_mfe, avg(mae) FILTER ({took}) AS mean_mae, median(mae) FILTER ({took}) AS median_mae, min(mae) FILTER ({took}) AS worst_mae, min(s - peak) AS max_drawdown
        FROM (SELECT *, max(s) OVER (PARTITION BY key ORDER BY detected_at, case_id ROWS UNBOUNDED PRECEDING) AS peak FROM (
          SELECT *, sum(CASE WHEN {took} THEN relative_return END) OVER (PARTITION BY key ORDER BY detected_at, case_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, {key} AS key FROM {rows}))) GROUP BY key))"""


def suite(df):
    return df.select(*[c for c in df.columns if c in ("dimension", "key", "n", "tp", "fp", "fn", "tn", "n_success", "n_expired", "sufficient")], *[r(x, 6).alias(x) for x in _NAMES])


@query(f"WITH {CASES} {_suite('cases', 'grp')}")
def g13_metric_suite(spark, sf):
    return suite(reports.metric_suite(cases(spark, sf).withColumnRenamed("grp", "key"), ["key"]))


_BUCKET = "CASE WHEN score >= 90 AND score <= 100 THEN 90 WHEN score >= 80 AND score < 90 THEN 80 WHEN score >= 60 AND score < 80 THEN 60 WHEN score >= 40 AND score < 60 THEN 40 WHEN score >= 20 AND score < 40 THEN 20 END"


@query(f"""WITH {CASES}, scoped AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity_id ORDER BY detected_at, case_id) > 1 THEN 'same_asset_supported' ELSE 'cross_asset_only' END AS scope FROM cases),
bucketed AS (SELECT *, {_BUCKET} AS b FROM cases WHERE {_BUCKET} IS NOT NULL)
SELECT 'regime' AS dimension, * FROM ({_suite('cases', "coalesce(regime, 'UNRECORDED')")}) UNION ALL SELECT 'evidence_scope', * FROM ({_suite('scoped', 'scope')})
UNION ALL SELECT 'all', * FROM ({_suite('cases', "'all'")}) UNION ALL SELECT 'bucket', * FROM ({_suite('bucketed', 'b::VARCHAR')})""")
def g20_report(spark, sf):
    return suite(reports.report(cases(spark, sf)))


@query(f"WITH {CASES}, b AS (SELECT *, {_BUCKET} AS b FROM cases WHERE {_BUCKET} IS NOT NULL) {_suite('b', "concat(coalesce(regime, 'UNRECORDED'), '/', b)")}")
def g18_regime_and_bucket(spark, sf):
    out = reports.by_regime_and_bucket(cases(spark, sf))
    return suite(out.withColumn("key", F.concat_ws("/", "regime", F.col("bucket").cast("string"))))


@query(f"WITH {CASES} SELECT status, count(*) AS n, (SELECT count(*) FROM cases) AS total, round(count(*) / (SELECT count(*) FROM cases), 8) AS share FROM cases GROUP BY 1")
def g21_win_rate(spark, sf):
    return reports.win_rate(cases(spark, sf)).withColumn("share", F.round("share", 8))


@query(f"""WITH {CASES}, l AS (SELECT concluded_at AS t, case_id, row_number() OVER o AS i, sum(relative_return) OVER o AS c, count(*) OVER () AS n FROM cases WHERE signal_id IS NOT NULL WINDOW o AS (ORDER BY concluded_at, case_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT DISTINCT CASE WHEN s = 1999 THEN n ELSE floor(s * (n / 1999.0))::BIGINT + 1 END AS i FROM (SELECT max(n) AS n FROM l), range(0, 2000) t(s))
SELECT t AS "at", case_id, i AS outcome_index, round(c, 6) AS cumulative_relative_return FROM l WHERE n <= 2000 OR i IN (SELECT i FROM k)""")
def g22_cumulative(spark, sf):
    return reports.cumulative(cases(spark, sf)).withColumn("cumulative_relative_return", r("cumulative_relative_return", 6))


@query(f"WITH {CASES} {_suite('cases', 'regime')}".replace("FROM (SELECT *, regime AS key FROM cases)", "FROM (SELECT *, coalesce(regime, 'UNRECORDED') AS key FROM cases)").replace("n >= 20", "n >= 30"))
def g23_regime_chart(spark, sf):
    return suite(reports.by_regime(cases(spark, sf), floor=reports.PUBLIC_FLOOR).withColumnRenamed("regime", "key"))


@query(f"WITH {CASES} SELECT case_id, realized_return FROM cases WHERE status = 'SUCCESS' AND realized_return >= 0.5 ORDER BY realized_return DESC, case_id LIMIT 20")
def r13_top_performers(spark, sf):
    return reports.top_performers(cases(spark, sf)).select("case_id", "realized_return")


@query("""SELECT v AS o_orderstatus, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS v) LEFT JOIN orders ON o_orderstatus = v GROUP BY 1""")
def g26_counts(spark, sf):
    return reports.counts_with_zeros(t(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query(f"""WITH {CASES}, c AS (SELECT grp, count(*) FILTER (status IN ('SUCCESS', 'FAILED')) AS resolved, count(*) FILTER (status = 'FAILED') AS failures FROM cases GROUP BY 1)
SELECT *, round(failures / resolved, 8) AS failure_rate, round({_wilson('failures', 'resolved', 'low')}, 8) AS failure_low, round({_wilson('failures', 'resolved', 'high')}, 8) AS failure_high FROM c""")
def g9_failure_rate(spark, sf):
    out = evidence.failure_rate(cases(spark, sf), "status", ["grp"])
    return out.withColumns({c: F.round(c, 8) for c in ("failure_rate", "failure_low", "failure_high")})


@query(f"""WITH {CASES}, g AS (SELECT entity_id, regime, count(*) AS count, median(realized_return) AS m FROM cases WHERE regime IS NOT NULL GROUP BY 1, 2)
SELECT entity_id, regime, count, CASE WHEN count < 5 THEN 'INSUFFICIENT' WHEN count < 30 THEN 'SPARSE' ELSE 'ADEQUATE' END AS sufficiency, CASE WHEN count >= 5 THEN round(m, 8) END AS median_outcome FROM g""")
def g10_by_regime(spark, sf):
    return evidence.by_regime(cases(spark, sf), ["entity_id"]).withColumn("median_outcome", r("median_outcome", 8))


@query(f"""WITH {CASES} SELECT grp, count(*) AS sample_size, round(avg(mfe), 8) AS mean_mfe, round(avg(realized_return), 8) AS mean, round(quantile_cont(realized_return, 0.25), 8) AS p25, round(quantile_cont(realized_return, 0.75), 8) AS p75,
round(avg(realized_return) - {_Z} * stddev_samp(realized_return) / sqrt(count(*)), 8) AS mean_low, count(*) FILTER (status IN ('SUCCESS', 'FAILED')) AS resolved, 'ADEQUATE' AS sufficiency FROM cases GROUP BY 1""")
def e10_summary(spark, sf):
    out = evidence.summarize(cases(spark, sf), ["grp"])
    return out.select("grp", "sample_size", *[r(c, 8).alias(c) for c in ("mean_mfe", "mean", "p25", "p75", "mean_low")], "resolved", "sufficiency")


@query("""WITH d AS (SELECT a.vec_id AS query_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: ((x[1] - x[2])::DOUBLE) ** 2))) AS distance
FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) a, embeddings b) SELECT query_id, count(*) AS n, round(min(distance), 5) AS nearest, round(median(distance), 5) AS median, round(max(distance), 5) AS farthest FROM d GROUP BY 1""")
def e9_distances(spark, sf):
    from ..operators import similarity

    e = t(spark, sf, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"f{i}" for i in range(size)]
    e = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(names)])
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    d = similarity.distance_quantiles(q, e.withColumnRenamed("vec_id", "case_id"), names, [0.5], radius=1e9, scales=dict.fromkeys(names, 1.0))
    d = d.withColumn("median", F.get("quantiles", F.lit(0)))
    return d.select("query_id", "n", *[r(F.col(c) * float(size) ** 0.5, 5).alias(c) for c in ("nearest", "median", "farthest")])


_VEC = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), dims AS (SELECT unnest(generate_series(1, (SELECT max(len(e)) FROM v))) AS i),
s AS (SELECT i, CASE WHEN quantile_cont(e[i], 0.75) - quantile_cont(e[i], 0.25) > 1e-9 THEN quantile_cont(e[i], 0.75) - quantile_cont(e[i], 0.25) ELSE 1 END AS s FROM v, dims GROUP BY i),
z AS (SELECT vec_id, list(e[i] / s ORDER BY i) AS z FROM v, s GROUP BY vec_id),
d AS (SELECT a.vec_id AS query_id, sqrt(list_avg(list_transform(list_zip(a.z, b.z), lambda x: (x[1] - x[2]) ** 2))) AS distance FROM (SELECT * FROM z WHERE vec_id % 50 = 0) a, z b)"""


ORACLES["e7_radius_search"] = f"WITH {_VEC} SELECT query_id, count(*) AS n, round(min(distance), 6) AS nearest FROM d WHERE distance <= 1.25 GROUP BY 1"


@query(f"WITH {_VEC} SELECT q.vec_id AS query_id, count(d.distance) AS analogues FROM (SELECT vec_id FROM v WHERE vec_id % 50 = 0) q LEFT JOIN d ON d.query_id = q.vec_id AND distance <= 1.25 GROUP BY 1")
def e12_analogue_counts(spark, sf):
    from ..operators import similarity

    e = t(spark, sf, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"f{i}" for i in range(size)]
    e = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(names)])
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return evidence.analogue_counts(q, similarity.radius_summary(q, e.withColumnRenamed("vec_id", "case_id"), names), counted="n")


@query("""WITH c AS (SELECT o_orderkey AS case_id, o_custkey AS entity_id, o_orderdate AS detected_at FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01'),
o AS (SELECT l_orderkey AS case_id, l_shipdate AS recorded_at, l_linenumber AS line, l_tax AS tax FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-01-01' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1),
v AS (SELECT o_custkey AS entity_id, o_orderdate AS t, o_totalprice AS x, o_orderkey AS k FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01')
SELECT case_id, o.line, v.x FROM c JOIN o USING (case_id) JOIN v ON v.entity_id = c.entity_id AND v.t <= c.detected_at QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY v.t DESC, v.k DESC) = 1""")
def e1_case_set(spark, sf):
    o, li, as_of = t(spark, sf, "orders"), t(spark, sf, "lineitem"), F.lit("1999-01-01").cast("timestamp_ntz")
    c = o.where(F.col("o_orderdate") <= as_of).select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("detected_at"))
    # the one of several versions of an instant is the one with the highest number
    out = li.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("recorded_at")).agg(F.max("l_linenumber").alias("line"))
    v = o.groupBy(F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("event_time")).agg(F.max_by("o_totalprice", "o_orderkey").alias("x")).withColumn("availability_time", F.col("event_time"))
    return evidence.case_set(c, out, v, as_of).select("case_id", "line", F.col("vector.x").alias("x"))


def _measured(spark, sf):
    b = dense_panel(spark, sf).withColumn("atr", w.mean(w.true_range(F.col("high"), F.col("low"), F.col("close")), 20)).where("close is not null and atr is not null")
    c = b.where("day(event_time) = 1").select(F.concat_ws("-", "entity_id", F.date_format("event_time", "yyyyMMdd")).alias("case_id"), "entity_id", F.col("event_time").alias("detected_at"))
    return c, outcomes.measure(c, b)


_OUTCOME = f"""{BARS}, m AS (SELECT event_time, avg(close) AS market FROM dense GROUP BY 1), a AS (SELECT d.*, market, {_TR} AS tr FROM dense d JOIN m USING (event_time)),
b AS (SELECT *, {_full('tr', 20, 'avg')} AS atr FROM a), n AS (SELECT *, row_number() OVER {_H}) AS i FROM b WHERE close IS NOT NULL AND atr IS NOT NULL),
e AS (SELECT concat_ws('-', entity_id, strftime(event_time, '%Y%m%d')) AS case_id, entity_id, i AS i0, close AS entry, atr AS atr0, market AS market0, event_time AS entry_at FROM n WHERE day(event_time) = 1),
x AS (SELECT case_id, e.entity_id, entry, atr0, entry_at, i - i0 AS step, event_time, high / entry - 1 AS up, low / entry - 1 AS down, close / entry - 1 AS ret, close / entry - market / market0 AS rel FROM e LEFT JOIN n ON n.entity_id = e.entity_id AND n.i > i0 AND n.i <= i0 + 60),
o AS (SELECT case_id, entity_id, entry, atr0, entry_at, count(step) AS bars, max(up) AS mfe, min(down) AS mae, arg_max(ret, step) AS realized, arg_max(rel, step) AS rel, max(event_time) AS window_end, arg_max(event_time, (up, -step)) AS peak_at,
  min(step) FILTER (up >= 1.5 * atr0 / entry) AS tb, min(step) FILTER (down <= -0.75 * atr0 / entry) AS sb FROM x GROUP BY ALL),
st AS (SELECT *, CASE WHEN bars < 2 THEN 'NO_VALID_OUTCOME' WHEN sb IS NOT NULL AND (tb IS NULL OR sb <= tb) THEN 'FAILED' WHEN tb IS NOT NULL THEN 'SUCCESS' ELSE 'EXPIRED' END AS status FROM o)"""


@query(f"""WITH {_OUTCOME} SELECT case_id, bars, round(mfe, 6) AS mfe, round(mae, 6) AS mae, round(realized, 6) AS realized_return, round(rel, 6) AS relative_return, round(realized / (atr0 / entry), 4) AS volatility_adjusted,
tb AS target_bar, sb AS stop_bar, status FROM st""")
def e27_outcomes(spark, sf):
    _, m = _measured(spark, sf)
    return m.select("case_id", "bars", *[r(c, 6).alias(c) for c in ("mfe", "mae", "realized_return", "relative_return")], r("volatility_adjusted").alias("volatility_adjusted"), F.col("target_bar").cast("bigint").alias("target_bar"),
                    F.col("stop_bar").cast("bigint").alias("stop_bar"), "status")


_MARKED = """bars AS (
  SELECT n_regionkey AS entity_id, l_shipdate AS event_time, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) AS close
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
), ranged AS (SELECT *, CASE WHEN lag(close) OVER e IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER e), abs(low - lag(close) OVER e)) END AS tr, ln(close / lag(close) OVER e) AS lr FROM bars WINDOW e AS (PARTITION BY entity_id ORDER BY event_time)),
b AS (SELECT *, CASE WHEN count(tr) OVER w = 20 THEN avg(tr) OVER w END AS atr FROM ranged WINDOW w AS (PARTITION BY entity_id ORDER BY event_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
market AS (SELECT event_time, avg(close) AS close FROM bars GROUP BY 1), cal AS (SELECT DISTINCT event_time::DATE AS day FROM bars WHERE isodow(event_time) <= 5), numbered AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM cal),
c AS (SELECT o_orderkey AS case_id, n_regionkey AS entity_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 20 HOUR END AS entry_at, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 140) AS terminal_at,
  ['invalidated', 'expired', 'completed', 'lost_eligibility'][1 + o_orderkey % 4] AS terminal_event FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT c.*, (SELECT max(n) FROM numbered WHERE day <= entry_at::DATE) AS passed FROM c),
w AS (SELECT h.*, CASE WHEN entry_at IS NOT NULL THEN CASE WHEN m.day IS NULL OR terminal_at <= m.day + INTERVAL 20 HOUR THEN terminal_at ELSE m.day + INTERVAL 20 HOUR END END AS ends_at,
  CASE WHEN entry_at IS NOT NULL THEN CASE WHEN m.day IS NULL OR terminal_at <= m.day + INTERVAL 20 HOUR THEN 'terminal_event' ELSE 'horizon' END END AS ends_because FROM h LEFT JOIN numbered m ON m.n = h.passed + 60),
e AS (SELECT w.*, b.event_time AS t0, b.close AS entry, b.atr FROM w ASOF LEFT JOIN b ON b.entity_id = w.entity_id AND b.event_time <= w.entry_at),
x AS (SELECT e.case_id, count(*) AS bars, max(high / entry - 1) FILTER (event_time > t0) AS mfe, min(low / entry - 1) FILTER (event_time > t0) AS mae, arg_max(close, event_time) / any_value(entry) - 1 AS realized, stddev_samp(lr) FILTER (event_time > t0) AS sd,
  min(event_time) FILTER (event_time > t0 AND high / entry - 1 >= 1.5 * e.atr / entry) AS target_at, min(event_time) FILTER (event_time > t0 AND low / entry - 1 <= -0.75 * e.atr / entry) AS stop_at
  FROM e JOIN b ON b.entity_id = e.entity_id AND event_time BETWEEN t0 AND ends_at GROUP BY 1),
k AS (SELECT case_id, CASE WHEN count(*) >= 2 THEN arg_max(market.close, event_time) / arg_min(market.close, event_time) - 1 END AS market FROM e JOIN market ON event_time BETWEEN entry_at AND ends_at GROUP BY 1)"""


@query(f"""WITH {_MARKED} SELECT case_id, ends_at, ends_because, coalesce(bars, 0) AS bars, CASE WHEN ends_at IS NULL THEN 'no_entry_event' WHEN bars IS NULL THEN 'no_bars' WHEN bars < 2 THEN 'too_few_bars' END AS unavailable,
CASE WHEN bars >= 2 THEN round(mfe, 6) + 0.0 END AS mfe, CASE WHEN bars >= 2 THEN round(mae, 6) + 0.0 END AS mae, CASE WHEN bars >= 2 THEN round(realized, 6) + 0.0 END AS realized_return, CASE WHEN bars >= 2 THEN round(realized - market, 6) + 0.0 END AS relative_return,
CASE WHEN bars >= 2 AND sd > 0 THEN round(realized / (sd * sqrt(252.0)), 4) + 0.0 END AS volatility_adjusted, CASE WHEN bars >= 2 THEN target_at END AS target_at, CASE WHEN bars >= 2 THEN stop_at END AS stop_at,
CASE WHEN ends_at IS NULL OR bars IS NULL OR bars < 2 THEN 'NO_VALID_OUTCOME' WHEN stop_at IS NOT NULL AND (target_at IS NULL OR stop_at <= target_at) THEN 'FAILED' WHEN target_at IS NOT NULL THEN 'SUCCESS'
  WHEN terminal_event IN ('invalidated', 'lost_eligibility') THEN 'INVALIDATED' ELSE 'EXPIRED' END AS status FROM e LEFT JOIN x USING (case_id) LEFT JOIN k USING (case_id)""")
def e26_outcome_windows(spark, sf):
    """Every order as a case: entered at its date unless its key divides by 11, ended up to 139 days later, measured on its region's bars."""
    b = store(bars(spark, sf).select("entity_id", "event_time", "high", "low", "close"))
    b = b.withColumn("atr", w.mean(w.true_range(F.col("high"), F.col("low"), F.col("close")), 20))
    market = b.groupBy("event_time").agg(F.avg("close").alias("close")).withColumn("benchmark_id", F.lit("market"))
    calendar = b.where("weekday(event_time) < 5").select(F.to_date("event_time").alias("day")).distinct()
    o = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    key, ends = F.col("o_orderkey"), ["invalidated", "expired", "completed", "lost_eligibility"]
    c = o.select(
        key.alias("case_id"), F.col("n_regionkey").alias("entity_id"), F.when(key % 11 != 0, F.col("o_orderdate") + F.expr("INTERVAL 20 HOURS")).alias("entry_at"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(CAST(o_orderkey % 140 AS INT))")).alias("terminal_at"), F.element_at(F.array(*map(F.lit, ends)), (key % 4 + 1).cast("int")).alias("terminal_event"), F.lit("market").alias("benchmark_id"))
    x = outcomes.excursions(c, b, calendar, market)
    return x.select("case_id", "ends_at", "ends_because", F.col("bars").cast("bigint").alias("bars"), "unavailable", *[r(n, 6).alias(n) for n in ("mfe", "mae", "realized_return", "relative_return")],
                    r("volatility_adjusted").alias("volatility_adjusted"), "target_at", "stop_at", "status")


_EVENTS = """ev AS (SELECT s_nationkey % 5 AS entity_id, (DATE '1995-01-15' + (s_suppkey * 17 % 2300)::INT)::TIMESTAMP AS t, s_suppkey % 2 = 0 AS action FROM supplier)"""


@query(f"""WITH {_OUTCOME}, {_EVENTS}, k AS (SELECT st.*, EXISTS (SELECT 1 FROM ev WHERE ev.entity_id = st.entity_id AND action AND t BETWEEN entry_at AND window_end) AS acted,
  EXISTS (SELECT 1 FROM ev WHERE ev.entity_id = st.entity_id AND NOT action AND t BETWEEN peak_at - INTERVAL 5 DAY AND peak_at + INTERVAL 5 DAY) AS catalyst FROM st), f AS (
SELECT *, CASE WHEN status = 'SUCCESS' THEN NULL WHEN acted THEN 'G_CORPORATE_ACTION_DISTORTION' WHEN catalyst THEN 'E_CATALYST_DRIVEN' WHEN realized <= -2.25 * atr0 / entry THEN 'D_BREAKDOWN'
WHEN mfe >= 0.45 * atr0 / entry THEN 'C_FALSE_BREAKOUT' ELSE 'B_PATTERN_NO_EXPANSION' END AS false_positive FROM k)
SELECT case_id, status, false_positive, CASE WHEN bars < 2 THEN 'LOW' WHEN substr(false_positive, 1, 1) IN ('E', 'G') THEN 'MEDIUM' WHEN status IN ('SUCCESS', 'FAILED') THEN 'HIGH' ELSE 'MEDIUM' END AS review_confidence FROM f""")
def e29_taxonomy(spark, sf):
    _, m = _measured(spark, sf)
    at = F.date_add(F.lit("1995-01-15").cast("date"), (F.col("s_suppkey") * 17 % 2300).cast("int")).cast("timestamp_ntz")
    ev = t(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("entity_id"), at.alias("at"), (F.col("s_suppkey") % 2 == 0).alias("action"))
    actions, events = ev.where("action").select("entity_id", F.col("at").alias("effective_date")), ev.where("not action").select("entity_id", F.col("at").alias("scheduled_for"))
    return outcomes.classify(m, actions=actions, events=events).select("case_id", "status", "false_positive", "review_confidence")


@query("""SELECT o_orderkey AS case_id, min(l_shipdate) FILTER (l_linestatus = 'O') AS detection_at, min(l_shipdate) FILTER (l_linestatus = 'F') AS active_at, count(*) FILTER (l_returnflag = 'R') AS retreats
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def e31_checklist(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("at"), F.when(F.col("l_linestatus") == "O", "DETECTION").otherwise("ACTIVE").alias("status"),
                                         F.when(F.col("l_returnflag") == "R", "retreat").alias("reason"))
    return outcomes.stage_checklist(li, ["DETECTION", "ACTIVE"])


@query("""SELECT c_custkey AS case_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def e32_pending(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    return outcomes.pending(c, t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("case_id")))


@query("""WITH f AS (SELECT o_custkey AS entity_id, o_orderkey AS k, o_orderdate AS fiscal_period_end, o_totalprice AS revenue, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT k, round(0.4, 6) AS gross_margin, round(revenue / nullif(b, 0) - 1, 6) AS revenue_growth FROM f""")
def s1_ratios(spark, sf):
    o = t(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("k"), F.struct("o_orderdate", "o_orderkey").alias("fiscal_period_end"), F.col("o_totalprice").alias("revenue"),
        (F.col("o_totalprice") * 0.4).alias("gross_profit"), (F.col("o_totalprice") * 0.1).alias("net_income"))
    return reads.ratios(o).select("k", r("gross_margin", 6).alias("gross_margin"), r("revenue_growth", 6).alias("revenue_growth"))


@query("""SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 30) GROUP BY 1""")
def s2_series(spark, sf):
    s = reads.series(t(spark, sf, "events"), "user_id", "ts", ["event_id", "value"], n=30)
    return s.select("user_id", F.size("points").cast("bigint").alias("n"), F.col("points")[0]["ts"].alias("first"), F.element_at("points", -1)["ts"].alias("last"))


@query("""SELECT s_suppkey, array_to_string(list_sort(list_filter([lag(s_suppkey, 1) OVER o, lead(s_suppkey, 1) OVER o, lag(s_suppkey, 2) OVER o, lead(s_suppkey, 2) OVER o], lambda x: x IS NOT NULL)), ',') AS peers
FROM supplier WINDOW o AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)""")
def s3_peers(spark, sf):
    p = reads.peers(t(spark, sf, "supplier"), "s_suppkey", ["s_nationkey"], "s_acctbal", n=4)
    return p.select("s_suppkey", F.array_join(F.array_sort("peers"), ",").alias("peers"))


@query(f"""WITH {BARS}, k AS (SELECT *, event_time::DATE AS d FROM bars WHERE close IS NOT NULL), m AS (
  SELECT entity_id, (d + ((5 - isodow(d) + 7) % 7)::INT)::DATE AS period_end, arg_min(open, event_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, event_time) AS close, sum(volume) AS volume FROM k GROUP BY ALL
) SELECT * FROM m WHERE period_end <= (SELECT max(event_time)::DATE FROM bars)""")
def p5_resample_week(spark, sf):
    return panel.resample(bars(spark, sf), "week")


@query(f"""WITH {CASES}, b AS (SELECT {_BUCKET} AS bucket, avg((status = 'SUCCESS')::INT) AS rate FROM cases WHERE {_BUCKET} IS NOT NULL GROUP BY 1), v AS (SELECT *, rate < lag(rate) OVER (ORDER BY bucket) - 0.02 AS bad, rank() OVER (ORDER BY bucket) AS x, rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2 AS y FROM b)
SELECT count(*) FILTER (bad) AS violations, round(arg_max(rate, bucket) - arg_min(rate, bucket), 6) AS top_less_bottom, round(corr(x, y), 6) AS spearman FROM v""")
def g16_monotonicity(spark, sf):
    c = cases(spark, sf).withColumn("bucket", evaluation.score_bucket(F.col("score"))).where("bucket is not null")
    m = evaluation.monotonicity(c.groupBy("bucket").agg(F.avg((F.col("status") == "SUCCESS").cast("int")).alias("rate")), "bucket", "rate")
    return m.select("violations", r("top_less_bottom", 6).alias("top_less_bottom"), r("spearman", 6).alias("spearman"))


@query(f"""WITH {CASES} SELECT least(9, floor(score / 10))::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, CASE WHEN count(*) >= 10 THEN round(avg((status = 'SUCCESS')::INT), 6) END AS rate FROM cases GROUP BY 1""")
def g17_calibration(spark, sf):
    out = evaluation.calibration(cases(spark, sf), "score", F.col("status") == "SUCCESS")
    return out.select("bin", "n", r("mean_score", 6).alias("mean_score"), r("rate", 6).alias("rate"))
