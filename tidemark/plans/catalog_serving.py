"""Queries of served reads, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serving
from .catalog import query, t

_RECORDS = """rec AS (SELECT o_custkey AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'KEY_METRICS' ELSE 'RATIOS' END AS kind, o_orderdate AS t, o_orderkey AS k FROM orders WHERE o_orderdate <= TIMESTAMP '1999-01-01'),
last AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY entity_id, kind ORDER BY t DESC, k DESC) = 1)"""


@query(f"""WITH {_RECORDS}, f AS (SELECT entity_id, kind, 'number' AS metric, k::VARCHAR AS value FROM last UNION ALL SELECT entity_id, kind, CASE WHEN kind = 'RATIOS' THEN 'ratio' ELSE 'metric' END, (k % 7)::VARCHAR FROM last
UNION ALL SELECT entity_id, kind, 'shared', CASE WHEN NOT (kind = 'KEY_METRICS' AND k % 3 = 0) THEN (k % 5)::VARCHAR END FROM last)
SELECT entity_id, metric, value, kind AS source FROM f WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id, metric ORDER BY kind) = 1""")
def s4_merged_metrics(spark, sf):
    """Two kinds of statements per customer with fields of their own and fields that both have."""
    k = F.col("o_orderkey")
    metrics = k % 2 == 0
    data = F.to_json(F.struct(k.alias("number"), F.when(metrics, k % 7).alias("metric"), F.when(~metrics, k % 7).alias("ratio"), F.when(~(metrics & (k % 3 == 0)), k % 5).alias("shared")))
    rec = t(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.when(metrics, "KEY_METRICS").otherwise("RATIOS").alias("statement_type"), F.struct("o_orderdate", "o_orderkey").alias("fiscal_period_end"), F.col("o_orderdate").alias("availability_time"), data.alias("data"))
    return serving.merged_metrics(rec, ["KEY_METRICS", "RATIOS"], F.lit("1999-01-01").cast("timestamp_ntz"))


def runs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("RUNNING")
    left_out = t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("excluded"))
    o = t(spark, sf, "orders").join(left_out, "o_orderkey", "left")
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("scan_date"), F.col("o_orderdate").alias("as_of"), status.alias("status"), F.when((status != "RUNNING") | (F.col("o_orderkey") % 2 == 0), F.col("o_orderdate")).alias("finished_at"), "excluded")


@query("""WITH r AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status FROM orders)
SELECT status, count(*) AS runs, count(*) FILTER (status = 'RUNNING' AND o_orderkey % 2 <> 0 AND epoch(TIMESTAMP '2001-06-01') - epoch(o_orderdate) > 6 * 3600) AS stuck, max(o_orderdate) AS latest FROM r GROUP BY 1""")
def q9_scan_status(spark, sf):
    return serving.scan_status(runs(spark, sf), F.lit("2001-06-01").cast("timestamp_ntz"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey AS entity_id, o_orderdate::DATE AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
SELECT entity_id, count(*) AS days, min(d) AS first_date, max(d) AS last_date FROM x GROUP BY 1 HAVING count(*) > 1""")
def q9_persistent_exclusions(spark, sf):
    return serving.persistent_exclusions(runs(spark, sf))


_WINDOWS = """dec AS (SELECT date_trunc('month', o_orderdate)::DATE AS period_start, last_day(o_orderdate::DATE) AS period_end, o_orderkey AS sequence_number, CASE WHEN o_orderpriority < '4' THEN 'APPROVED' ELSE 'REJECTED' END AS status FROM orders),
cur AS (SELECT * FROM dec QUALIFY row_number() OVER (PARTITION BY period_start, period_end ORDER BY sequence_number DESC) = 1), ok AS (SELECT * FROM cur WHERE status = 'APPROVED')"""


def decisions(spark, sf):
    return t(spark, sf, "orders").select(
        F.trunc("o_orderdate", "month").alias("period_start"), F.last_day("o_orderdate").alias("period_end"), F.col("o_orderkey").alias("sequence_number"), F.when(F.col("o_orderpriority") < "4", "APPROVED").otherwise("REJECTED").alias("status"))


@query(f"WITH {_WINDOWS} SELECT * FROM ok")
def s5_approved_windows(spark, sf):
    return serving.approved(decisions(spark, sf), ["period_start", "period_end"])


@query(f"""WITH {_WINDOWS}, snap AS (SELECT o_custkey AS snapshot_id, list(DISTINCT date_trunc('month', o_orderdate)::DATE) AS months, max(o_orderdate) AS computed_at FROM orders GROUP BY 1),
everything AS (SELECT -1 AS snapshot_id, list(period_start) AS months, TIMESTAMP '2001-01-01' AS computed_at FROM ok UNION ALL SELECT -2, list(period_start), TIMESTAMP '2001-06-01' FROM ok), s AS (SELECT * FROM snap UNION ALL SELECT * FROM everything)
SELECT snapshot_id, CASE WHEN len(list_filter(months, lambda m: NOT list_contains(every, m))) > 0 THEN 'withdrawn' WHEN len(months) < len(every) THEN 'incomplete'
  WHEN epoch(TIMESTAMP '2001-06-01 12:00:00') - epoch(computed_at) > 24 * 3600 THEN 'outdated' ELSE 'current' END AS serving FROM s, (SELECT list(period_start) AS every FROM ok)""")
def s6_staleness(spark, sf):
    """Snapshots that rest on the months of a customer's orders, and two that rest on all that is approved."""
    ok = serving.approved(decisions(spark, sf), ["period_start", "period_end"]).select("period_start")
    snap = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("snapshot_id")).agg(F.collect_set(F.trunc("o_orderdate", "month")).alias("included"), F.max("o_orderdate").alias("computed_at"))
    whole = ok.agg(F.collect_set("period_start").alias("included"))
    for n, at in ((-1, "2001-01-01"), (-2, "2001-06-01")):
        snap = snap.unionByName(whole.select(F.lit(n).cast(snap.schema["snapshot_id"].dataType).alias("snapshot_id"), "included", F.lit(at).cast("timestamp_ntz").alias("computed_at")))
    return serving.staleness(snap, ok, F.lit("2001-06-01 12:00:00").cast("timestamp_ntz")).select("snapshot_id", "serving")
