"""Billing and summary queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import ledger
from quillspark.sources import bindings as b

TODAY = b.AS_OF_ORDERS
APP = ["5-LOW"]


def _reports(spark, d):
    """Cost reports in JSON: one for each half of the days, a bucket a day, an amount in cents for each event type."""
    e = b.table(spark, d, "events")
    each = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum(F.col("value").cast("decimal(14,6)")).cast("string").alias("amount"))
    day = each.groupBy("day").agg(F.collect_list(F.struct("amount")).alias("results")).select(F.struct(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("starting_at"), "results").alias("b"), (F.dayofmonth("day") % 2).alias("half"))
    return day.groupBy("half").agg(F.to_json(F.struct(F.collect_list("b").alias("data"))).alias("report"))


def _runs(spark, d):
    r = b.agent_runs(spark, d)
    return r.withColumns({"items_added": F.col("items_processed") % 3, "items_updated": F.col("items_processed"), "cost_usd": F.when(F.col("id") % 11 != 0, F.col("cost_usd"))})


def _log(spark, d):
    """Checks: orders as log rows, of which some came from the cache."""
    o = b.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("checked_at"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("decimal(18,4)")).alias("cost_usd"))


def billed_days(spark, d):
    return ledger.billed_days(_reports(spark, d))


def billed_drift(spark, d):
    estimated = b.user_costs(spark, d, b.AS_OF_EVENTS, 30)
    return ledger.drift(ledger.billed_days(_reports(spark, d)), estimated)


def check_costs(spark, d):
    end = F.lit(TODAY).cast("timestamp_ntz")
    return ledger.check_cost(_log(spark, d), end - F.make_interval(days=F.lit(30)), end)


def agent_summary(spark, d):
    return ledger.agent_summary(_runs(spark, d), _log(spark, d), APP, TODAY, 30)


def interactive_totals(spark, d):
    surfaces = spark.createDataFrame([("5-LOW", "Chat"), ("4-NOT SPECIFIED", "Ranking"), ("9-NONE", "Idle")], "agent string, name string")
    return ledger.interactive_totals(_runs(spark, d), surfaces)


def day_agent_series(spark, d):
    return ledger.day_agent_series(_runs(spark, d), TODAY, 30)


def refresh_progress(spark, d):
    rows = b.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("stamp"))
    return ledger.progress(rows, "stamp", 40_000)


def sample_projection(spark, d):
    runs = _runs(spark, d)
    return ledger.projected(runs.filter("id % 50 = 0 and cost_usd is not null"), b.table(spark, d, "part"))


QUERIES = {f.__name__: f for f in (billed_days, billed_drift, check_costs, agent_summary, interactive_totals, day_agent_series, refresh_progress, sample_projection)}

_RUNS = """runs AS (SELECT o_orderkey AS id, o_orderpriority AS agent, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished_at, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS errors,
 CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,6)) END AS cost_usd, coalesce(n, 0) AS items_processed, coalesce(n, 0) % 3 AS items_added, coalesce(n, 0) AS items_updated, o_orderkey % 7 = 0 AS dry
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_LOG = "log AS (SELECT o_orderdate AS checked_at, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,4)) END AS cost_usd FROM orders)"
_PERIOD = "CASE WHEN {0} >= TIMESTAMP '1998-06-01' AND {0} < TIMESTAMP '1998-07-01' THEN 'current' WHEN {0} >= TIMESTAMP '1998-05-02' AND {0} < TIMESTAMP '1998-06-01' THEN 'previous' END"
_BILLED = "billed AS (SELECT CAST(ts AS DATE) AS day, CAST(round(sum(CAST(value AS DECIMAL(14,6))) * 0.01, 4) AS DECIMAL(18,4)) AS cost_usd FROM events GROUP BY 1)"

ORACLES = {
    "billed_days": f"WITH {_BILLED} SELECT * FROM billed",
    "billed_drift": f"""WITH {_BILLED}, b AS (SELECT CAST(sum(cost_usd) AS DECIMAL(18,4)) AS billed_usd FROM billed), e AS (SELECT CAST(round(sum(CAST(value AS DECIMAL(14,6))), 4) AS DECIMAL(18,4)) AS estimated_usd FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01')
SELECT *, CASE WHEN estimated_usd <> 0 THEN CAST(billed_usd - estimated_usd AS DECIMAL(18,4)) END AS drift_usd FROM b, e""",
    "check_costs": f"WITH {_LOG} SELECT CAST(coalesce(sum(cost_usd), 0) AS DECIMAL(18,4)) AS cost_usd, count(*) AS billed_checks FROM log WHERE checked_at >= TIMESTAMP '1998-06-01' AND checked_at < TIMESTAMP '1998-07-01' AND cost_usd IS NOT NULL",
    "agent_summary": f"""WITH {_RUNS}, {_LOG}, p(period) AS (VALUES ('current'), ('previous')),
s AS (SELECT {_PERIOD.format('started_at')} AS period, count(*) FILTER (agent <> '5-LOW') AS runs, coalesce(sum(cost_usd) FILTER (agent <> '5-LOW'), 0) AS a, coalesce(sum(cost_usd) FILTER (agent = '5-LOW'), 0) AS app,
 coalesce(sum(items_updated) FILTER (agent <> '5-LOW' AND NOT dry), 0) AS rows_updated, coalesce(sum(items_added) FILTER (agent <> '5-LOW' AND NOT dry), 0) AS rows_added, coalesce(sum(errors) FILTER (agent <> '5-LOW'), 0) AS errors,
 count(*) FILTER (agent <> '5-LOW' AND errors > 0) AS failed_runs, count(*) FILTER (agent <> '5-LOW' AND dry) AS dry_runs, count(*) FILTER (agent <> '5-LOW' AND cost_usd IS NULL AND finished_at IS NULL) AS unknown_cost_runs FROM runs GROUP BY 1),
c AS (SELECT {_PERIOD.format('checked_at')} AS period, sum(cost_usd) AS dl, count(cost_usd) AS n FROM log GROUP BY 1),
j AS (SELECT p.period, coalesce(runs, 0) AS runs, coalesce(a, 0) AS a, coalesce(app, 0) AS app, coalesce(dl, 0) AS dl, coalesce(n, 0) AS n, rows_updated, rows_added, errors, failed_runs, dry_runs, unknown_cost_runs FROM p LEFT JOIN s ON s.period = p.period LEFT JOIN c ON c.period = p.period)
SELECT period, runs, CAST(a AS DECIMAL(18,4)) AS agent_cost_usd, CAST(coalesce(rows_updated, 0) AS BIGINT) AS rows_updated, CAST(coalesce(rows_added, 0) AS BIGINT) AS rows_added, CAST(coalesce(errors, 0) AS BIGINT) AS errors, coalesce(failed_runs, 0) AS failed_runs, coalesce(dry_runs, 0) AS dry_runs,
 coalesce(unknown_cost_runs, 0) AS unknown_cost_runs, CAST(dl AS DECIMAL(18,4)) AS deadline_cost_usd, n AS billed_checks, CAST(app + dl AS DECIMAL(18,4)) AS app_cost_usd, CAST(a + app + dl AS DECIMAL(18,4)) AS cost_usd, coalesce(round(CAST(failed_runs AS DOUBLE) / nullif(runs, 0), 3), 0) AS error_rate FROM j""",
    "interactive_totals": f"""WITH {_RUNS}, t(agent, name) AS (VALUES ('5-LOW', 'Chat'), ('4-NOT SPECIFIED', 'Ranking'), ('9-NONE', 'Idle')), s AS (SELECT agent, sum(items_processed) AS calls, sum(cost_usd) AS cost FROM runs GROUP BY 1)
SELECT t.agent, name, CAST(coalesce(calls, 0) AS BIGINT) AS calls, CAST(coalesce(cost, 0) AS DECIMAL(18,4)) AS cost_usd FROM t LEFT JOIN s ON s.agent = t.agent""",
    "day_agent_series": f"""WITH {_RUNS}, spine AS (SELECT CAST(unnest(generate_series(DATE '1998-06-01', DATE '1998-06-30', INTERVAL 1 DAY)) AS DATE) AS day),
s AS (SELECT CAST(started_at AS DATE) AS day, agent, sum(cost_usd) AS cost, count(*) AS n, sum(items_updated + items_added) AS changed FROM runs GROUP BY 1, 2)
SELECT day, agent, CAST(coalesce(cost, 0) AS DECIMAL(18,4)) AS cost_usd, coalesce(n, 0) AS runs, CAST(coalesce(changed, 0) AS BIGINT) AS rows FROM spine LEFT JOIN s USING (day)""",
    "refresh_progress": "SELECT count(*) AS done, CAST(count(*) * 100 // 40000 AS BIGINT) AS percent, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders WHERE o_orderkey % 3 <> 0",
    "sample_projection": f"""WITH {_RUNS}, m AS (SELECT count(*) AS sampled, avg(CAST(cost_usd AS DOUBLE)) AS mean FROM runs WHERE id % 50 = 0 AND cost_usd IS NOT NULL), n AS (SELECT count(*) AS population FROM part) SELECT sampled, population, round(mean, 6) AS mean_usd, round(mean * population, 4) AS projected_usd FROM m, n""",
}
