"""Cost and run queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import extract
from quillspark.operators import costs, runs
from quillspark.sources import bindings as b

_FACTS = """facts AS (SELECT CAST(user_id AS VARCHAR) AS userid, CAST(ts AS DATE) AS day, event_type AS feature,
  CASE event_type WHEN 'click' THEN 'gemini' WHEN 'view' THEN 'claude' WHEN 'purchase' THEN 'deadline_check' WHEN 'error' THEN 'claude' ELSE event_type END AS surface,
  CASE event_type WHEN 'click' THEN 'Gemini-flash' WHEN 'view' THEN 'claude-small' WHEN 'signup' THEN 'other-model' ELSE '' END AS model,
  count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(14,6))) AS DECIMAL(18,6)) AS cost_usd, sum(event_id % 1000) AS input_tokens, sum(event_id % 300) AS output_tokens, sum(event_id % 4) AS web_searches,
  min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL),
win AS (SELECT * FROM facts WHERE day BETWEEN DATE '2024-01-31' - 30 AND DATE '2024-01-31')"""
_RUNS = """runs AS (SELECT o_orderkey AS id, o_orderpriority AS agent, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS finished_at,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS errors, CAST(o_totalprice AS DECIMAL(18,6)) AS cost_usd, coalesce(n, 0) AS items_processed,
  CASE WHEN o_orderkey % 7 = 0 THEN 'sweep-dryrun' ELSE 'sweep' END AS mode
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _facts(spark, d):
    return b.user_costs(spark, d, b.AS_OF_EVENTS, 30)


def user_cost_report(spark, d):
    return costs.per_user(_facts(spark, d), b.users(spark, d), 50)


def cost_grouping_sets(spark, d):
    return costs.grouped(_facts(spark, d))


def user_feature_breakdown(spark, d):
    spend = costs.user_breakdown(_facts(spark, d)).select("userid", F.explode("spend").alias("dimension", "costs"))
    return spend.select("userid", "dimension", F.explode("costs").alias("value", "cost_usd"))


def provider_report(spark, d):
    return costs.by_provider(_facts(spark, d))


def model_report(spark, d):
    return costs.by_model(_facts(spark, d))


def top_features_per_user(spark, d):
    return costs.top_features(_facts(spark, d))


def daily_cost_series(spark, d):
    return costs.daily_series(_facts(spark, d), b.AS_OF_EVENTS, 30)


def _ledger(spark, d):
    runs_usd = b.table(spark, d, "orders").agg(F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(0)).cast(costs.TOTAL).alias("runs_usd"))
    checks_usd = b.table(spark, d, "events").filter("event_type = 'error'").agg(F.coalesce(F.sum(F.col("value").cast("decimal(14,6)")), F.lit(0)).cast(costs.TOTAL).alias("checks_usd"))
    return runs_usd.crossJoin(F.broadcast(checks_usd))


def cost_totals_reconciled(spark, d):
    return costs.totals(_facts(spark, d), _ledger(spark, d))


def cost_report(spark, d):
    """Totals, users, providers, models and days of the window in one answer."""
    return costs.report(_facts(spark, d), b.users(spark, d), _ledger(spark, d), b.AS_OF_EVENTS, 30, 50)


#: Dollars for a million tokens in and out, and for a search; one provider also bills for its cache.
RATES = [("google", "0.75", "3.75", "0", "0", "0.014"), ("anthropic", "1", "5", "1", "1", "0.01")]


def call_costs(spark, d):
    e = b.table(spark, d, "events")
    numbers = {"input_tokens": 1000, "output_tokens": 300, "cache_write_tokens": 70, "cache_read_tokens": 500, "web_searches": 4}
    usage = e.select("event_id", F.when(F.col("event_type") == "click", "Gemini-flash").when(F.col("event_type") == "view", "claude-small").alias("model"), F.col("event_type").alias("surface"), *((F.col("event_id") % n).alias(c) for c, n in numbers.items()))
    rates = spark.createDataFrame(RATES, "provider string, i string, o string, w string, r string, s string").select("provider", *(F.col(c).cast("decimal(10,4)").alias(n) for c, n in (("i", "in_rate"), ("o", "out_rate"), ("w", "cache_write_rate"), ("r", "cache_read_rate"), ("s", "search_rate"))))
    return costs.call_cost(usage.withColumn("provider", costs.provider_of()), rates).select("event_id", "provider", "cost_usd")


def agent_kpi_periods(spark, d):
    return runs.kpi_periods(b.agent_runs(spark, d), b.AS_OF_ORDERS, 30)


def agent_day_matrix(spark, d):
    e = b.user_costs(spark, d).withColumn("surface", F.col("feature"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    pivoted = e.groupBy("day").pivot("surface", kinds).agg(F.sum("calls"))
    return pivoted.select("day", *(F.coalesce(F.col(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds))


def agent_totals(spark, d):
    registry = spark.createDataFrame([("1-URGENT", "urgent"), ("2-HIGH", "high"), ("9-IDLE", "idle")], "agent string, label string")
    return runs.agent_totals(b.agent_runs(spark, d), registry)


def latest_run_per_agent(spark, d):
    return runs.newest(b.agent_runs(spark, d), 1).select("agent", "id", "started_at", runs.status("1998-07-01 00:30:00").alias("status"))


def run_status(spark, d):
    return b.agent_runs(spark, d).select("id", runs.status("1998-07-01 00:30:00").alias("status"))


def estimate_from_last10(spark, d):
    return runs.estimate(b.agent_runs(spark, d), 100, 5)


def _registry(spark):
    return spark.createDataFrame([("1-URGENT", "Urgent", "items"), ("2-HIGH", "High", "rows"), ("3-MEDIUM", "Medium", "rows"), ("9-IDLE", "Idle", "seeds")], "agent string, label string, unit string")


def agent_cards(spark, d):
    """The card of each registered agent."""
    r = b.agent_runs(spark, d).withColumn("notes", F.when(F.col("id") % 2 == 0, F.concat(F.lit("order "), "id")).otherwise(""))
    return runs.cards(r, _registry(spark), "1998-07-01 00:30:00")


def run_plans(spark, d):
    """What a run of each agent would handle, as its last preview says, with the estimate for it."""
    r = b.agent_runs(spark, d)
    line = F.concat(F.lit('PREVIEW_JSON: {"count": '), F.col("n").cast("string"), F.lit(', "label": "x"}'))
    waiting = b.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("agent")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("n")).withColumn("out", F.concat(F.lit("PREVIEW_JSON: {}\n"), line, F.lit("\nready")))
    idle = spark.createDataFrame([("9-IDLE", 'PREVIEW_JSON: {"count": 7, "label": "y"}'), ("8-NONE", 'PREVIEW_JSON: {"count": 0, "label": "y"}')], "agent string, out string")
    previews = waiting.select("agent", "out").unionByName(idle).select("agent", extract.preview(F.col("out"))["count"].alias("count"))
    return runs.plans(r, previews, 5)


def run_history(spark, d):
    r = b.agent_runs(spark, d).filter(F.col("started_at") >= F.lit("1998-06-01").cast("timestamp_ntz")).filter(F.col("started_at") < F.lit("1998-07-01").cast("timestamp_ntz"))
    return r.select("id", "agent", "started_at", runs.is_dry_run().alias("dry_run"), runs.status("1998-07-01").alias("status")).orderBy(F.desc("started_at"), F.desc("id")).limit(50)


def yield_ranking(spark, d):
    l, p = b.table(spark, d, "lineitem"), b.table(spark, d, "part")
    seeds = l.join(p, l["l_partkey"] == p["p_partkey"]).groupBy(F.col("p_brand").alias("seed")).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("l_returnflag") == "R").alias("dupes"), F.count_if(F.col("l_returnflag") != "R").alias("added"), F.sum(F.col("l_tax").cast("decimal(12,2)")).cast("decimal(18,2)").alias("cost"))
    return runs.seed_yield(seeds)


def hourly_progress(spark, d):
    return runs.hourly_first(b.table(spark, d, "events"), "ts", "event_id", 10).select("hour", "place", "event_id")


QUERIES = {f.__name__: f for f in (user_cost_report, cost_grouping_sets, user_feature_breakdown, provider_report, model_report, top_features_per_user, daily_cost_series, cost_totals_reconciled, cost_report, call_costs, agent_kpi_periods, agent_day_matrix, agent_totals, latest_run_per_agent, run_status, estimate_from_last10, agent_cards, run_plans, run_history, yield_ranking, hourly_progress)}

_STATUS = """CASE WHEN coalesce(errors, 0) > 0 THEN 'failed' WHEN finished_at IS NOT NULL THEN 'success' WHEN started_at IS NULL THEN 'interrupted'
  WHEN date_diff('second', started_at, TIMESTAMP '{0}') < 3600 THEN 'running' ELSE 'interrupted' END"""
_PROVIDER = "CASE WHEN lower(trim(model)) LIKE 'claude%' THEN 'anthropic' WHEN lower(trim(model)) LIKE 'gemini%' THEN 'google' WHEN surface IN ('claude', 'deadline_check') THEN 'anthropic' WHEN surface = 'gemini' THEN 'google' ELSE 'unknown' END"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in costs.SUMS) + ", CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd"

ORACLES = {
    "user_cost_report": f"""WITH {_FACTS}, s AS (SELECT userid, {_SUMS}, min(first_at) AS first_at, max(last_at) AS last_at FROM win GROUP BY 1)
SELECT s.userid, coalesce(c_name, 'no account') AS name, coalesce(c_mktsegment, 'none') AS status, calls, input_tokens, output_tokens, web_searches, cost_usd, (SELECT greatest(count(*) - 50, 0) FROM s) AS left_out, round(CAST(cost_usd AS DOUBLE) / calls, 6) AS cost_per_call,
 round(CAST(cost_usd AS DOUBLE) * 100 / CAST(9.99 AS DOUBLE), 2) AS pct_of_plan, round(CAST(9.99 AS DOUBLE) - CAST(cost_usd AS DOUBLE), 4) AS margin, first_at, last_at
FROM s LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON s.userid = CAST(c.c_custkey AS VARCHAR) ORDER BY cost_usd DESC, s.userid LIMIT 50""",
    "cost_grouping_sets": f"""WITH {_FACTS}, f AS (SELECT *, {_PROVIDER} AS provider FROM win), a AS (
 SELECT 'user' AS level, userid AS key, * FROM f UNION ALL BY NAME SELECT 'provider' AS level, provider AS key, * FROM f UNION ALL BY NAME SELECT 'model' AS level, provider || '/' || model AS key, * FROM f
 UNION ALL BY NAME SELECT 'feature' AS level, feature AS key, * FROM f UNION ALL BY NAME SELECT 'day' AS level, CAST(day AS VARCHAR) AS key, * FROM f)
SELECT level, key, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd, count(DISTINCT userid) AS users FROM a GROUP BY 1, 2""",
    "user_feature_breakdown": f"""WITH {_FACTS}, f AS (SELECT *, {_PROVIDER} AS provider FROM win), e AS (SELECT userid, 'feature' AS dimension, feature AS value, cost_usd FROM f UNION ALL SELECT userid, 'surface', surface, cost_usd FROM f
 UNION ALL SELECT userid, 'provider', provider, cost_usd FROM f UNION ALL SELECT userid, 'model', model, cost_usd FROM f) SELECT userid, dimension, value, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd FROM e GROUP BY 1, 2, 3""",
    "provider_report": f"""WITH {_FACTS}, f AS (SELECT *, {_PROVIDER} AS provider FROM win), s AS (SELECT provider, {_SUMS}, count(DISTINCT userid) AS users, string_agg(DISTINCT model, '|' ORDER BY model) AS models FROM f GROUP BY 1),
e AS (SELECT provider, feature, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS c FROM f GROUP BY 1, 2) SELECT s.*, (SELECT string_agg(feature || '=' || CAST(c AS VARCHAR), ';' ORDER BY c DESC, feature) FROM e WHERE e.provider = s.provider) AS features FROM s""",
    "model_report": f"""WITH {_FACTS}, f AS (SELECT *, {_PROVIDER} AS provider FROM win), s AS (SELECT provider, model, {_SUMS}, count(DISTINCT userid) AS users FROM f GROUP BY 1, 2),
e AS (SELECT provider, model, feature, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS c FROM f GROUP BY 1, 2, 3) SELECT s.*, (SELECT string_agg(feature || '=' || CAST(c AS VARCHAR), ';' ORDER BY c DESC, feature) FROM e WHERE e.provider = s.provider AND e.model = s.model) AS features FROM s""",
    "top_features_per_user": f"""WITH {_FACTS}, e AS (SELECT userid, feature, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd FROM win GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY cost_usd DESC, feature) AS place FROM e) WHERE place <= 2""",
    "daily_cost_series": f"""WITH {_FACTS}, spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day),
s AS (SELECT day, sum(calls) AS calls, sum(cost_usd) AS cost, count(DISTINCT userid) AS users FROM win GROUP BY 1)
SELECT day, CAST(coalesce(calls, 0) AS BIGINT) AS calls, CAST(coalesce(cost, 0) AS DECIMAL(18,6)) AS cost_usd, coalesce(users, 0) AS users FROM spine LEFT JOIN s USING (day)""",
    "cost_totals_reconciled": f"""WITH {_FACTS}, u AS (SELECT userid, sum(cost_usd) AS cost FROM win GROUP BY 1),
w AS (SELECT count(*) AS active_users, CAST(sum(cost) AS DECIMAL(18,6)) AS attributed_usd, CAST(max(cost) AS DECIMAL(18,6)) AS max_usd, count(*) FILTER (cost > 9.99) AS over_plan FROM u),
l AS (SELECT *, CAST(runs_usd + checks_usd AS DECIMAL(18,6)) AS ledger_usd FROM (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,6)) AS runs_usd FROM orders), (SELECT CAST(coalesce(sum(CAST(value AS DECIMAL(14,6))), 0) AS DECIMAL(18,6)) AS checks_usd FROM events WHERE event_type = 'error'))
SELECT *, round(CAST(attributed_usd AS DOUBLE) / active_users, 6) AS avg_usd, round(greatest(CAST(ledger_usd AS DOUBLE) - CAST(attributed_usd AS DOUBLE), 0), 6) AS unattributed_usd,
 round(CAST(attributed_usd AS DOUBLE) / CAST(ledger_usd AS DOUBLE), 6) AS attribution_rate FROM w, l""",
    "call_costs": """WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'google' WHEN 'view' THEN 'anthropic' ELSE 'unknown' END AS provider, event_id % 1000 AS i, event_id % 300 AS o, event_id % 70 AS w, event_id % 500 AS r, event_id % 4 AS s FROM events)
SELECT event_id, provider, CAST(CAST((CASE provider WHEN 'google' THEN i * 75 + o * 375 + s * 1400000 WHEN 'anthropic' THEN i * 100 + o * 500 + w * 100 + r * 100 + s * 1000000 ELSE 0 END + 50) // 100 AS DECIMAL(18,0)) * 0.000001 AS DECIMAL(18,6)) AS cost_usd FROM e""",
    "agent_kpi_periods": f"""WITH {_RUNS}, p AS (SELECT *, CASE WHEN started_at >= TIMESTAMP '1998-06-01' AND started_at < TIMESTAMP '1998-07-01' THEN 'current' WHEN started_at >= TIMESTAMP '1998-05-02' AND started_at < TIMESTAMP '1998-06-01' THEN 'previous' END AS period FROM runs)
SELECT period, count(*) AS runs, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd, CAST(coalesce(sum(items_processed) FILTER (mode NOT LIKE '%-dryrun'), 0) AS BIGINT) AS items, count(*) FILTER (errors > 0) AS failed,
 count(*) FILTER (cost_usd IS NULL) AS unknown_cost, round(CAST(count(*) FILTER (errors > 0) AS DOUBLE) / count(*), 6) AS error_rate FROM p WHERE period IS NOT NULL GROUP BY 1""",
    "agent_day_matrix": """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase,
 count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY 1""",
    "agent_totals": f"""WITH {_RUNS}, reg AS (SELECT * FROM (VALUES ('1-URGENT', 'urgent'), ('2-HIGH', 'high'), ('9-IDLE', 'idle')) t(agent, label)), s AS (SELECT agent, count(*) AS runs, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd FROM runs GROUP BY 1)
SELECT coalesce(reg.agent, s.agent) AS agent, coalesce(label, s.agent) AS label, coalesce(runs, 0) AS runs, CAST(coalesce(cost_usd, 0) AS DECIMAL(18,6)) AS cost_usd FROM reg FULL JOIN s ON reg.agent = s.agent""",
    "latest_run_per_agent": f"""WITH {_RUNS} SELECT agent, id, started_at, {_STATUS.format('1998-07-01 00:30:00')} AS status FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY started_at DESC, id DESC) AS r FROM runs) WHERE r = 1""",
    "run_status": f"""WITH {_RUNS} SELECT id, {_STATUS.format('1998-07-01 00:30:00')} AS status FROM runs""",
    "agent_cards": f"""WITH {_RUNS}, n AS (SELECT *, {_STATUS.format("1998-07-01 00:30:00")} AS st, row_number() OVER (PARTITION BY agent ORDER BY started_at DESC, id DESC) AS r FROM runs), g(agent, label, unit) AS (VALUES ('1-URGENT', 'Urgent', 'items'), ('2-HIGH', 'High', 'rows'), ('3-MEDIUM', 'Medium', 'rows'), ('9-IDLE', 'Idle', 'seeds'))
SELECT g.agent, label, unit, CASE st WHEN 'running' THEN 'running' WHEN 'failed' THEN 'error' WHEN 'interrupted' THEN 'interrupted' ELSE 'idle' END AS status, CASE WHEN st = 'running' THEN started_at END AS started_at, CASE WHEN st <> 'running' THEN coalesce(finished_at, started_at) END AS last_run,
 CASE WHEN st <> 'running' THEN mode END AS last_mode, coalesce(CASE WHEN st <> 'running' THEN items_processed END, 0) AS items_processed, CASE WHEN st <> 'running' THEN cost_usd END AS cost_usd, CASE st WHEN 'failed' THEN CASE WHEN id % 2 = 0 THEN 'order ' || id ELSE 'errors:' || errors END WHEN 'interrupted' THEN 'no totals' END AS error FROM g LEFT JOIN n ON n.agent = g.agent AND r = 1""",
    "run_plans": f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY started_at DESC, id DESC) AS r FROM runs WHERE finished_at IS NOT NULL AND items_processed > 0), e AS (SELECT agent, count(*) AS sampled, avg(CAST(cost_usd AS DOUBLE) / items_processed) AS c, avg(date_diff('second', started_at, finished_at) / items_processed) AS s FROM r WHERE r <= 10 GROUP BY 1),
p AS (SELECT o_orderpriority AS agent, count(*) FILTER (o_orderstatus = 'O') AS count FROM orders GROUP BY 1 UNION ALL SELECT '9-IDLE', 7 UNION ALL SELECT '8-NONE', 0)
SELECT p.agent, count, coalesce(sampled, 0) AS sampled, round(c * count, 4) AS cost_usd, round(greatest(coalesce(s, 0), 5) * count, 2) AS seconds, count = 0 AS nothing_to_do FROM p LEFT JOIN e ON e.agent = p.agent""",
    "estimate_from_last10": f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY started_at DESC, id DESC) AS r FROM runs WHERE finished_at IS NOT NULL AND items_processed > 0)
SELECT agent, count(*) AS sampled, round(avg(CAST(cost_usd AS DOUBLE) / items_processed) * 100, 4) AS cost_usd, round(greatest(avg(date_diff('second', started_at, finished_at) / items_processed), 5.0) * 100, 2) AS seconds FROM r WHERE r <= 10 GROUP BY 1""",
    "run_history": f"""WITH {_RUNS} SELECT id, agent, started_at, mode LIKE '%-dryrun' AS dry_run, {_STATUS.format('1998-07-01')} AS status FROM runs WHERE started_at >= TIMESTAMP '1998-06-01' AND started_at < TIMESTAMP '1998-07-01' ORDER BY started_at DESC, id DESC LIMIT 50""",
    "yield_ranking": """WITH s AS (SELECT p_brand AS seed, count(*) AS found, count(*) FILTER (l_returnflag = 'R') AS dupes, count(*) FILTER (l_returnflag <> 'R') AS added, CAST(sum(CAST(l_tax AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT *, round(CAST(added AS DOUBLE) / nullif(CAST(cost AS DOUBLE), 0), 4) AS added_per_dollar, round(CAST(dupes AS DOUBLE) / found, 4) AS dupe_rate FROM s""",
    "hourly_progress": """SELECT hour, place, event_id FROM (SELECT date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS place, event_id FROM events) WHERE place <= 10""",
}

ORACLES["cost_report"] = f"""SELECT 'total' AS section, 'all' AS key, CAST(NULL AS BIGINT) AS calls, attributed_usd AS cost_usd, concat_ws('|', active_users, over_plan, max_usd, ledger_usd) AS detail FROM ({ORACLES['cost_totals_reconciled']})
UNION ALL SELECT 'user', userid, calls, cost_usd, concat_ws('|', name, status, left_out) FROM ({ORACLES['user_cost_report']}) UNION ALL SELECT 'provider', provider, calls, cost_usd, concat_ws('|', users, models, features) FROM ({ORACLES['provider_report']})
UNION ALL SELECT 'model', concat_ws('/', provider, model), calls, cost_usd, concat_ws('|', users, features) FROM ({ORACLES['model_report']}) UNION ALL SELECT 'day', CAST(day AS VARCHAR), calls, cost_usd, CAST(users AS VARCHAR) FROM ({ORACLES['daily_cost_series']})"""
