"""Job runs: status, windows, latest run, estimates, yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.costs import TOTAL

RUN_CAP_SECONDS = 3600


def status(as_of: str, cap: int = RUN_CAP_SECONDS) -> Column:
    """First of: failed, success, interrupted (no start), running (younger than the cap), interrupted."""
    age = F.timestamp_diff("SECOND", F.col("started_at").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    return (
        F.when(F.coalesce(F.col("errors"), F.lit(0)) > 0, "failed")
        .when(F.col("finished_at").isNotNull(), "success")
        .when(F.col("started_at").isNull(), "interrupted")
        .when(age < cap, "running")
        .otherwise("interrupted")
    )


def is_dry_run() -> Column:
    return F.col("mode").endswith("-dryrun")


def kpi_periods(runs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Totals of the current and the previous half-open window, side by side in rows."""
    end = F.lit(as_of).cast("timestamp_ntz")
    step = F.make_interval(days=F.lit(days))
    period = F.when((F.col("started_at") >= end - step) & (F.col("started_at") < end), "current").when((F.col("started_at") >= end - step - step) & (F.col("started_at") < end - step), "previous")
    real = ~is_dry_run()
    return (
        runs.withColumn("period", period)
        .filter("period is not null")
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum("cost_usd").cast(TOTAL).alias("cost_usd"),
            F.coalesce(F.sum(F.when(real, F.col("items_processed"))), F.lit(0)).cast("long").alias("items"),
            F.count_if(F.col("errors") > 0).alias("failed"),
            F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost"),
            F.round(F.try_divide(F.count_if(F.col("errors") > 0).cast("double"), F.count(F.lit(1))), 6).alias("error_rate"),
        )
    )


def agent_totals(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Totals of every registered agent, zero for idle ones; unregistered agents keep their own name."""
    sums = runs.groupBy("agent").agg(F.count(F.lit(1)).alias("runs"), F.sum("cost_usd").cast(TOTAL).alias("cost_usd"))
    return registry.join(sums, "agent", "full").select("agent", F.coalesce("label", "agent").alias("label"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), F.coalesce("cost_usd", F.lit(0)).cast(TOTAL).alias("cost_usd"))


def newest(runs: DataFrame, k: int) -> DataFrame:
    """Each agent's k newest runs."""
    w = W.partitionBy("agent").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def estimate(runs: DataFrame, count: int, min_delay: float, k: int = 10) -> DataFrame:
    """Cost and time of handling `count` items, from the means of each agent's newest k finished runs with items."""
    done = newest(runs.filter("finished_at is not null and items_processed > 0"), k)
    each = F.col("cost_usd").cast("double") / F.col("items_processed")
    seconds = F.timestamp_diff("SECOND", F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp")) / F.col("items_processed")
    return done.groupBy("agent").agg(F.count(F.lit(1)).alias("sampled"), F.round(F.avg(each) * count, 4).alias("cost_usd"), F.round(F.greatest(F.avg(seconds), F.lit(float(min_delay))) * count, 2).alias("seconds"))


def plans(runs: DataFrame, previews: DataFrame, min_delay: float, k: int = 10) -> DataFrame:
    """previews: agent, count (what a run would handle). Each with the estimate for it in one answer; without a finished run to go by, the
    least delay is all that is known of the time, and nothing of the cost."""
    one = estimate(runs, 1, 0.0, k).select("agent", "sampled")
    done = newest(runs.filter("finished_at is not null and items_processed > 0"), k)
    seconds = F.timestamp_diff("SECOND", F.col("started_at").cast("timestamp"), F.col("finished_at").cast("timestamp")) / F.col("items_processed")
    each = done.groupBy("agent").agg(F.avg(F.col("cost_usd").cast("double") / F.col("items_processed")).alias("_cost"), F.avg(seconds).alias("_seconds"))
    rows = previews.join(one, "agent", "left").join(each, "agent", "left")
    n = F.col("count")
    return rows.select("agent", "count", F.coalesce("sampled", F.lit(0)).cast("long").alias("sampled"), F.round(F.col("_cost") * n, 4).alias("cost_usd"), F.round(F.greatest(F.coalesce("_seconds", F.lit(0.0)), F.lit(float(min_delay))) * n, 2).alias("seconds"), (n == 0).alias("nothing_to_do"))


def cards(runs: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """registry: agent, label, unit. A card for each registered agent: what it does now (running, error, interrupted, idle), and its newest
    run. A running one shows only since when; an error says `notes`, or how many errors there were."""
    last = newest(runs, 1).withColumn("_status", status(as_of))
    row = registry.join(last, "agent", "left")
    running = F.col("_status") == "running"
    idle = lambda c, kind: F.when(~F.coalesce(running, F.lit(False)), c).cast(kind)
    failed = F.coalesce(F.nullif(F.col("notes"), F.lit("")), F.concat(F.lit("errors:"), F.col("errors").cast("string")))
    return row.select(
        "agent", "label", "unit", F.when(running, "running").when(F.col("_status") == "failed", "error").when(F.col("_status") == "interrupted", "interrupted").otherwise("idle").alias("status"),
        F.when(running, F.col("started_at")).alias("started_at"), idle(F.coalesce("finished_at", "started_at"), "timestamp_ntz").alias("last_run"), idle(F.col("mode"), "string").alias("last_mode"),
        F.coalesce(idle(F.col("items_processed"), "long"), F.lit(0)).alias("items_processed"), idle(F.col("cost_usd"), "decimal(18,6)").alias("cost_usd"),
        F.when(F.col("_status") == "failed", failed).when(F.col("_status") == "interrupted", "no totals").alias("error"),
    )


def seed_yield(seeds: DataFrame) -> DataFrame:
    """Rows added per dollar and the share of duplicates, null where nothing was spent or found."""
    return seeds.select(
        "*",
        F.round(F.try_divide(F.col("added").cast("double"), F.col("cost").cast("double")), 4).alias("added_per_dollar"),
        F.round(F.try_divide(F.col("dupes").cast("double"), F.col("found")), 4).alias("dupe_rate"),
    )


def hourly_first(rows: DataFrame, ts: str, key: str, k: int = 10) -> DataFrame:
    """The first k rows of each hour."""
    hour = F.date_trunc("hour", F.col(ts))
    w = W.partitionBy("hour").orderBy(ts, key)
    return rows.withColumn("hour", hour).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
