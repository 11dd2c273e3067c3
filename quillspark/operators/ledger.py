"""Billed against estimated spend, the agents' summary, and the interactive surfaces' part in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import runs as r

REPORT = "struct<data:array<struct<starting_at:string,results:array<struct<amount:string>>>>>"
MONEY = "decimal(18,4)"


def billed_days(reports: DataFrame, column: str = "report") -> DataFrame:
    """(day, cost_usd) of each bucket of a provider's cost reports in JSON; amounts are cents, and a bucket without results is 0."""
    buckets = reports.select(F.explode(F.from_json(column, REPORT)["data"]).alias("b"))
    cents = F.aggregate(F.coalesce("b.results", F.array()), F.lit(0).cast("decimal(28,6)"), lambda s, x: (s + F.coalesce(x["amount"].try_cast("decimal(20,6)"), F.lit(0))).cast("decimal(28,6)"))
    return buckets.groupBy(F.substring("b.starting_at", 1, 10).cast("date").alias("day")).agg(F.round(F.sum(cents) / 100, 4).cast(MONEY).alias("cost_usd"))


def drift(billed: DataFrame, estimated: DataFrame) -> DataFrame:
    """One row: billed_usd, estimated_usd and their difference, which is null where either is missing or nothing was estimated."""
    b = billed.agg(F.sum("cost_usd").cast(MONEY).alias("billed_usd"))
    e = estimated.agg(F.sum("cost_usd").cast(MONEY).alias("estimated_usd"))
    known = (F.col("estimated_usd") != 0) & F.col("billed_usd").isNotNull()
    return b.crossJoin(F.broadcast(e)).withColumn("drift_usd", F.when(known, F.col("billed_usd") - F.col("estimated_usd")).cast(MONEY))


def check_cost(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row: what the checks of a half-open window cost, and how many were billed; cached ones have no cost."""
    rows = log.filter((F.col("checked_at") >= start) & (F.col("checked_at") < end) & F.col("cost_usd").isNotNull())
    return rows.agg(F.coalesce(F.round(F.sum("cost_usd"), 4), F.lit(0)).cast(MONEY).alias("cost_usd"), F.count(F.lit(1)).alias("billed_checks"))


def agent_summary(runs: DataFrame, log: DataFrame, interactive: list[str], as_of: str, days: int) -> DataFrame:
    """Totals of the current and the previous window. Interactive surfaces add cost only; dry runs cost but change no rows; an
    unfinished run without a cost is unknown spend. Checks count as the app's."""
    end, step = F.lit(as_of).cast("timestamp_ntz"), F.make_interval(days=F.lit(days))
    bounds = {"current": (end - step, end), "previous": (end - step - step, end - step)}
    within = lambda at: F.when((at >= bounds["current"][0]) & (at < end), "current").when((at >= bounds["previous"][0]) & (at < bounds["previous"][1]), "previous")
    app, cost = F.col("agent").isin(*interactive), F.coalesce("cost_usd", F.lit(0))
    job, real = ~app, ~app & ~F.coalesce(r.is_dry_run(), F.lit(False))
    failed = job & (F.coalesce("errors", F.lit(0)) > 0)
    dated = runs.filter((F.col("started_at") >= bounds["previous"][0]) & (F.col("started_at") < end)).withColumn("period", within(F.col("started_at")))
    sums = dated.groupBy("period").agg(
        F.count_if(job).alias("runs"),
        F.sum(F.when(job, cost).otherwise(0)).cast(MONEY).alias("agent_cost_usd"),
        F.sum(F.when(app, cost).otherwise(0)).cast(MONEY).alias("_app"),
        F.sum(F.when(real, F.coalesce("items_updated", F.lit(0))).otherwise(0)).cast("long").alias("rows_updated"),
        F.sum(F.when(real, F.coalesce("items_added", F.lit(0))).otherwise(0)).cast("long").alias("rows_added"),
        F.sum(F.when(job, F.coalesce("errors", F.lit(0))).otherwise(0)).cast("long").alias("errors"),
        F.count_if(failed).alias("failed_runs"),
        F.count_if(job & F.coalesce(r.is_dry_run(), F.lit(False))).alias("dry_runs"),
        F.count_if(job & F.col("cost_usd").isNull() & F.col("finished_at").isNull()).alias("unknown_cost_runs"),
    )
    checks = log.filter((F.col("checked_at") >= bounds["previous"][0]) & (F.col("checked_at") < end)).withColumn("period", within(F.col("checked_at")))
    checks = checks.groupBy("period").agg(F.sum("cost_usd").cast(MONEY).alias("deadline_cost_usd"), F.count("cost_usd").alias("billed_checks"))
    both = runs.sparkSession.createDataFrame([("current",), ("previous",)], "period string").join(sums, "period", "left").join(checks, "period", "left")
    zero = {"agent_cost_usd": 0, "_app": 0, "deadline_cost_usd": 0, "billed_checks": 0, "runs": 0, "rows_updated": 0, "rows_added": 0, "errors": 0, "failed_runs": 0, "dry_runs": 0, "unknown_cost_runs": 0}
    both = both.fillna(zero)
    rate = F.round(F.coalesce(F.try_divide(F.col("failed_runs").cast("double"), F.col("runs")), F.lit(0.0)), 3)
    return both.withColumn("app_cost_usd", (F.col("_app") + F.col("deadline_cost_usd")).cast(MONEY)).withColumn("cost_usd", (F.col("agent_cost_usd") + F.col("app_cost_usd")).cast(MONEY)).withColumn("error_rate", rate).drop("_app")


def interactive_totals(runs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """surfaces: agent, name. Calls and cost of each, zero where idle."""
    sums = runs.groupBy("agent").agg(F.sum("items_processed").alias("calls"), F.sum("cost_usd").alias("cost"))
    return surfaces.join(sums, "agent", "left").select("agent", "name", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.coalesce("cost", F.lit(0)).cast(MONEY).alias("cost_usd"))


def day_agent_series(runs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Cost, runs and changed rows of each day and agent; days without runs are rows without an agent and zeros."""
    end = F.to_date(F.lit(as_of))
    spine = runs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days), F.date_sub(end, 1))).alias("day"))
    stop = F.lit(as_of).cast("timestamp_ntz")
    rows = runs.filter((F.col("started_at") >= stop - F.make_interval(days=F.lit(days))) & (F.col("started_at") < stop))
    sums = rows.groupBy(F.to_date("started_at").alias("day"), "agent").agg(F.sum("cost_usd").cast(MONEY).alias("cost"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("items_updated", F.lit(0)) + F.coalesce("items_added", F.lit(0))).alias("changed"))
    return spine.join(sums, "day", "left").select("day", "agent", F.coalesce("cost", F.lit(0)).cast(MONEY).alias("cost_usd"), F.coalesce("n", F.lit(0)).cast("long").alias("runs"), F.coalesce("changed", F.lit(0)).cast("long").alias("rows"))


def progress(rows: DataFrame, stamp: str, total: int) -> DataFrame:
    """One row: how many rows carry a stamp, the whole percentage of `total`, and the first and the last stamp."""
    done = rows.filter(F.col(stamp).isNotNull())
    return done.agg(F.count(F.lit(1)).alias("done"), F.min(stamp).alias("first_at"), F.max(stamp).alias("last_at")).select("done", F.coalesce(F.floor(F.try_divide(F.col("done") * 100, F.lit(total))), F.lit(0)).cast("long").alias("percent"), "first_at", "last_at")


def projected(sample: DataFrame, population: DataFrame, cost: str = "cost_usd") -> DataFrame:
    """One row: the mean cost of sampled rows, carried over to all rows of a population."""
    mean = sample.agg(F.count(F.lit(1)).alias("sampled"), F.avg(F.col(cost).cast("double")).alias("mean"))
    size = population.agg(F.count(F.lit(1)).alias("population"))
    return mean.crossJoin(F.broadcast(size)).select("sampled", "population", F.round(F.col("mean"), 6).alias("mean_usd"), F.round(F.col("mean") * F.col("population"), 4).alias("projected_usd"))
