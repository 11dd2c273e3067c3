"""The test tables in the roles that the operators work on: usage, runs, seeds, catalog, tracker, accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.shared import dealt

AS_OF_EVENTS = "2024-01-31"
AS_OF_ORDERS = "1998-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The surface and the model that an event type stands for; one model is blank, as in rows older than that column.
SURFACES = {"click": "gemini", "view": "claude", "purchase": "deadline_check", "error": "claude"}
MODELS = {"click": "Gemini-flash", "view": "claude-small", "purchase": "", "signup": "other-model", "error": ""}


def user_costs(spark: SparkSession, sf_dir: str, as_of: str | None = None, days: int = 30) -> DataFrame:
    """Usage facts at the grain of user, day, surface, feature and model, with tokens and searches. With as_of, only the `days`
    days before that day and the day itself are read: the bounds are on the stored column, so they reach the scan."""
    e = table(spark, sf_dir, "events")
    if as_of is not None:
        end = F.lit(as_of).cast("timestamp_ntz")
        e = e.filter((F.col("ts") >= end - F.make_interval(days=F.lit(days))) & (F.col("ts") < end + F.make_interval(days=F.lit(1))))
    of = lambda known: F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("event_type"))
    return (
        e.groupBy(F.col("user_id").cast("string").alias("userid"), F.to_date("ts").alias("day"), F.col("event_type").alias("feature"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(F.col("value").cast("decimal(14,6)")).cast("decimal(18,6)").alias("cost_usd"),
            F.sum(F.col("event_id") % 1000).alias("input_tokens"),
            F.sum(F.col("event_id") % 300).alias("output_tokens"),
            F.sum(F.col("event_id") % 4).alias("web_searches"),
            F.min("ts").alias("first_at"),
            F.max("ts").alias("last_at"),
        )
        .withColumn("event_type", F.col("feature"))
        .withColumns({"surface": F.coalesce(of(SURFACES), F.col("event_type")), "model": F.coalesce(of(MODELS), F.lit(""))})
        .drop("event_type")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts: only even customers, so that some usage has no account."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    return c.select(F.col("c_custkey").cast("string").alias("userid"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))


def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job runs: orders, with the number of lines as items."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items_processed"))
    o = table(spark, sf_dir, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("agent"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("finished_at"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("errors"),
        F.col("o_totalprice").cast("decimal(18,6)").alias("cost_usd"),
        F.coalesce("items_processed", F.lit(0)).cast("long").alias("items_processed"),
        F.when(F.col("o_orderkey") % 7 == 0, "sweep-dryrun").otherwise("sweep").alias("mode"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows by name: parts, with grades from sizes."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("org"),
        F.col("p_type").alias("type"),
        F.when(F.col("p_retailprice") < 1200, "free").otherwise("paid").alias("price"),
        F.when(F.col("p_partkey") % 9 == 0, None).otherwise(F.col("p_size") % 12).cast("int").alias("grade_min"),
        F.when(F.col("p_partkey") % 8 == 0, None).otherwise(F.col("p_size") % 12 + 3).cast("int").alias("grade_max"),
        (F.col("p_partkey") % 5 != 0).alias("is_active"),
    )


def reviewed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows by text, with a verdict where labels have one."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdict = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "insufficient_data")
    return d.join(l, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("text").alias("summary"), F.col("lang").alias("type"), "source", verdict.alias("moderation_status"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 97).cast("int")).alias("created_at"))


def tracker_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked items: an order with the dates of its lines as an array of structs."""
    l = table(spark, sf_dir, "lineitem")
    l = dealt(l.select("l_orderkey", "l_shipdate", "l_linestatus", "l_returnflag"), l.count(), "l_orderkey")
    one = F.struct(F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("label"), F.col("l_returnflag").alias("type"))
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("dates"), (F.max("l_returnflag") == "R").alias("was_estimated")).withColumn("run_status", F.when(F.col("id") % 23 == 0, "not_running").when(F.col("id") % 19 == 0, "unknown").otherwise("running"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a plan: the last order ends the trial, 30 days before it a paid or granted period ends; some have no status."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("ends_at"))
    status = F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).when(F.col("c_mktsegment") == "AUTOMOBILE", "active").when(F.col("c_mktsegment") == "BUILDING", "trial").when(F.col("c_mktsegment") == "MACHINERY", "beta").when(F.col("c_mktsegment") == "HOUSEHOLD", "canceled").otherwise("past_due")
    ends = F.when(F.col("c_custkey") % 11 != 0, F.col("ends_at"))
    period = F.when(F.col("c_custkey") % 7 != 0, F.col("ends_at") - F.make_interval(days=F.lit(30)))
    return c.join(last, "c_custkey", "left").select(F.col("c_custkey").alias("userid"), status.alias("status"), ends.alias("trial_ends_at"), period.alias("subscription_end_at"))
