"""Usage rollups as streams: tumbling days with late data, and a keyed merge that is safe to repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAIN = ("userid", "day", "surface")


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """events: ts (timestamp), userid, surface, cost_usd. Sums per user, UTC day and surface; a batch and a stream give the same."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "userid", "surface").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return out.select("userid", F.to_date("w.start").alias("day"), "surface", "calls", "cost_usd", "first_at", "last_at")


def by_surface(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Sums per UTC day and surface over all users."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "surface").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return out.select(F.to_date("w.start").alias("day"), "surface", "calls", "cost_usd", "first_at", "last_at")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """An extension: activity sessions of each user."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "userid").agg(F.count(F.lit(1)).alias("calls")).select("userid", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "calls")


def usage_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder as a stream of usage events."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("userid"), F.col("event_type").alias("surface"), F.col("value").cast("decimal(14,6)").alias("cost_usd"))


def write_daily(stream: DataFrame, target: str, checkpoint: str, grain: Callable[[DataFrame], DataFrame] = daily):
    """Each micro-batch's changed sums go to a folder of its own, so a batch that runs twice writes the same place twice."""

    def upsert(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/batch={batch:012d}")

    return grain(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()


def read_daily(spark: SparkSession, target: str, key: tuple[str, ...] = GRAIN) -> DataFrame:
    """The newest sums of each key."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/*")
    return rows.groupBy(*key).agg(*(F.max_by(c, "batch").alias(c) for c in ("calls", "cost_usd", "first_at", "last_at")))
