"""State that runs out: caches with a time to live, tokens for one use, tails of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.sources.shared import materialised


def read_through(requests: DataFrame, days: int = 7) -> DataFrame:
    """requests: key, ts, id. Whether each is answered from the cache or fetched: a fetch holds for `days` days from its time on.

    Each round finds every key's next fetch, the first request that the last one no longer covers, so there are no more rounds
    than times to live in the span of the requests, and a hot key is only ever aggregated. Requests of one time: the least id fetches."""
    rows = materialised(requests.select("key", "id", "ts"), "requests")
    step = F.make_interval(days=F.lit(days))
    last = materialised(rows.groupBy("key").agg(F.min("ts").alias("at")), "fetches")
    every = last
    while True:
        following = rows.join(last, "key").filter(F.col("ts") >= F.col("at") + step).groupBy("key").agg(F.min("ts").alias("at"))
        last = materialised(following, "fetches")
        if last.isEmpty():
            break
        every = every.unionByName(last)
    first = rows.join(every.withColumnRenamed("at", "ts"), ["key", "ts"]).groupBy("key", "ts").agg(F.min("id").alias("id")).withColumn("_f", F.lit("fetch"))
    return rows.join(first, ["key", "ts", "id"], "left").select("id", "key", "ts", F.coalesce("_f", F.lit("cached")).alias("source"))


def tokens_taken(events: DataFrame, minutes: int = 5) -> DataFrame:
    """events: token, ts, id, kind (mint or take). Verdict of each take: ok, used, expired or unknown. A token is minted once."""
    minted = events.filter("kind = 'mint'").groupBy("token").agg(F.min("ts").alias("minted_at"))
    takes = events.filter("kind = 'take'").join(minted, "token", "left")
    alive = (F.col("ts") >= F.col("minted_at")) & (F.col("ts") <= F.col("minted_at") + F.make_interval(mins=F.lit(minutes)))
    first = takes.filter(alive).groupBy("token").agg(F.min(F.struct("ts", "id")).alias("first"))
    verdict = F.when(F.col("minted_at").isNull() | (F.col("ts") < F.col("minted_at")), "unknown").when(~alive, "expired").when(F.struct("ts", "id") == F.col("first"), "ok").otherwise("used")
    return takes.join(first, "token", "left").select("id", "token", verdict.alias("verdict"))


def log_tail(lines: DataFrame, since: DataFrame, kept: int = 500) -> DataFrame:
    """lines: agent, line_no; since: agent, since. Of each agent's newest `kept` lines those from `since` on, and how many are lost.

    The newest lines are limited per task before they meet."""
    newest = lines.withColumn("_nth", F.row_number().over(W.partitionBy("agent").orderBy(F.desc("line_no")))).filter(F.col("_nth") <= kept)
    asked = lines.join(since, "agent", "right").filter(F.coalesce(F.col("line_no") >= F.col("since"), F.lit(True)))
    n = asked.groupBy("agent").agg(F.count("line_no").alias("asked"))
    given = newest.join(since, "agent").filter(F.col("line_no") >= F.col("since")).groupBy("agent").agg(F.count(F.lit(1)).alias("given"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return since.join(n, "agent", "left").join(given, "agent", "left").select("agent", F.coalesce("given", F.lit(0)).alias("given"), (F.coalesce("asked", F.lit(0)) - F.coalesce("given", F.lit(0))).alias("dropped"), "first_line", "last_line")
