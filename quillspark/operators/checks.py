"""Checks of dates on demand: stale rows are asked about and written back, every request is logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates, text
from quillspark.operators.versions import VersionedTable
from quillspark.sources.shared import materialised

LOG = "id long, source string, status string, checked_at timestamp_ntz, version long"


def checked(table: VersionedTable, requests: DataFrame, answers: DataFrame, now: Column, batch: tuple[str, int] | None = None) -> int:
    """One batch of requests (id). A row that was checked within 7 days is answered as it stands (`cached`); for any other the answer
    (id, status) is written back with the time of the check (`check`). Rows that the table lacks are `unknown`. Table and log change as one, and
    once for a batch. Several requests of a batch for one row are one check and one line of the log."""
    if batch is not None and table.done(*batch):
        return table.manifest()["version"]
    # columns that repeat make files small and rows many, so the size of a file is no ground to broadcast it
    rows = table.read().select("id", "status", "last_checked_at", F.lit(True).alias("_there")).hint("merge")
    asked = requests.select("id").distinct().join(rows, "id", "left").join(answers.groupBy("id").agg(F.max("status").alias("answer")).hint("merge"), "id", "left")
    fresh = dates.fresh(F.col("last_checked_at").cast("timestamp"), now.cast("timestamp"))
    source = F.when(F.col("_there").isNull(), "unknown").when(F.coalesce(fresh, F.lit(False)), "cached").otherwise("check")
    status = F.when(F.col("source") == "check", text.known_or_default(F.col("answer"), text.RUN_STATUS)).otherwise(F.col("status"))
    seen = materialised(asked.withColumn("source", source).select("id", "source", status.alias("status")), "checks")
    stamp = F.date_format(now.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    columns = F.create_map(F.lit("status"), F.col("status"), F.lit("last_checked_at"), stamp)
    changes = seen.filter("source = 'check'").select("id", F.lit("patch").alias("op"), F.lit(None).cast(table.read().schema.simpleString()).alias("row"), columns.alias("columns"))
    return table.changed(changes, seen.withColumn("checked_at", now.cast("timestamp_ntz")), batch=batch)
