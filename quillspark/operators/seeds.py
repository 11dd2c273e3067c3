"""Search seeds: loading, choosing, creating, counting what they yield."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODES = ("national", "seattle")


def loaded(seeds: DataFrame, mode: str, include_disabled: bool = False) -> DataFrame:
    rows = seeds.filter(F.col("mode") == mode)
    return (rows if include_disabled else rows.filter("is_enabled")).orderBy("sort_order", "id")


def not_present(new: DataFrame, seeds: DataFrame) -> DataFrame:
    """New seeds whose mode and trimmed angle are not there yet."""
    key = [F.col("mode").alias("mode"), F.trim(F.coalesce("angle", F.lit(""))).alias("_angle")]
    known = seeds.select(*key).distinct()
    return new.withColumn("_angle", key[1]).join(known, ["mode", "_angle"], "left_anti").drop("_angle").select(*new.columns)


def chosen_by_id(seeds: DataFrame, wanted: list[int]) -> DataFrame:
    """The seeds of a list of ids, in the list's order and with its repeats; ids that are not there have a null `found`."""
    asked = seeds.sparkSession.createDataFrame([(i, x) for i, x in enumerate(wanted)], "place int, id long")
    return asked.join(seeds.withColumn("found", F.lit(True)), "id", "left").orderBy("place")


def chosen_by_place(seeds: DataFrame, wanted: list[int]) -> DataFrame:
    """The seeds at places of the list (mode, sort_order, id); places out of range have none. Seeds are a short, hand-kept list."""
    asked = seeds.sparkSession.createDataFrame([(i, x) for i, x in enumerate(wanted)], "place int, at int")
    listed = seeds.withColumn("at", F.row_number().over(W.partitionBy("mode").orderBy("sort_order", "id")) - 1)
    return asked.join(listed, "at").orderBy("place")


def created(new: DataFrame, seeds: DataFrame) -> DataFrame:
    """New seeds with a code for what is wrong (blank: mode, category or angle; unknown_mode); a missing sort_order follows the greatest of its mode, in order of pos."""
    top = seeds.groupBy("mode").agg(F.max("sort_order").alias("_top"))
    blank = F.greatest(*(F.coalesce(F.trim(c), F.lit("")) == "" for c in ("mode", "category", "angle")))
    error = F.when(blank, "blank").when(~F.col("mode").isin(*MODES), "unknown_mode")
    rows = new.withColumn("error", error)
    nth = F.row_number().over(W.partitionBy("mode", F.col("error").isNull() & F.col("sort_order").isNull()).orderBy("pos"))
    return rows.withColumn("_nth", nth).join(top, "mode", "left").withColumn("sort_order", F.when(F.col("error").isNull(), F.coalesce("sort_order", F.coalesce("_top", F.lit(-1)) + F.col("_nth"))).otherwise(F.col("sort_order"))).drop("_nth", "_top")


def per_mode(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def with_results(seeds: DataFrame, results: DataFrame) -> DataFrame:
    """Lifetime totals grown by what runs found; results: id, found, added, dupes, cost, ran_at (a row for each run)."""
    sums = results.groupBy("id").agg(F.count(F.lit(1)).alias("_runs"), *(F.sum(c).alias(f"_{c}") for c in ("found", "added", "dupes", "cost")), F.max("ran_at").alias("_at"))
    grow = {"total_runs": "_runs", "total_found": "_found", "total_added": "_added", "total_dupes": "_dupes", "total_cost": "_cost"}
    out = seeds.join(sums, "id", "left")
    value = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(grow[c], F.lit(0))).cast(seeds.schema[c].dataType).alias(c)
    return out.select(*(value(c) if c in grow else F.coalesce("_at", c).alias(c) if c == "last_run_at" else F.col(c) for c in seeds.columns))


def tally(found: DataFrame) -> DataFrame:
    """One row a run: what became of the rows it found, by verdict (added, duplicate, invalid, error), and whether it searched at all."""
    count = lambda v, n: F.count_if(F.col("verdict") == v).alias(n)
    return found.groupBy("run").agg(F.count(F.lit(1)).alias("found"), count("added", "added"), count("duplicate", "dupes"), count("invalid", "invalid"), count("error", "errors"), (F.sum(F.coalesce("web_searches", F.lit(0))) == 0).alias("silent"))
