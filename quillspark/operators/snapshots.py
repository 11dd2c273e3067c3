"""The life of a snapshot: listing, age, pending changes, what a commit would write, and the audit row it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates, urls
from quillspark.sources import snapshots as s

STALE_DAYS = 7


def weak_key(e: Column) -> Column:
    """What an entry with a URL is known by."""
    return F.when(F.coalesce(e["url"], F.lit("")) != "", urls.weak(e["url"]))


def pending(agent: Column, e: Column) -> Column:
    """Whether committing an entry would change anything."""
    return (
        F.when(e.isNull(), False)
        .when(agent == "metadata", F.coalesce(F.size(e["changes"]) > 0, F.lit(False)))
        .when(agent == "reviews", ~e["review_status"].eqNullSafe(e["previous_review_status"]))
        .when(agent == "deadline", F.coalesce(e["changed"], F.lit(False)))
        .otherwise(F.coalesce(e["url"], F.lit("")) != "")
    )


def listing(found: s.Snapshots, as_of: str) -> DataFrame:
    """Every snapshot, newest first: instant, age in days, whether it is stale, entries and pending ones. Unreadable files stay, with an error."""
    file = F.col("file")
    ran = F.coalesce(dates.snapshot_time(file).cast("timestamp_ntz"), F.col("modified_at"))
    age = F.floor(F.timestamp_diff("SECOND", F.col("ran_at").cast("timestamp"), F.lit(as_of).cast("timestamp")) / 86400).cast("long")
    held = found.entries.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.count_if(pending(F.col("agent"), F.col("entry"))).alias("pending"))
    return found.files.withColumn("ran_at", F.when(F.col("readable"), ran)).join(held, "file", "left").select(
        "file",
        "agent",
        s.spec_of(F.col("agent"), 3).alias("label"),
        s.spec_of(F.col("agent"), 1).alias("kind"),
        "ran_at",
        file.rlike(r"\d{8}-\d{6}").alias("has_time"),
        age.alias("age_days"),
        (age >= STALE_DAYS).alias("stale"),
        F.coalesce("entries", F.lit(0)).cast("long").alias("entries"),
        F.coalesce("pending", F.lit(0)).cast("long").alias("pending"),
        F.when(F.col("agent") == "scraper", F.nullif(F.regexp_extract(file, "^scrape_review_([a-z]+)_", 1), F.lit(""))).alias("mode"),
        F.when(~F.col("readable"), "unreadable").alias("error"),
    ).orderBy(F.desc_nulls_last("ran_at"), F.desc("file"))


def plan(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """entries (file, agent, position, entry) with `verdict`: applied, skipped_no_change or skipped_duplicate.

    New rows are duplicates when their weak URL stands in the catalog (active or not) or earlier in the file; changes apply where
    an entry has an id and something to change."""
    e, agent = F.col("entry"), F.col("agent")
    inserts = s.spec_of(agent, 1) == "insert"
    rows = entries.withColumn("key", F.when(inserts, weak_key(e)))
    known = catalog.select(urls.weak(F.col("url")).alias("key")).distinct().withColumn("known", F.lit(True))
    first = rows.filter("key is not null").groupBy("file", "key").agg(F.min("position").alias("first"))
    verdict = (
        F.when(inserts & F.col("key").isNull(), "skipped_no_change")
        .when(inserts & (F.col("known") | (F.col("first") < F.col("position"))), "skipped_duplicate")
        .when(inserts, "applied")
        .when((F.coalesce(e["id"], F.lit("")) != "") & pending(agent, e), "applied")
        .otherwise("skipped_no_change")
    )
    keyed = rows.filter("key is not null").join(first, ["file", "key"]).join(known, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    rest = rows.filter("key is null").withColumns({"first": F.col("position"), "known": F.lit(False)})
    return keyed.unionByName(rest).withColumn("verdict", verdict).select("file", "agent", "position", "entry", "verdict")


def commit_counts(planned: DataFrame) -> DataFrame:
    """What a commit of each file does, without doing it."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return planned.groupBy("file", "agent").agg(F.count(F.lit(1)).alias("entries"), *map(count, ("applied", "skipped_no_change", "skipped_duplicate")))


def patches(planned: DataFrame, now: str, keep: list[str] | None = None) -> DataFrame:
    """The columns that each applied change sets: metadata its changes, reviews and deadlines theirs, with the stamps of now. keep: columns to carry along."""
    e, stamp = F.col("entry"), F.lit(now)
    text = lambda x: F.to_json(x)
    of = {
        "metadata": F.map_concat(e["changes"], F.create_map(F.lit("updated_at"), stamp)),
        "reviews": F.create_map(F.lit("review_status"), e["review_status"], F.lit("review_summary"), e["review_summary"], F.lit("review_sources"), text(F.coalesce(e["review_sources"], F.array())), F.lit("last_reviewed_at"), stamp, F.lit("updated_at"), stamp),
        "deadline": F.create_map(F.lit("status"), e["status"], F.lit("important_dates"), text(F.coalesce(e["important_dates"], F.array())), F.lit("was_estimated"), F.coalesce(e["was_estimated"], F.lit(False)).cast("string"), F.lit("important_date_note"), e["important_date_note"], F.lit("dates_last_checked_at"), stamp, F.lit("updated_at"), stamp),
    }
    out = None
    for agent, columns in of.items():
        out = F.when(F.col("agent") == agent, columns) if out is None else out.when(F.col("agent") == agent, columns)
    return planned.filter((F.col("verdict") == "applied") & F.col("agent").isin(*of)).select("file", "agent", e["id"].alias("id"), out.alias("columns"), *(keep or []))


def inserts(planned: DataFrame) -> DataFrame:
    """The new rows of a commit; none is active."""
    return planned.filter("verdict = 'applied' and agent = 'scraper'").select("file", "position", "entry.*").withColumn("is_active", F.lit(False))


def audit_rows(counts: DataFrame, now: str) -> DataFrame:
    """The run that a commit with changes is recorded as: it costs nothing, as the run that made the snapshot was paid."""
    at, insert = F.lit(now).cast("timestamp_ntz"), s.spec_of(F.col("agent"), 1) == "insert"
    return counts.filter("applied > 0").select(
        "agent", F.lit("snapshot-commit").alias("mode"), at.alias("started_at"), at.alias("finished_at"), F.col("entries").alias("items_processed"),
        F.when(insert, 0).otherwise(F.col("applied")).cast("long").alias("items_updated"), F.when(insert, F.col("applied")).otherwise(0).cast("long").alias("items_added"),
        F.lit(0).alias("errors"), F.lit(0).cast("decimal(18,6)").alias("cost_usd"), F.concat(F.lit("Committed snapshot "), "file").alias("notes"),
    )
