"""Curation: review queues, snapshot plans, moderation, keyed changes. Everything is a plan; writing is a thin last step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import urls

MODERATION = ("pending", "approved", "rejected", "duplicate")


def review_queue(rows: DataFrame, which: str = "queue", source: str | None = None, limit: int = 500) -> DataFrame:
    """queue: never reviewed or still open; rejected: refused or duplicate; all. Newest first, by created_at where there is one, then by id."""
    s = F.col("moderation_status")
    keep = {"queue": s.isNull() | s.isin("pending", "insufficient_data"), "rejected": s.isin("rejected", "duplicate"), "all": F.lit(True)}[which]
    rows = rows.filter(keep)
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    order = [F.desc(c) for c in ("created_at", "id") if c in rows.columns]
    return rows.orderBy(*order).limit(max(1, min(limit, 2000)))


def queue_page(rows: DataFrame, catalog: DataFrame, which: str = "queue", source: str | None = None, limit: int = 500) -> DataFrame:
    """A slice of the queue as one answer: its rows, the row that each is a duplicate of (name, whether active), and how many rows the
    answer has in all, of each row's source and of its status. rows: id, source, moderation_status, duplicate_of; catalog: id, name, is_active."""
    page = review_queue(rows, which, source, limit)
    named = catalog.select(F.col("id").cast("string").alias("_of"), F.col("name").alias("survivor"), F.col("is_active").alias("survivor_active"))
    page = page.withColumn("_of", F.nullif(F.trim(F.col("duplicate_of").cast("string")), F.lit(""))).join(named, "_of", "left")
    source_, status = F.coalesce(F.nullif("source", F.lit("")), F.lit("none")), F.coalesce("moderation_status", F.lit("never reviewed"))
    n = lambda *by: F.count(F.lit(1)).over(W.partitionBy(*by))  # noqa: E731  over `limit` rows at most
    return page.withColumns({"source": source_, "moderation_status": status}).withColumns({"total": n(F.lit(0)), "of_source": n("source"), "of_status": n("moderation_status")}).drop("_of")


def queue_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("moderation_status", F.lit("unreviewed")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def due_for_review(rows: DataFrame, as_of: str, days: int, checked: str = "checked_at") -> DataFrame:
    """Never checked, or checked before the cut-off."""
    return rows.filter(F.col(checked).isNull() | (F.col(checked) < F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))))


def sampled(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """A repeatable sample: the n rows with the least hashes."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def snapshot_plan(new: DataFrame, existing: DataFrame, url: str = "url") -> DataFrame:
    """What a commit would do with each new row: insert, duplicate in the file, or already in the catalog. Blank URLs are never duplicates. pos is unique."""
    key = urls.weak(F.col(url))
    keyed = new.withColumn("key", key)
    known = existing.select(urls.weak(F.col(url)).alias("key")).filter("key <> ''").distinct().withColumn("known", F.lit(True))
    # the first place of each key is an aggregate: a window would put all rows of a common key, or all blanks, into one task
    first = keyed.filter("key <> ''").groupBy("key").agg(F.min("pos").alias("_first"))
    verdict = F.when(F.col("key") == "", "insert").when(F.col("known"), "in_catalog").when(F.col("pos") > F.col("_first"), "in_file").otherwise("insert")
    return keyed.join(first, "key", "left").join(known, "key", "left").withColumn("verdict", verdict).drop("known", "_first")


def moderated(rows: DataFrame, decisions: DataFrame, reviewer: str) -> DataFrame:
    """decisions: id, status, duplicate_of. Refused and duplicate rows go inactive; duplicate_of stays only on duplicates; invalid statuses change nothing."""
    d = decisions.filter(F.col("status").isin(*MODERATION)).select("id", F.col("status").alias("_status"), F.col("duplicate_of").alias("_dup"))
    out = rows.join(d, "id", "left")
    hit = F.col("_status").isNotNull()
    return out.select(
        "id",
        F.coalesce("_status", "moderation_status").alias("moderation_status"),
        F.when(hit, F.when(F.col("_status") == "duplicate", F.col("_dup"))).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
        F.when(F.col("_status").isin("rejected", "duplicate"), False).otherwise(F.col("is_active")).alias("is_active"),
        F.when(hit, F.lit(reviewer)).otherwise(F.col("reviewed_by")).alias("reviewed_by"),
    )


def changed(rows: DataFrame, updates: DataFrame, key: str = "id", cleared: str | None = None) -> DataFrame:
    """Rows with an update's values in place; null means leave, and names in the `cleared` array mean set to null."""
    names = [c for c in updates.columns if c not in (key, cleared)]
    u = updates.select(key, *(F.col(c).alias(f"_{c}") for c in names), *([F.col(cleared).alias("_cleared")] if cleared else []))
    out = rows.join(u, key, "left")
    value = lambda c: F.coalesce(f"_{c}", c) if c in names else F.col(c)
    wipe = lambda c: F.coalesce(F.array_contains("_cleared", c), F.lit(False)) if cleared else F.lit(False)
    return out.select(key, *(F.when(wipe(c), F.lit(None)).otherwise(value(c)).alias(c) for c in rows.columns if c != key))


def upserted(rows: DataFrame, new: DataFrame, key: list[str], add: list[str]) -> DataFrame:
    """Keyed merge: sums grow by new values, other columns take the newer value, unseen keys are added."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in rows.columns if c not in key and c not in add]
    return both.groupBy(*key).agg(*(F.sum(c).alias(c) for c in add), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_new")).otherwise(-1)).alias(c) for c in rest)).select(*rows.columns)


def replaced(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keyed merge in which a new row takes the place of the old one whole; of new rows with one key the last position stays."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), "pos").alias("_row")).select(*key, "_row.*")
    return rows.join(last.select(*key), key, "left_anti").unionByName(last.select(*rows.columns))


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def appended(log: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A log with new rows after it; a batch that comes twice adds nothing the second time."""
    return log.unionByName(new.dropDuplicates(key).join(log.select(*key), key, "left_anti").select(*log.columns))


#: The columns of the catalog's export.
EXPORTED = ("id", "name", "org", "type", "price", "grade_min", "grade_max")


def exported(rows: DataFrame) -> DataFrame:
    """(id, json): the active rows of an export, one JSON text each, in order of id."""
    return rows.filter("is_active").orderBy("id").select("id", F.to_json(F.struct(*EXPORTED)).alias("json"))


def url_duplicates(rows: DataFrame, url: str = "url", key: str = "id") -> DataFrame:
    """URL keys that several rows have, with their number and their first and last row."""
    keyed = rows.select(urls.bare(F.col(url)).alias("url_key"), key).filter("url_key <> ''")
    return keyed.groupBy("url_key").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).filter("n > 1")


def name_duplicates(rows: DataFrame, most: int = 5, ranges: int = 64) -> DataFrame:
    """Name keys that several rows have, with their number and the least ids. The ids are limited per range of a name's rows before
    they meet, so a name that many rows share is no one task's list."""
    keyed = rows.withColumn("name_key", urls.name_key(F.col("name")))
    counts = keyed.groupBy("name_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = keyed.select("name_key", "id", F.pmod(F.xxhash64("id"), F.lit(ranges)).alias("_range"))
    least = lambda rows, by: rows.withColumn("_nth", F.row_number().over(W.partitionBy(*by).orderBy("id"))).filter(F.col("_nth") <= most).drop("_nth")
    first = least(least(dealt, ["name_key", "_range"]), ["name_key"])
    listed = first.groupBy("name_key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_ids"))
    return counts.join(listed, "name_key")


def differing(rows: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """(id, old, new): rows whose value in another source is given and differs."""
    o = other.select("id", F.nullif(F.trim(column), F.lit("")).alias("new")).filter("new is not null")
    return rows.select("id", F.col(column).alias("old")).join(o, "id").filter(~F.col("old").eqNullSafe(F.col("new")))


def first_by_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key in input order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def next_ids(rows: DataFrame, existing: DataFrame, prefix: str = "ec", start: int = 18220, order: str = "pos") -> DataFrame:
    """New ids after the largest number that follows the prefix, in order of a column that tells all rows apart; numbered over ranges of the order."""
    from quillspark.operators.numbering import numbered

    top = existing.agg(F.coalesce(F.max(F.regexp_extract("id", f"^{prefix}(\\d+)$", 1).try_cast("long")), F.lit(start)).alias("_top"))  # one row
    placed = numbered(rows, [F.col(order)], "_nth")
    return placed.crossJoin(F.broadcast(top)).withColumn("new_id", F.concat(F.lit(prefix), (F.col("_top") + F.col("_nth")).cast("string"))).drop("_nth", "_top")


def validated_grade(value: Column) -> Column:
    """A whole number from 1 to 13, else null."""
    n = value.try_cast("int")
    return F.when(n.between(1, 13), n)


def within(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(*allowed), value)
