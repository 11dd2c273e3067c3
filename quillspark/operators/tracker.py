"""Timelines of tracked items: next deadlines, months, to-do windows, statistics, calendar export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import dates, text
from quillspark.operators.numbering import numbered


def with_next(items: DataFrame, as_of: str) -> DataFrame:
    return items.withColumn("next", dates.next_date(F.col("dates"), F.to_date(F.lit(as_of))))


def with_status(items: DataFrame, as_of: str) -> DataFrame:
    """Progress by the dates and by whether the entry runs (`run_status`: running, not_running or unknown)."""
    return items.withColumn("status", dates.progress(F.col("dates"), F.col("was_estimated"), F.col("run_status"), F.to_date(F.lit(as_of))))


def by_deadline(items: DataFrame, as_of: str) -> DataFrame:
    """In progress, then not started, then completed; earlier next dates first, items without one last."""
    rows = with_next(with_status(items, as_of), as_of)
    rank = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "not_started", 1).otherwise(2)
    return numbered(rows, [rank, F.coalesce(F.col("next.date"), F.to_date(F.lit("9999-12-31"))), F.col("id")])


def due(items: DataFrame, as_of: str) -> DataFrame:
    """Items whose next date falls in this month or the next (`soon`), or later (`beyond`); the others are left out."""
    today = F.to_date(F.lit(as_of))
    ahead = dates.month_number(F.col("next.date")) - dates.month_number(today)
    window = F.when(ahead.between(0, 1), "soon").when(ahead > 1, "beyond")
    return with_next(items, as_of).withColumn("due", window).filter("due is not null")


def calendar_rows(items: DataFrame) -> DataFrame:
    """A row for each date, with its index in the item and its month."""
    rows = items.select("id", F.posexplode("dates").alias("index", "d"))
    return rows.select("id", "index", F.col("d.date").alias("date"), F.col("d.label").alias("label"), F.date_format("d.date", "yyyy-MM").alias("month"))


#: Longest name on a calendar, and how much of a longer one stays.
SHORT_NAME, KEPT_NAME = 22, 20


def calendar_entries(items: DataFrame, as_of: str) -> DataFrame:
    """items: id, name, run_status, dates. What a calendar shows: a row for each milestone of the items that may run, with the shortened name."""
    today = F.to_date(F.lit(as_of))
    short = F.when(F.length("name") > SHORT_NAME, F.concat(F.substring("name", 1, KEPT_NAME), F.lit("…"))).otherwise(F.col("name"))
    rows = items.filter(F.coalesce(F.col("run_status") != "not_running", F.lit(True))).select(*(c for c in items.columns if c not in ("dates", "name", "run_status")), short.alias("label"), F.explode(dates.display_milestones(F.col("dates"), today)).alias("m"))
    return rows.select("*", F.col("m.date").alias("date"), F.col("m.label").alias("text"), F.col("m.type").alias("type"), F.col("m.past").alias("past")).drop("m")


def calendar_lanes(items: DataFrame, saved: DataFrame, as_of: str) -> DataFrame:
    """items: id, name, bucket, run_status, dates; saved: id. A lane a bucket without saved items, its months oldest first, and
    whether each is this month or the next; buckets without dates have no lane."""
    today = F.to_date(F.lit(as_of))
    rows = calendar_entries(items.join(saved.select("id").distinct(), "id", "left_anti"), as_of)
    month = F.date_format("date", "yyyy-MM")
    return rows.withColumns({"month": month, "current": month == F.date_format(today, "yyyy-MM"), "next": month == F.date_format(F.add_months(today, 1), "yyyy-MM")})


def months(items: DataFrame) -> DataFrame:
    """Dates and items of each month; items has one row an item, so the first date of a month in it is that item's."""
    each = items.select("id", F.sort_array(F.transform("dates", lambda x: F.date_format(x["date"], "yyyy-MM"))).alias("months"))
    marked = F.transform("months", lambda m, i: F.struct(m.alias("month"), ((i == 0) | ~m.eqNullSafe(F.get("months", i - 1))).alias("first")))
    rows = each.select("id", F.explode(marked).alias("m"))
    return rows.groupBy("m.month").agg(F.count(F.lit(1)).alias("dates"), F.count_if(F.col("m.first") & F.col("id").isNotNull()).alias("items"))


def year_headings(rows: DataFrame) -> DataFrame:
    """Marks the first row of each year in each item's dates."""
    w = W.partitionBy("id").orderBy("index")
    return rows.withColumn("heading", F.coalesce(F.year("date") != F.lag(F.year("date")).over(w), F.lit(True)))


def colours(rows: DataFrame, key: str, slots: int = 16) -> DataFrame:
    """Keys numbered by first appearance; those after the palette share the slot `slots`. Only the first keys of each task are ranked."""
    first = rows.groupBy(key).agg(F.min("pos").alias("pos"))
    palette = first.withColumn("slot", F.dense_rank().over(W.orderBy("pos"))).filter(F.col("slot") <= slots).select(key, (F.col("slot") - 1).alias("slot"))
    return first.join(palette, key, "left").withColumn("slot", F.coalesce("slot", F.lit(slots)))


def status_counts(items: DataFrame, as_of: str) -> DataFrame:
    n = with_status(items, as_of).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("status", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("percent"))


def calendar_text(items: DataFrame) -> DataFrame:
    """An event block for each item's dates; an all-day event ends on the next day."""
    events = calendar_rows(items).withColumn("uid", F.concat_ws("-", "id", "index"))
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    block = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid"), F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp(F.col("date"))), F.concat(F.lit("DTEND;VALUE=DATE:"), stamp(F.date_add("date", 1))), F.concat(F.lit("SUMMARY:"), text.calendar_escaped(F.col("label"))), F.lit("END:VEVENT"))
    return events.withColumn("block", block)


#: How a calendar file begins.
CALENDAR_HEAD = ("BEGIN:VCALENDAR", "VERSION:2.0", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", "X-WR-TIMEZONE:UTC")


def calendar_documents(items: DataFrame) -> DataFrame:
    """(id, document): a calendar file for each item, its events in order; the file of an item is as long as the item's own dates."""
    blocks = calendar_text(items).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("index", "block"))).alias("b"))
    body = F.transform("b", lambda x: x["block"])
    return blocks.select("id", F.concat_ws("\r\n", F.array(*map(F.lit, CALENDAR_HEAD)), body, F.lit("END:VCALENDAR")).alias("document"))


def calendar_ops(items: DataFrame, known: DataFrame) -> DataFrame:
    """What a calendar sync has to do for each date: patch where the event is known and still there, post where it is not known or
    was deleted on the other side, error where the date is missing. known: uid, gone."""
    events = calendar_rows(items).withColumn("uid", F.concat_ws("-", "id", "index")).join(known, "uid", "left")
    op = F.when(F.col("date").isNull(), "error").when(F.coalesce(F.col("gone"), F.lit(True)), "post").otherwise("patch")
    return events.select("uid", op.alias("op"), F.col("date").alias("start_day"), F.date_add("date", 1).alias("end_day"), F.col("label").alias("title"))


def merged(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Items with the values that a later check knows; its nulls change nothing."""
    c = checks.select("id", *(F.col(k).alias(f"_{k}") for k in checks.columns if k != "id"))
    rows = items.join(c, "id", "left")
    return rows.select("id", *(F.coalesce(f"_{k}", k).alias(k) if k in checks.columns else k for k in items.columns if k != "id"))


def split_saved(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visible, saved): no item is lost; an item without a mark is visible."""
    saved = F.coalesce("saved", F.lit(False))
    return items.filter(~saved), items.filter(saved)


def toggled(items: DataFrame, clicks: DataFrame, deleted: DataFrame) -> DataFrame:
    """Items with their saved mark turned once for each click, without the deleted ones."""
    n = clicks.groupBy("id").agg((F.count(F.lit(1)) % 2 == 1).alias("_odd"))
    turned = F.coalesce("saved", F.lit(False)) != F.coalesce("_odd", F.lit(False))
    return items.join(deleted.select("id").distinct(), "id", "left_anti").join(n, "id", "left").withColumn("saved", turned).drop("_odd")


def action_counts(items: DataFrame) -> DataFrame:
    """How many actions are in each state, over all items."""
    return items.select(F.explode("actions").alias("a")).groupBy(F.col("a.state").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def totals(items: DataFrame) -> DataFrame:
    """One row: all tracked items, and the buckets that have any."""
    return items.agg(F.count(F.lit(1)).alias("tracked"), F.countDistinct("bucket").alias("buckets"))


def selection_plan(selected: DataFrame, tracked: DataFrame, buckets: dict[str, str], other: str) -> DataFrame:
    """Selected results by bucket of their kind: how many are tracked already, in any bucket, and how many are to be fetched."""
    known = tracked.select("id").distinct().withColumn("_known", F.lit(True))
    of = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in buckets.items() for x in kv)), F.col("kind")), F.lit(other))
    rows = selected.join(known, "id", "left").groupBy(of.alias("bucket"))
    return rows.agg(F.count_if(F.col("_known").isNotNull()).alias("already"), F.count_if(F.col("_known").isNull()).alias("to_fetch"))
