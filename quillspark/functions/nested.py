"""Arrays and maps of an entry: dates, tags, sources, requirements, action items, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What there is to do for an entry of which nothing more is known.
GENERIC_ACTIONS = (
    "Confirm the exact deadline and requirements on the official site",
    "Gather required materials (transcripts, recommendation letters, etc.)",
    "Complete and submit the application",
)
#: The state that follows each state of an action.
NEXT_STATE = {"not_started": "in_progress", "in_progress": "completed", "completed": "not_started"}
DATE = "struct<date:string,label:string,type:string>"
ACTION = "struct<id:string,text:string,url:string,state:string>"


def _named(date: Column, label: Column, kind: Column) -> Column:
    return F.struct(date.alias("date"), label.alias("label"), kind.alias("type"))


def unified_dates(dates: Column, opens: Column, deadlines: Column) -> Column:
    """An entry's dates; for one of the older shape its opening date and its deadlines (date, label) as such."""
    first = F.when(F.coalesce(opens, F.lit("")) != "", F.array(_named(opens, F.lit("Opens"), F.lit("opens")))).otherwise(F.array().cast(f"array<{DATE}>"))
    dated = F.filter(F.coalesce(deadlines, F.array()), lambda d: F.coalesce(d["date"], F.lit("")) != "")
    return F.coalesce(dates, F.concat(first, F.transform(dated, lambda d: _named(d["date"], F.coalesce(F.nullif(d["label"], F.lit("")), F.lit("Deadline")), F.lit("deadline")))))


def valid_dates(dates: Column) -> Column:
    """Entries that have a date, with the default label and type, in order of date."""
    kept = F.filter(F.coalesce(dates, F.array()), lambda d: F.coalesce(d["date"], F.lit("")) != "")
    return F.array_sort(F.transform(kept, lambda d: _named(d["date"], F.coalesce(F.nullif(d["label"], F.lit("")), F.lit("Date")), F.coalesce(F.nullif(d["type"], F.lit("")), F.lit("deadline")))))


def clean_tags(tags: Column, most: int = 5) -> Column:
    """Trimmed tags that are not blank, at most `most`; null without any."""
    kept = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.when(F.size(kept) > 0, F.slice(kept, 1, most))


def clean_sources(sources: Column, most: int = 3) -> Column:
    """Sources that have a URL, at most `most`."""
    return F.slice(F.filter(F.coalesce(sources, F.array()), lambda s: F.coalesce(s["url"], F.lit("")) != ""), 1, most)


def requirements(items: Column, most: int = 5) -> Column:
    return F.slice(items, 1, most)


def action_items(key: Column, actions: Column, most: int = 5) -> Column:
    """The first actions (text, url) with an id of their own, none of them started."""
    one = lambda a, i: F.struct(F.concat(key, F.lit("-t"), i.cast("string")).alias("id"), a["text"].alias("text"), F.nullif(a["url"], F.lit("")).alias("url"), F.lit("not_started").alias("state"))
    return F.transform(F.slice(F.coalesce(actions, F.array()), 1, most), one)


def with_generic_actions(key: Column, actions: Column) -> Column:
    """The actions, or the generic ones where there are none."""
    generic = F.transform(F.array(*map(F.lit, GENERIC_ACTIONS)), lambda t, i: F.struct(F.concat(key, F.lit("-gt"), i.cast("string")).alias("id"), t.alias("text"), F.lit(None).cast("string").alias("url"), F.lit("not_started").alias("state")))
    return F.when(F.coalesce(F.size(actions), F.lit(0)) <= 0, generic).otherwise(actions)


def cycled(actions: Column, clicked: Column) -> Column:
    """Actions with the state of one moved on; an unknown state starts anew."""
    after = F.create_map(*(F.lit(x) for kv in NEXT_STATE.items() for x in kv))
    return F.transform(actions, lambda a: F.when(a["id"] == clicked, a.withField("state", F.coalesce(F.element_at(after, a["state"]), F.lit("not_started")))).otherwise(a))


def without_empty(values: Column) -> Column:
    """A map without its null and empty values."""
    return F.map_filter(values, lambda _, v: F.coalesce(v, F.lit("")) != "")


def overlaid(defaults: Column, overrides: Column) -> Column:
    """Defaults with the overrides that are not null in their place."""
    given = F.map_filter(overrides, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)), given)


def rotated(items: tuple[str, ...], turn: Column, k: int = 3) -> Column:
    """The turn-th set of k items of a list that wraps; turns start over after all sets."""
    n = len(items)
    start = F.pmod(turn, F.lit(-(-n // k))) * k
    listed = F.array(*map(F.lit, items))
    return F.array(*(F.get(listed, F.pmod(start + i, F.lit(n)).cast("int")) for i in range(k)))
