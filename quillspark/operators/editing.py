"""Edits of catalog rows: activation, whitelisted edits of queued rows, cleaned updates, survivors of duplicates, new submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import urls
from quillspark.sources.shared import materialised

#: The columns that may be edited in the queue, and how their values are read.
EDITABLE = {
    "name": "text", "org": "text", "summary": "text", "url": "text", "type": "text", "category": "text", "price": "text", "cost": "text",
    "state": "text", "location": "text", "intl": "text", "season": "text", "eligibility": "text", "grade_min": "int", "grade_max": "int", "subject_tags": "list",
}

#: The catalog's codes.
TYPES = ("Program", "Internship", "Competition", "Research", "Journal", "Conference", "Volunteer")


def activated(rows: DataFrame, ids: DataFrame, now: str, active: bool = True) -> DataFrame:
    """Rows with is_active set for the ids; switching on is a verdict and is stamped as one."""
    hit = F.col("_hit").isNotNull()
    known = ids.select(F.trim(F.col("id").cast("string")).alias("_id")).filter("_id <> ''").distinct().withColumn("_hit", F.lit(True))
    stamps = {"is_active": F.lit(active), "updated_at": F.lit(now).cast("timestamp_ntz")}
    if active:
        stamps |= {"moderation_status": F.lit("approved"), "reviewed_by": F.lit("admin-console"), "reviewed_at": F.lit(now).cast("timestamp_ntz")}
    out = rows.join(known, rows["id"].cast("string") == known["_id"], "left")
    return out.select(*(F.when(hit, stamps[c]).otherwise(F.col(c)).alias(c) if c in stamps else c for c in rows.columns))


def coerced(key: Column, value: Column) -> Column:
    """(text, number, list, error) of an edited value: blank is null, grades are whole numbers from 1 to 13, lists are split at commas."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in EDITABLE.items() for x in kv)), key)
    clean = F.nullif(F.trim(F.coalesce(value, F.lit(""))), F.lit(""))
    whole = clean.rlike(r"^[+-]?\d+$")
    n = F.when(whole, clean.try_cast("int"))
    dash = clean.isNull() | (clean == "—")
    error = F.when(kind.isNull(), F.concat(F.lit("not_editable:"), key)).when((kind == "int") & ~dash & ~F.coalesce(whole, F.lit(False)), F.concat(F.lit("not_whole:"), key)).when((kind == "int") & ~dash & ~F.coalesce(n.between(1, 13), F.lit(False)), F.concat(F.lit("no_grade:"), key))
    parts = F.filter(F.transform(F.split(clean, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(F.when(kind == "text", clean).alias("text"), F.when(kind == "int", n).alias("number"), F.when((kind == "list") & (F.size(parts) > 0), parts).alias("list"), error.alias("error"))


def edit_verdicts(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """edits: id, fields (map of texts). (id, error, values): a code for the first reason against an edit, else its values.

    Only queued rows that exist are edited; a name and a URL stay; the URL has a scheme, the type is known, a state has two
    letters, and grades are in order."""
    unknown = F.array_sort(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, EDITABLE))))
    e = edits.join(rows.select(F.col("id"), F.col("is_active").alias("_active"), F.lit(True).alias("_known")), "id", "left")
    e = e.withColumn("values", F.transform_values("fields", lambda k, v: coerced(k, v))).withColumn("unknown", unknown)
    errors = F.filter(F.transform(F.array_sort(F.map_keys("values")), lambda k: F.element_at(F.col("values"), k)["error"]), lambda x: x.isNotNull())
    has = lambda k: F.map_contains_key("fields", k)
    text = lambda k: F.element_at(F.col("values"), F.lit(k))["text"]
    number = lambda k: F.element_at(F.col("values"), F.lit(k))["number"]
    error = (
        F.when(F.size("unknown") > 0, F.concat(F.lit("not_editable:"), F.array_join("unknown", ",")))
        .when(F.col("_known").isNull(), "no_row")
        .when(F.coalesce(F.col("_active"), F.lit(False)), "live_row")
        .when(F.size(errors) > 0, F.get(errors, F.lit(0)))
        .when(has("name") & text("name").isNull(), "blank:name")
        .when(has("url") & text("url").isNull(), "blank:url")
        .when(text("type").isNotNull() & ~text("type").isin(*TYPES), "unknown_type")
        .when(text("url").isNotNull() & ~F.lower(text("url")).rlike("^https?://"), "no_scheme:url")
        .when(text("state").isNotNull() & (F.length(text("state")) != 2), "no_code:state")
        .when(number("grade_min") > number("grade_max"), "grades_reversed")
        .when(F.size("fields") <= 0, "no_change")
    )
    return e.withColumn("error", error).select("id", "error", F.when(F.col("error").isNull(), F.col("values")).alias("values"))


def edited(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with the values of edits that have no error; a blank value sets null."""
    v = verdicts.filter("error is null").select(F.col("id").alias("_id"), "values")
    out = rows.join(v, rows["id"] == v["_id"], "left")
    part = {"text": "text", "int": "number", "list": "list"}
    value = lambda c: F.when(F.coalesce(F.map_contains_key("values", c), F.lit(False)), F.element_at(F.col("values"), F.lit(c))[part[EDITABLE[c]]].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return out.select(*(value(c) if c in EDITABLE else F.col(c) for c in rows.columns))


def with_survivor(queue: DataFrame, rows: DataFrame) -> DataFrame:
    """Queue rows with name, url and state of the row that they are a duplicate of."""
    kept = rows.select(F.col("id").cast("string").alias("_id"), F.struct("name", "url", "is_active").alias("survivor"))
    of = F.nullif(F.trim(F.col("duplicate_of").cast("string")), F.lit(""))
    return queue.withColumn("_of", of).join(kept, F.col("_of") == kept["_id"], "left").drop("_of", "_id")


def clean_update(info: dict[str, Column], enums: dict[str, tuple[str, ...]], vocabulary: tuple[str, ...]) -> Column:
    """A sparse map of what an answer may change: trimmed texts that are not blank, known codes, grades 9 to 12, tags of the vocabulary."""
    out = []
    for name, value in info.items():
        if name in enums:
            value = F.when(value.isin(*enums[name]), value)
        elif name in ("grade_min", "grade_max"):
            value = F.when(value.between(9, 12), value).cast("string")
        elif name == "subject_tags":
            known = F.filter(value, lambda t: t.isin(*vocabulary))
            value = F.when(F.size(known) > 0, F.array_join(known, "|"))
        else:
            value = F.nullif(F.trim(value), F.lit(""))
        out += [F.lit(name), value]
    return F.map_filter(F.create_map(*out), lambda _, v: v.isNotNull())


def differs(pairs: list[tuple[str, str]]) -> Column:
    """Whether any column differs from its counterpart; two nulls do not."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ~F.col(a).eqNullSafe(F.col(b))
    return out


#: The type of a section's entries.
SECTION_TYPES = {"summerPrograms": "Program", "internships": "Internship", "researchCompetitions": "Research", "pureCompetitions": "Competition", "conferences": "Conference", "journals": "Journal"}


def submission_rows(submitted: DataFrame, now: str) -> DataFrame:
    """New rows of users' submissions: hidden, waiting for review, with quality notes and only the details that are there."""
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.element_at(F.create_map(*(F.lit(x) for kv in SECTION_TYPES.items() for x in kv)), F.col("section")), F.lit("Program"))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    detail = F.create_map(F.lit("apply_url"), F.coalesce(blank("apply_url"), F.col("url")), F.lit("note"), blank("note"), F.lit("section"), blank("section"))
    return submitted.select(
        F.concat(F.lit("us"), F.col("id").cast("string")).alias("id"), F.trim("name").alias("name"), "url", kind.alias("type"), F.lit(False).alias("is_active"),
        F.lit("pending_review").alias("moderation_status"), F.lit(now).cast("timestamp_ntz").alias("submitted_at"), urls.quality_flags(F.col("url")).alias("quality_flags"),
        F.map_filter(detail, lambda _, v: v.isNotNull()).alias("submission_payload"),
    )


#: A slug that could be another one with a number behind it.
_NUMBERED = r"^(.+)-([2-9]|[1-9]\d{1,8})$"


def unique_slugs(rows: DataFrame, slug: Column, order: str = "pos", blank: str = "opportunity", taken: DataFrame | None = None) -> DataFrame:
    """Rows with an id of their own from their slug, as if given one after another: the slug itself, else with -2, -3 and so on, the
    first that no earlier row and no id of `taken` (a table with `id`) has. Runs jobs when it is called. `order` tells all rows apart.

    Only a slug that is another one with a number behind it can meet an id made from that one. Such slugs are settled from the
    shorter to the longer, a round for each further number: whichever comes first in order, the row whose own slug it is or the row that
    would get it by its number, has the id; numbers that are gone are left out for all rows after. Rows are numbered over ranges of
    the order, so a slug that many rows share is not one task's work; a slug's numbered slugs, one row each, are."""
    from quillspark.operators.numbering import numbered

    keyed = rows.withColumn("_slug", F.when(slug == "", blank).otherwise(slug)).withColumn("_given", F.lit(1))
    if taken is not None:
        keyed = keyed.unionByName(taken.select(F.col("id").alias("_slug"), F.lit(0).alias("_given")).distinct(), allowMissingColumns=True)
    keyed = numbered(keyed, [F.col("_slug"), F.col("_given"), F.col(order)], "_all")
    named = F.regexp_extract("_slug", _NUMBERED, 1)
    number = F.nullif(F.regexp_extract("_slug", _NUMBERED, 2), F.lit("")).cast("int")
    names = keyed.groupBy("_slug").agg((F.min("_all") - 1).alias("_before"), F.min(F.struct("_given", order)).alias("_first"))
    names = materialised(names.select("_slug", "_before", "_first", named.alias("_of"), number.alias("_n")), "slugs")
    shorter = names.select(F.col("_slug").alias("_of"))
    children = materialised(names.filter("_n is not null").join(shorter, "_of").select("_of", "_n", "_slug", "_first"), "numbered_slugs")
    settled = _settled(keyed, names, children, order) if not children.isEmpty() else None

    placed = keyed.filter("_given = 1").join(names.select("_slug", "_before"), "_slug")
    nth = F.col("_all") - F.col("_before")
    if settled is not None:
        placed = placed.join(settled, "_slug", "left")
        nth = nth + F.coalesce("_late", F.lit(0))
        gone = F.filter(F.coalesce("_gone", F.array().cast("array<int>")), lambda k, i: k - (i + 1) < nth)
        nth = nth + F.size(gone)
    out = placed.withColumn("slug", F.when(nth == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", nth.cast("string"))))
    return out.select(*rows.columns, "slug")


def _settled(keyed: DataFrame, names: DataFrame, children: DataFrame, order: str) -> DataFrame:
    """(_slug, _late, _gone): 1 where a slug's own name was given to a row of the shorter slug before its first row, and the numbers
    behind it that rows of their own had first, in order; only slugs that have to do with others are listed."""
    from pyspark.sql import Window as W

    from quillspark.operators.numbering import numbered

    # how many rows of the shorter slug come before a numbered slug's first row: both stand in one order
    marks = children.select(F.col("_of").alias("_slug"), F.col("_first").alias("_at"), F.lit(0).alias("_row"), F.col("_slug").alias("_child"))
    both = keyed.select("_slug", F.struct("_given", order).alias("_at"), F.lit(1).alias("_row"), F.lit(None).cast("string").alias("_child")).join(children.select(F.col("_of").alias("_slug")).distinct(), "_slug", "left_semi").unionByName(marks)
    placed = numbered(both, [F.col("_slug"), F.col("_at"), F.col("_row")], "_place")
    start = placed.groupBy("_slug").agg((F.min("_place")).alias("_start"))
    marked = placed.filter("_row = 0").join(start, "_slug")
    earlier = F.row_number().over(W.partitionBy("_slug").orderBy("_place")) - 1  # marks, not rows
    before = marked.select(F.col("_child"), (F.col("_place") - F.col("_start") - earlier).alias("_rows"))
    waiting = materialised(children.join(before, children["_slug"] == before["_child"]).select("_of", "_n", "_slug", "_rows"), "slug_marks")

    ready = materialised(waiting.select(F.col("_of").alias("_slug")).distinct().join(children.select("_slug"), "_slug", "left_anti").withColumn("_late", F.lit(0)), "settled")
    out = None
    while not ready.isEmpty():
        of = waiting.join(ready.select(F.col("_slug").alias("_of"), "_late"), "_of").groupBy("_of", "_late").agg(F.array_sort(F.collect_list(F.struct("_n", "_rows", "_slug"))).alias("_all"))
        start_ = F.struct(F.array().cast("array<int>").alias("gone"), F.array().cast("array<string>").alias("late"))
        mine = lambda a, x: x["_rows"] >= x["_n"] - F.size(a["gone"]) - F.col("_late")  # noqa: E731  a row of the shorter slug is there to take it
        step = lambda a, x: F.struct(F.when(mine(a, x), a["gone"]).otherwise(F.array_append(a["gone"], x["_n"])).alias("gone"), F.when(mine(a, x), F.array_append(a["late"], x["_slug"])).otherwise(a["late"]).alias("late"))
        done = materialised(of.select(F.col("_of").alias("_slug"), "_late", F.aggregate("_all", start_, step).alias("_a"), F.transform("_all", lambda x: x["_slug"]).alias("_children")).select("_slug", "_late", F.col("_a.gone").alias("_gone"), F.col("_a.late").alias("_named"), "_children"), "settled")
        following = done.select(F.explode("_children").alias("_slug"), "_named").select("_slug", F.array_contains("_named", F.col("_slug")).cast("int").alias("_late"))
        ready = materialised(following, "settled")
        last = ready.join(waiting.select(F.col("_of").alias("_slug")), "_slug", "left_anti").withColumn("_gone", F.array().cast("array<int>"))
        found = done.select("_slug", "_late", "_gone").unionByName(last.select("_slug", "_late", "_gone"))
        out = found if out is None else out.unionByName(found)
    return materialised(out, "settled_slugs")
