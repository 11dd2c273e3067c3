"""Catalog search: gates that depend on pool sizes, scores, facets, result order. Each is one plan: a pool size is a one-row aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.numbering import numbered
from quillspark.sources.shared import dealt


def gated(rows: DataFrame, condition: Column, least: int) -> DataFrame:
    """Rows that meet the condition, if at least `least` do; else all rows."""
    n = rows.agg(F.count_if(condition).alias("_n"))
    return rows.crossJoin(F.broadcast(n)).filter((F.col("_n") < least) | F.coalesce(condition, F.lit(False))).drop("_n")


def eligible(grade: int | None) -> Column:
    """Missing bounds and an unknown grade let a row through."""
    if grade is None:
        return F.lit(True)
    return (F.coalesce("grade_min", F.lit(grade)) <= grade) & (F.coalesce("grade_max", F.lit(grade)) >= grade)


def prefilter(rows: DataFrame, wanted: str, haystack: Column, types: list[str], hints: list[str], grade: int | None = None, limit: int = 100, key: str = "id", strict: bool = False, tags: Column | None = None) -> DataFrame:
    """Type gate, then grades, then scores, with 3 more where a tag is among the hints; only positive scores once 60 are; the best `limit`."""
    pool = gated(rows, F.col("type").isin(*types), 1 if strict else 15).filter(eligible(grade))
    terms = text.search_terms(F.lit(wanted))
    low = F.transform(F.coalesce(tags, F.array()), lambda t: F.lower(t)) if tags is not None else F.array()
    hinted = F.when(F.exists(low.cast("array<string>"), lambda t: t.isin(*[h.lower() for h in hints])), 3).otherwise(0) if hints else F.lit(0)
    scored = pool.withColumn("score", text.keyword_score(terms, haystack) + hinted)
    return gated(scored, F.col("score") > 0, 60).orderBy(F.desc("score"), key).limit(limit)


def relaxed(rows: DataFrame, preference: Column, least: int = 20) -> DataFrame:
    """Preferred rows; all rows when fewer than `least` are preferred."""
    return gated(rows, preference, least)


def facets(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Sorted distinct values of each field, and their number; fields with fewer than two values are left out."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("p")).select("p.*")
    sets = each.filter("value is not null").distinct().groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("choices"), F.count(F.lit(1)).alias("n"))
    return sets.filter("n >= 2")


def faceted(rows: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Any of a field's chosen values, for every field with choices."""
    for field, values in chosen.items():
        if values:
            rows = rows.filter(F.col(field).isin(*values))
    return rows


def without_tracked(rows: DataFrame, tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that match no tracked row by any of the keys: one hash anti join per key."""
    for k in keys:
        rows = rows.join(tracked.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return rows


def tag_match(label: str, haystack: Column) -> Column:
    """The whole label is contained, or half of its words (two at most, one at least)."""
    low = F.lower(F.coalesce(haystack, F.lit("")))
    words = [w for w in label.lower().split() if w]
    need = min(2, max(1, -(-len(words) // 2)))
    hits = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return F.contains(low, F.lit(label.lower())) | (hits >= need)


def result_order(rows: DataFrame, key: str = "id") -> DataFrame:
    """Tracked first, then selected, then by tier and place."""
    tier = F.when(F.col("tier") == "strong", 0).when(F.col("tier") == "good", 1).otherwise(2)
    return numbered(rows, [F.when(F.col("tracked"), 0).when(F.col("selected"), 1).otherwise(2), tier, F.col(key)])


def ranked(pool: DataFrame, ranking: DataFrame) -> DataFrame:
    """A ranking (id, place, tier) joined back to its pool: unknown ids go, unknown tiers become `look`."""
    tier = F.when(F.col("tier").isin("strong", "look"), F.col("tier")).otherwise("look")
    return pool.join(ranking.withColumn("tier", tier), "id").orderBy("place")


def survivors(rows: DataFrame, wanted: str, columns: list[str], limit: int = 25) -> DataFrame:
    """An exact id first, then active rows by name that contain the text in any column; the limit is for the latter."""
    clean = "".join(c for c in wanted if c not in ",()*%").strip()
    like = F.lit(False)
    for c in columns:
        like = like | F.col(c).ilike(f"%{clean}%")
    exact = rows.filter(F.col("id").cast("string") == wanted.strip()).withColumn("exact", F.lit(True))
    fuzzy = rows.filter(like & (F.col("id").cast("string") != wanted.strip())).orderBy(F.desc("is_active"), "name", "id").limit(limit).withColumn("exact", F.lit(False))
    return exact.unionByName(fuzzy).orderBy(F.desc("exact"), F.desc("is_active"), "name", "id")


def by_kind(rows: DataFrame, types: list[str], about: str, haystack: Column, preference: Column | None = None, limit: int = 100, strict: bool = False) -> DataFrame:
    """The pool of one kind for a description; a preference holds only while 20 rows of the pool meet it. The grade that the text names is kept to."""
    level = rows.sparkSession.range(1).select(text.grade(F.lit(about)).alias("_grade"))
    fits = F.col("_grade").isNull() | ((F.coalesce("grade_min", "_grade") <= F.col("_grade")) & (F.coalesce("grade_max", "_grade") >= F.col("_grade")))
    pool = gated(rows, F.col("type").isin(*types), 1 if strict else 15).crossJoin(F.broadcast(level)).filter(fits).drop("_grade")
    scored = pool.withColumn("score", text.keyword_score(text.search_terms(F.lit(about)), haystack))
    best = gated(scored, F.col("score") > 0, 60).orderBy(F.desc("score"), "id").limit(100)
    if preference is not None:
        best = relaxed(best, preference)
    return best.orderBy(F.desc("score"), "id").limit(limit)


def across_kinds(rows: DataFrame, kinds: dict[str, tuple[list[str], bool]], about: str, haystack: Column, most: int, strong: int) -> DataFrame:
    """(kind, place, id, tier) of all kinds together; a row that comes under several stays under each. Places come from scores."""
    from pyspark.sql import Window as W

    out = None
    for kind, (types, strict) in kinds.items():
        pool = by_kind(rows, types, about, haystack, limit=most, strict=strict)
        place = F.row_number().over(W.orderBy(F.desc("score"), "id"))  # over `most` rows
        listed = pool.select(F.lit(kind).alias("kind"), place.alias("place"), "id").withColumn("tier", F.when(F.col("place") <= strong, "strong").otherwise("look"))
        out = listed if out is None else out.unionByName(listed)
    return out


def page(ordered: DataFrame, number: int, size: int = 10) -> DataFrame:
    """One page of ordered rows, from 1."""
    return ordered.offset((number - 1) * size).limit(size)


def enriched_tags(tags: DataFrame, answers: DataFrame) -> DataFrame:
    """tags: id, place, tag; answers: id, place, echo, intent. Every tag, with the first answer that echoes it or, where an answer's
    echo is none of the tags, stands at its position. An entry's tags and answers meet once, by its id. Counts both when it is called."""
    tag, answer = F.struct("place", "tag"), F.struct("place", "echo", "intent")
    both = tags.select("id", tag.alias("t"), F.lit(None).cast(answers.select(answer).schema[0].dataType).alias("a"))
    both = both.unionByName(answers.select("id", F.lit(None).cast(tags.select(tag).schema[0].dataType).alias("t"), answer.alias("a")))
    entries = dealt(both, tags.count() + answers.count(), "id").groupBy("id").agg(F.collect_list("t").alias("tags"), F.collect_list("a").alias("answers"))
    known = lambda a: F.coalesce(F.exists("tags", lambda t: t["tag"] == a["echo"]), F.lit(False))
    stands = lambda a, name: F.exists("tags", lambda t: (t["place"] == a["place"]) & (t["tag"] == name))
    of = lambda name: F.filter("answers", lambda a: a["place"].isNotNull() & F.when(known(a), a["echo"] == name).otherwise(stands(a, name)))
    first = lambda name: F.array_min(F.transform(of(name), lambda a: F.struct(a["place"], a["intent"])))["intent"]
    rows = entries.select("id", F.explode(F.transform("tags", lambda t: F.struct(t["place"].alias("place"), t["tag"].alias("tag"), first(t["tag"]).alias("intent")))).alias("r"))
    # no answer meets an entry without an id
    return rows.select("id", "r.place", "r.tag", F.when(F.col("id").isNotNull(), F.col("r.intent")).alias("intent"))
