"""JSON sources: snapshot files of job runs, legacy catalogs, keyed objects, seed lists with a fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import json_arrays

#: Each job's snapshot file names, what committing one means, and how it is called.
SPECS = {
    "metadata": ("refresh_opportunities_dry_run_*.json", "patch", True, "Metadata refresh"),
    "reviews": ("review_check_dry_run_*.json", "patch", True, "Review check"),
    "deadline": ("deadline_check_dry_run_*.json", "patch", True, "Deadline check"),
    "scraper": ("scrape_review_*.json", "insert", False, "New opportunities"),
}

#: What the commits read of an entry; entries may have more fields, or lack some.
ENTRY = """struct<id:string,name:string,url:string,changes:map<string,string>,previous_review_status:string,review_status:string,review_summary:string,
review_sources:array<struct<url:string,note:string>>,status:string,important_dates:array<struct<label:string,date_iso:string,type:string>>,
was_estimated:boolean,important_date_note:string,changed:boolean,web_searches:int,cost_usd:decimal(18,6)>"""


@dataclass
class Snapshots:
    """files: file, agent, modified_at, readable. entries: file, agent, position, entry of every element of the readable lists;
    entry is null where the element is no object. What is readable but no list has no entries."""

    files: DataFrame
    entries: DataFrame


def snapshot_files(spark: SparkSession, folder: str) -> Snapshots:
    """The files in a folder whose names fit one of the jobs; a file is read by as many tasks as it has ranges."""
    found, elements = json_arrays.read_elements(spark, folder)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    files = found.withColumn("file", name).withColumn("agent", agent_of(F.col("file"))).filter("agent is not null")
    rows = elements.withColumn("file", name).withColumn("agent", agent_of(F.col("file"))).filter("agent is not null")
    entry = F.when(F.col("text").startswith("{"), F.from_json("text", ENTRY)).alias("entry")
    return Snapshots(files.select("file", "agent", "modified_at", "readable"), rows.select("file", "agent", "position", entry))


def entries(found: Snapshots) -> DataFrame:
    return found.entries


def agent_of(file: Column) -> Column:
    """The job whose pattern a bare file name fits; null for others and for names with a folder in them."""
    out = F.when(F.contains(file, F.lit("/")), F.lit(None))
    for agent, (glob, *_) in SPECS.items():
        out = out.when(file.like(glob.replace("_", r"\_").replace("*", "%")), agent)
    return out


def spec_of(agent: Column, field: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for name, spec in SPECS.items() for x in (name, spec[field]))), agent)


def keyed_objects(texts: DataFrame, column: str, fields: str, key: str = "userid") -> DataFrame:
    """Rows of JSON objects whose members are objects: a member's name becomes the key."""
    return texts.select(F.explode(F.from_json(column, f"map<string,struct<{fields}>>")).alias(key, "_v")).select(key, "_v.*")


#: A legacy listing's categories and the types they became.
CATEGORY_TYPES = {
    "SUMMER_PROGRAM": "Program", "OTHER": "Program", "RESEARCH": "Research", "INTERNSHIP": "Internship",
    "COMPETITION": "Competition", "VOLUNTEER": "Volunteer", "JOURNAL": "Journal", "CONFERENCE": "Conference",
}

#: Columns that a legacy catalog lacks, and what they are filled with.
LEGACY_FILL = {"category": None, "eligibility": None, "grade_min": None, "grade_max": None, "cost": None, "is_active": True, "source": "legacy-seed"}


def legacy_catalog(rows: DataFrame) -> DataFrame:
    """Legacy rows with the columns they lack filled by constants."""
    kinds = {"grade_min": "int", "grade_max": "int", "is_active": "boolean"}
    return rows.select("*", *(F.lit(v).cast(kinds.get(c, "string")).alias(c) for c, v in LEGACY_FILL.items() if c not in rows.columns))


def price_of(cost: Column) -> Column:
    c = F.coalesce(cost, F.lit(""))
    return F.when(F.contains(F.lower(c), F.lit("free")), "Free").when(c != "", "Paid")


def as_list(value: Column) -> Column:
    """A JSON value that is a list, a single one, or nothing, as an array of strings."""
    text = F.trim(F.coalesce(value, F.lit("")))
    one = F.regexp_replace(text, '^"|"$', "")
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isin("", "null", '""'), F.array().cast("array<string>")).otherwise(F.array(one))


def mapped_listing(rows: DataFrame, locations: list[str]) -> DataFrame:
    """A second source in the catalog's columns: title, url, category, cost, location and subject_tags (JSON) mapped."""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORY_TYPES.items() for x in kv)), F.coalesce("category", F.lit("OTHER"))), F.lit("Program"))
    tags = as_list(F.col("subject_tags"))
    return rows.select(
        "pos",
        F.trim(F.coalesce("title", F.lit(""))).alias("name"),
        F.trim(F.coalesce("url", F.lit(""))).alias("url"),
        kind.alias("type"),
        price_of(F.col("cost")).alias("price"),
        F.when(F.col("location").isin(*locations), F.col("location")).alias("location"),
        F.when(F.size(tags) > 0, tags).alias("subject_tags"),
    )


def with_fallback(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """rows, or the fallback's where there are none; one row decides, no job runs for it."""
    none = rows.agg((F.count(F.lit(1)) == 0).alias("_none"))
    return rows.unionByName(fallback.crossJoin(F.broadcast(none)).filter("_none").drop("_none"), allowMissingColumns=True)
