"""Snapshot, editing and seed queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import text, urls
from quillspark.operators import curation, editing, seeds, versions
from quillspark.operators import snapshots as s
from quillspark.sources import bindings as b
from quillspark.sources import json_arrays
from quillspark.sources import snapshots as src
from quillspark.sources.shared import shared_dir

NOW = "2024-01-31 12:00:00"


#: Documents whose entries share the files of a job's eight days, so a file has at most a thirty-second of them.
FILE_IDS = 1 << 21


def _written_files(spark, d):
    """A folder of snapshots made of documents: files for each job and 8 days of every FILE_IDS documents, of which one a job is cut short and one is no list."""
    docs = b.table(spark, d, "documents").join(b.table(spark, d, "labels"), "doc_id", "left")
    agent = F.get(F.array(*map(F.lit, src.SPECS)), (F.col("doc_id") % 4).cast("int"))
    day = ((F.col("doc_id") / 4).cast("long") % 8).cast("int")
    old, new = (F.when(F.col(c) == 1, "good").otherwise("poor") for c in ("quality", "toxic"))
    entry = F.struct(
        F.when(F.col("doc_id") % 10 != 9, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("id"),
        F.when(F.col("doc_id") % 12 != 3, F.concat(F.lit("https://Site"), (F.col("doc_id") % 600).cast("string"), F.lit(".example.org/"))).alias("url"),
        F.when(F.col("doc_id") % 3 == 0, F.create_map(F.when(F.col("doc_id") % 60 == 0, "no such column").otherwise("lang"), F.col("lang"))).alias("changes"),
        old.alias("previous_review_status"), new.alias("review_status"), (F.col("doc_id") % 16 < 4).alias("changed"), F.col("source").alias("extra"),
    )
    rows = docs.select("doc_id", agent.alias("agent"), day.alias("day"), F.to_json(entry).alias("json"))
    date = F.date_format(F.date_add(F.lit("2024-01-20").cast("date"), F.col("day") - 8 * F.floor(F.col("doc_id") / FILE_IDS).cast("int")), "yyyyMMdd")
    stamp = F.when(F.col("day") % 2 == 0, F.concat(date, F.lit("-093015"))).otherwise(date)
    stem = F.element_at(F.create_map(*(F.lit(x) for k, v in src.SPECS.items() for x in (k, v[0].split("*")[0]))), F.col("agent"))
    file = F.concat(stem, F.when(F.col("agent") == "scraper", "national_").otherwise(""), stamp, F.lit(".json"))
    reviews = F.col("agent") == "reviews"
    rows = rows.withColumn("file", file)
    root = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    json_arrays.write_arrays(rows.filter(~(reviews & F.col("day").isin(1, 2))), root, "file", "doc_id", "json")
    lost = rows.filter(reviews & F.col("day").isin(1, 2)).groupBy("file", "day").agg(F.min_by("json", "doc_id").alias("json"))
    lost = lost.select("file", F.when(F.col("day") == 1, F.concat(F.lit("["), F.substring("json", 1, 29))).otherwise('{"not": "a list"}').alias("value"))
    lost.withColumnRenamed("file", "_file").repartition("_file").write.partitionBy("_file").text(f"{root}/parts")
    json_arrays.named_files(spark, f"{root}/parts", root)
    return root


_folders: dict[tuple[str, str], str] = {}


def _files(spark, d):
    """Such a folder, read back. A session writes the files of a table once."""
    key = (spark.sparkContext.applicationId, d)
    path = spark._jvm.org.apache.hadoop.fs.Path
    known = _folders.get(key)
    if known is None or not path(known).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(known)):
        _folders[key] = _written_files(spark, d)
    return src.snapshot_files(spark, _folders[key])


def _plan(spark, d):
    return s.plan(src.entries(_files(spark, d)), _catalog_urls(spark, d))


def _catalog_urls(spark, d):
    p = b.table(spark, d, "part")
    return p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("https://site"), F.col("p_partkey").cast("string"), F.lit(".example.org")).alias("url"))


def snapshot_listing(spark, d):
    return s.listing(_files(spark, d), NOW)


def snapshot_commit_counts(spark, d):
    return s.commit_counts(_plan(spark, d))


def snapshot_patches(spark, d):
    rows = s.patches(_plan(spark, d), NOW)
    return rows.select("agent", "id", F.array_join(F.array_sort(F.map_keys("columns")), "|").alias("columns"), F.element_at("columns", F.lit("review_status")).alias("review_status"), F.element_at("columns", F.lit("lang")).alias("lang"))


def snapshot_inserts(spark, d):
    return s.inserts(_plan(spark, d)).select("file", "url", "is_active")


def snapshot_audit(spark, d):
    return s.audit_rows(s.commit_counts(_plan(spark, d)), NOW)


def _versioned(spark, d):
    """A catalog in versions: documents but for the scraped ones, and rows whose URLs new entries repeat."""
    docs = b.table(spark, d, "documents").filter("doc_id % 4 <> 3 and doc_id % 7 <> 0")
    own = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("url"), "lang")
    parts = b.table(spark, d, "part").filter("p_partkey % 3 = 0").select(F.concat(F.when(F.col("p_partkey") % 5 == 0, "d").otherwise("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("https://site"), F.col("p_partkey").cast("string"), F.lit(".example.org")).alias("url"), F.lit(None).cast("string").alias("lang"))
    rows = own.unionByName(parts.join(own.select("id"), "id", "left_anti"))
    blank = {"name": "string", "review_status": "string", "review_summary": "string", "review_sources": "array<struct<url:string,note:string>>", "status": "string", "important_dates": "array<struct<label:string,date_iso:string,type:string>>", "was_estimated": "boolean", "important_date_note": "string", "last_reviewed_at": "timestamp_ntz", "dates_last_checked_at": "timestamp_ntz", "updated_at": "timestamp_ntz"}
    rows = rows.select("id", "url", F.lit(True).alias("is_active"), "lang", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))
    table = versions.VersionedTable(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}")
    table.create(rows)
    return table


def snapshot_commit(spark, d):
    """Every snapshot committed to a catalog in versions, and the new version read back."""
    table = _versioned(spark, d)
    versions.commit_snapshots(table, src.entries(_files(spark, d)), NOW)
    out = table.read()
    return out.select("id", "url", "is_active", "lang", "review_status", F.size("review_sources").alias("sources"), "was_estimated", "last_reviewed_at", "dates_last_checked_at", "updated_at")


def snapshot_commit_log(spark, d):
    """What the commit of each file did, as the table's log has it; a second commit of the same files finds nothing to do."""
    table = _versioned(spark, d)
    entries = src.entries(_files(spark, d))
    versions.commit_snapshots(table, entries, NOW)
    versions.commit_snapshots(table, entries, "2024-02-01 12:00:00")
    return table.log().select("file", "agent", "version", "committed_at", "entries", "applied", "skipped_no_change", "skipped_duplicate", "errors")


def activate_rows(spark, d):
    rows = b.reviewed_documents(spark, d).select("id", "moderation_status", (F.col("id") % 2 == 0).alias("is_active"), F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    on = editing.activated(rows, rows.filter("id % 5 = 0").select("id"), NOW)
    return editing.activated(on, rows.filter("id % 7 = 0").select("id"), NOW, active=False)


def _edits(spark, d):
    p = b.table(spark, d, "part")
    k = F.col("p_partkey")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    fields = F.map_filter(
        F.create_map(
            F.lit("name"), F.when(k % 4 != 0, F.when(k % 12 == 1, "  ").otherwise(F.concat(F.lit(" New "), "p_name"))),
            F.lit("url"), F.when(k % 5 == 0, pick("https://a.example", "HTTP://b.example", "ftp://c", "")),
            F.lit("state"), F.when(k % 6 == 0, pick("WA", "Wash", "")),
            F.lit("type"), F.when(k % 7 == 0, pick("Program", "Party")),
            F.lit("grade_min"), F.when(k % 8 == 0, pick("9", "12", "x", "14", "—")),
            F.lit("grade_max"), F.when(k % 9 == 0, pick("10", "11", " 12 ")),
            F.lit("subject_tags"), F.when(k % 10 == 0, pick("a, b,,c", ",")),
            F.lit("owner"), F.when(k % 31 == 0, "me"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return p.select(F.when(k % 37 == 0, k + 1_000_000_000).otherwise(k).alias("id"), fields.alias("fields"))


def _queue(spark, d):
    none = lambda kind: F.lit(None).cast(kind)
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("https://x.example").alias("url"), none("string").alias("state"), F.col("p_type").alias("type"), F.lit(9).alias("grade_min"), none("int").alias("grade_max"), none("array<string>").alias("subject_tags"), (F.col("p_partkey") % 11 == 0).alias("is_active"))


def edit_verdicts(spark, d):
    return editing.edit_verdicts(_edits(spark, d), _queue(spark, d)).select("id", "error")


def edited_rows(spark, d):
    rows = _queue(spark, d)
    out = editing.edited(rows, editing.edit_verdicts(_edits(spark, d), rows))
    return out.select("id", "name", "url", "state", "type", "grade_min", "grade_max", F.array_join("subject_tags", "|").alias("tags"))


def queue_survivors(spark, d):
    p = b.catalog(spark, d).select("id", "name", F.concat(F.lit("https://x.example/"), F.col("id").cast("string")).alias("url"), "is_active")
    queue = p.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), (F.col("id") + 5).cast("string"))).otherwise(" ").alias("duplicate_of"))
    return editing.with_survivor(queue, p).select("id", "survivor.name", "survivor.is_active")


ENUMS = {"type": ("ECONOMY", "PROMO"), "price": ("Free", "Paid")}
VOCABULARY = ("red", "gear", "small", "widget")


def cleaned_updates(spark, d):
    p = b.table(spark, d, "part")
    info = {"name": F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.concat(F.col("p_name"), F.lit(" "))), "org": F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")), "type": F.col("p_type"), "price": F.when(F.col("p_partkey") % 2 == 0, "Free").otherwise("free"), "grade_min": F.col("p_size") % 16, "subject_tags": F.split("p_name", " ")}
    return p.select(F.col("p_partkey").alias("id"), F.to_json(editing.clean_update(info, ENUMS, VOCABULARY)).alias("changes"))


def changed_rows(spark, d):
    """Rows whose verdict or whose dates are not what they were; nulls count as values."""
    o = b.table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("was"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("is"), F.when(F.col("o_orderkey") % 10 == 0, F.date_add(F.to_date("o_orderdate"), 1)).otherwise(F.to_date("o_orderdate")).alias("day"), F.to_date("o_orderdate").alias("day_was"))
    return rows.filter(editing.differs([("is", "was"), ("day", "day_was")])).select("id")


def submissions(spark, d):
    p = b.table(spark, d, "pages")
    tail = F.get(F.array(F.lit("FAQ"), F.lit("program"), F.lit("apply/"), F.lit("sign-up?x=1"), F.lit("")), (F.col("page_id") % 5).cast("int"))
    rows = p.select(F.col("page_id").alias("id"), F.concat(F.lit(" Page "), F.col("page_id").cast("string")).alias("name"), F.concat(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0), F.lit("/"), tail).alias("url"), F.when(F.col("page_id") % 3 == 0, "Internship").otherwise("").alias("type"), F.get(F.array(*map(F.lit, [*editing.SECTION_TYPES, "other"])), (F.col("page_id") % 7).cast("int")).alias("section"), F.when(F.col("page_id") % 2 == 0, "https://apply.example").alias("apply_url"), F.when(F.col("page_id") % 4 == 0, " see site ").otherwise(" ").alias("note"))
    out = editing.submission_rows(rows, NOW)
    return out.select("id", "name", "type", "moderation_status", F.array_join("quality_flags", "|").alias("flags"), F.element_at("submission_payload", F.lit("apply_url")).alias("apply_url"), F.array_join(F.array_sort(F.map_keys("submission_payload")), "|").alias("details"))


def unique_slugs(spark, d):
    """Slugs of names, some of which end with a number as made slugs do; some ids are in use already."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 45 == 7, " 2").when(k % 61 == 3, " 3").when(k % 55 == 9, " 2 2").when(k % 97 == 5, " 03").otherwise(""))
    p = b.table(spark, d, "part").select(k.alias("id"), F.when(k % 50 == 0, "!?").otherwise(name).alias("name"), k.alias("pos"))
    taken = b.table(spark, d, "part").filter("p_partkey % 83 = 1").select(F.concat(text.slug(F.col("p_name")), F.when(k % 2 == 0, "-3").otherwise("")).alias("id"))
    return editing.unique_slugs(p, text.slug(F.col("name")), taken=taken).select("id", "slug")


def low_value_urls(spark, d):
    p = b.table(spark, d, "pages")
    tail = F.get(F.array(*map(F.lit, [*urls.LOW_VALUE, "x", "index.html", ""])), (F.col("page_id") % 26).cast("int"))
    url = F.concat(F.regexp_extract("url", "^[^/]*//[^/?#]*", 0), F.lit("/A/"), F.when(F.col("page_id") % 2 == 0, F.initcap(tail)).otherwise(tail), F.when(F.col("page_id") % 3 == 0, "/").otherwise(""))
    return p.select("page_id", F.coalesce(urls.low_value(url), F.lit(False)).alias("low_value"))


def listing_merge(spark, d):
    """A legacy catalog and a second listing in one: rows of the second whose URL is known, or stands earlier in it, are left out."""
    pages = b.table(spark, d, "pages")
    site = F.regexp_extract("url", "^[^/]*//[^/?#]*", 0)
    legacy = src.legacy_catalog(pages.filter("page_id % 4 = 0").select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), F.lit("old").alias("name"), site.alias("url"), F.lit("Program").alias("type")))
    tags = F.get(F.array(F.lit('["a","b"]'), F.lit('"solo"'), F.lit("plain"), F.lit("null"), F.lit("[]")), (F.col("page_id") % 5).cast("int"))
    listing = pages.filter("page_id % 4 <> 0").select(F.col("page_id").alias("pos"), F.concat(F.lit(" T"), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 9 != 1, site).otherwise(" ").alias("url"), F.get(F.array(*map(F.lit, [*src.CATEGORY_TYPES, "NEW"])), (F.col("page_id") % 10).cast("int")).alias("category"), F.get(F.array(F.lit("FREE for all"), F.lit("$100"), F.lit("")), (F.col("page_id") % 3).cast("int")).alias("cost"), F.get(F.array(F.lit("Remote"), F.lit("Moon")), (F.col("page_id") % 2).cast("int")).alias("location"), tags.alias("subject_tags"))
    mapped = src.mapped_listing(listing, ["Remote", "In-Person"])
    fresh = curation.snapshot_plan(mapped, legacy).filter("verdict = 'insert'").drop("verdict", "key")
    both = legacy.unionByName(fresh.drop("pos").withColumn("source", F.lit("finder")), allowMissingColumns=True)
    return both.select("id", "name", "url", "type", "price", "location", F.array_join("subject_tags", "|").alias("tags"), "is_active", "source")


def keyed_accounts(spark, d):
    """Accounts kept as JSON objects of objects, one text for a segment and every thousand numbers."""
    c = b.table(spark, d, "customer")
    of = F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))))
    texts = c.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 1000)).agg(F.to_json(of).alias("json"))
    return src.keyed_objects(texts, "json", "name:string,nation:int")


def _seeds(spark, d):
    p = b.table(spark, d, "part")
    each = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("total_found"))
    mode = F.when(F.col("id") % 2 == 0, "national").otherwise("seattle")
    return each.select("id", mode.alias("mode"), F.col("p_type").alias("category"), F.concat_ws(" ", "p_brand", "p_type", F.lit("")).alias("angle"), (F.col("id") % 7 != 0).alias("is_enabled"), (F.col("id") % 13).cast("int").alias("sort_order"), F.lit(None).cast("long").alias("total_runs"), F.col("total_found"), F.lit(None).cast("timestamp_ntz").alias("last_run_at"))


def seed_list(spark, d):
    return seeds.loaded(_seeds(spark, d), "national").select("id", "mode", "sort_order")


def seed_fallback(spark, d):
    """Seeds of a mode that has none: the built-in list, whose rows have no id."""
    built = spark.createDataFrame([(None, "abroad", c, a, True, i) for i, (c, a) in enumerate([("Program", "summer camps"), ("Research", "open labs")])], "id long, mode string, category string, angle string, is_enabled boolean, sort_order int")
    loaded = src.with_fallback(seeds.loaded(_seeds(spark, d), "abroad"), built)
    kept = src.with_fallback(seeds.loaded(_seeds(spark, d), "seattle"), built)
    return loaded.unionByName(kept).select("id", "mode", "angle", "sort_order")


def seed_migration(spark, d):
    known = _seeds(spark, d)
    new = known.select("mode", "category", F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), "angle")).otherwise(F.concat("angle", F.lit("more"))).alias("angle"))
    return seeds.not_present(new, known)


def seeds_by_id(spark, d):
    return seeds.chosen_by_id(_seeds(spark, d), [9, 3, 999_999_999, 9, 4]).select("place", "id", "mode", F.coalesce("found", F.lit(False)).alias("found"))


def seeds_by_place(spark, d):
    return seeds.chosen_by_place(_seeds(spark, d), [2, 0, 2, 100_000]).select("place", "at", "id", "mode")


def seed_creation(spark, d):
    n = b.table(spark, d, "nation")
    mode = F.get(F.array(F.lit("national"), F.lit("seattle"), F.lit("moon"), F.lit("")), (F.col("n_nationkey") % 4))
    new = n.select(F.col("n_nationkey").alias("pos"), mode.alias("mode"), F.lit("Program").alias("category"), F.when(F.col("n_nationkey") % 5 == 1, " ").otherwise(F.col("n_name")).alias("angle"), F.when(F.col("n_nationkey") % 8 == 0, 99).cast("int").alias("sort_order"))
    return seeds.created(new, _seeds(spark, d)).select("pos", "mode", "sort_order", "error")


def seeds_per_mode(spark, d):
    return seeds.per_mode(_seeds(spark, d))


def seed_results(spark, d):
    rows = _seeds(spark, d).withColumns({"total_added": F.lit(1).cast("long"), "total_dupes": F.lit(None).cast("long"), "total_cost": F.lit(0).cast("decimal(18,4)")})
    o = b.table(spark, d, "orders")
    results = o.select((F.col("o_orderkey") % 90).alias("id"), F.lit(3).cast("long").alias("found"), (F.col("o_orderkey") % 3).alias("added"), F.lit(1).cast("long").alias("dupes"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"), F.col("o_orderdate").alias("ran_at"))
    return seeds.with_results(rows, results).drop("category", "angle", "is_enabled", "sort_order")


def run_tallies(spark, d):
    l = b.table(spark, d, "lineitem")
    verdict = F.get(F.array(F.lit("added"), F.lit("duplicate"), F.lit("invalid"), F.lit("error")), ((F.col("l_partkey") + F.col("l_linenumber")) % 4).cast("int"))
    return seeds.tally(l.select(F.col("l_orderkey").alias("run"), verdict.alias("verdict"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linenumber") % 2).alias("web_searches")))


QUERIES = {f.__name__: f for f in (snapshot_listing, snapshot_commit_counts, snapshot_patches, snapshot_inserts, snapshot_audit, snapshot_commit, snapshot_commit_log, activate_rows, edit_verdicts, edited_rows, queue_survivors, cleaned_updates, changed_rows, submissions, unique_slugs, low_value_urls, listing_merge, keyed_accounts, seed_list, seed_fallback, seed_migration, seeds_by_id, seeds_by_place, seed_creation, seeds_per_mode, seed_results, run_tallies)}

_ENTRIES = """e AS (SELECT doc_id, (['metadata', 'reviews', 'deadline', 'scraper'])[doc_id % 4 + 1] AS agent, doc_id // 4 % 8 AS day, DATE '2024-01-20' + CAST(doc_id // 4 % 8 - 8 * (doc_id // 2097152) AS INTEGER) AS dated, doc_id % 10 <> 9 AS has_id, lang,
  CASE WHEN doc_id % 12 <> 3 THEN 'https://site' || (doc_id % 600) || '.example.org' END AS key, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS was, CASE WHEN toxic = 1 THEN 'good' ELSE 'poor' END AS is_now FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT *, CASE agent WHEN 'metadata' THEN 'refresh_opportunities_dry_run_' WHEN 'reviews' THEN 'review_check_dry_run_' WHEN 'deadline' THEN 'deadline_check_dry_run_' ELSE 'scrape_review_national_' END || strftime(dated, '%Y%m%d') || CASE WHEN day % 2 = 0 THEN '-093015' ELSE '' END || '.json' AS file,
  agent = 'reviews' AND day IN (1, 2) AS lost, CASE agent WHEN 'metadata' THEN doc_id % 3 = 0 WHEN 'reviews' THEN was <> is_now WHEN 'deadline' THEN doc_id % 16 < 4 ELSE key IS NOT NULL END AS pending FROM e),
p AS (SELECT *, CASE WHEN agent = 'scraper' THEN CASE WHEN key IS NULL THEN 'skipped_no_change' WHEN key IN (SELECT 'https://site' || p_partkey || '.example.org' FROM part WHERE p_partkey % 3 = 0) OR row_number() OVER (PARTITION BY file, key ORDER BY doc_id) > 1 THEN 'skipped_duplicate' ELSE 'applied' END
  WHEN has_id AND pending THEN 'applied' ELSE 'skipped_no_change' END AS verdict FROM f WHERE NOT lost),
c AS (SELECT file, agent, count(*) AS entries, count(*) FILTER (verdict = 'applied') AS applied, count(*) FILTER (verdict = 'skipped_no_change') AS skipped_no_change, count(*) FILTER (verdict = 'skipped_duplicate') AS skipped_duplicate FROM p GROUP BY 1, 2)"""
_COMMIT = """cat AS (SELECT 'd' || doc_id AS id, 'https://docs.example.org/' || doc_id AS url, lang FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 7 <> 0),
own AS (SELECT id, url, lang FROM cat UNION ALL SELECT id, url, NULL FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'd' ELSE 'p' END || p_partkey AS id, 'https://site' || p_partkey || '.example.org' AS url FROM part WHERE p_partkey % 3 = 0) WHERE id NOT IN (SELECT id FROM cat)),
a AS (SELECT *, row_number() OVER (PARTITION BY agent, key ORDER BY dated, file, doc_id) AS nth, CASE WHEN has_id THEN 'd' || doc_id ELSE 'u' || left(md5(key), 16) END AS new_id FROM p WHERE verdict = 'applied'),
n AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY dated, file, doc_id) AS mth FROM a WHERE agent = 'scraper' AND nth = 1),
ins AS (SELECT *, mth > 1 OR new_id IN (SELECT id FROM own) AS taken FROM n),
pat AS (SELECT *, 'd' || doc_id AS id FROM a WHERE agent <> 'scraper' AND NOT (agent = 'metadata' AND doc_id % 60 = 0))"""
_SEEDS = """seeds AS (SELECT min(p_partkey) AS id, CASE WHEN min(p_partkey) % 2 = 0 THEN 'national' ELSE 'seattle' END AS mode, p_type AS category, p_brand || ' ' || p_type || ' ' AS angle, min(p_partkey) % 7 <> 0 AS is_enabled, CAST(min(p_partkey) % 13 AS INTEGER) AS sort_order, count(*) AS total_found FROM part GROUP BY p_brand, p_type)"""
_REV = """rev AS (SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'insufficient_data' END AS moderation_status FROM documents d LEFT JOIN labels USING (doc_id))"""
_EDITS = """ed AS (SELECT CASE WHEN k % 37 = 0 THEN k + 1000000000 ELSE k END AS id, k, p_name, k % 4 <> 0 AS h_name, CASE WHEN k % 12 = 1 THEN NULL ELSE 'New ' || p_name END AS name, k % 5 = 0 AS h_url, nullif((['https://a.example', 'HTTP://b.example', 'ftp://c', ''])[k % 4 + 1], '') AS url,
  k % 6 = 0 AS h_state, nullif((['WA', 'Wash', ''])[k % 3 + 1], '') AS state, k % 7 = 0 AS h_type, (['Program', 'Party'])[k % 2 + 1] AS type, k % 8 = 0 AS h_min, (['9', '12', 'x', '14', '—'])[k % 5 + 1] AS gmin, k % 9 = 0 AS h_max, (['10', '11', '12'])[k % 3 + 1] AS gmax,
  k % 10 = 0 AS h_tags, CASE WHEN k % 2 = 0 THEN 'a|b|c' END AS tags, k % 31 = 0 AS h_owner FROM (SELECT p_partkey AS k, p_name FROM part)),
ev AS (SELECT *, CASE WHEN h_owner THEN 'not_editable:owner' WHEN id > 1000000000 THEN 'no_row' WHEN k % 11 = 0 THEN 'live_row' WHEN h_min AND gmin = 'x' THEN 'not_whole:grade_min' WHEN h_min AND gmin = '14' THEN 'no_grade:grade_min'
  WHEN h_name AND name IS NULL THEN 'blank:name' WHEN h_url AND url IS NULL THEN 'blank:url' WHEN h_type AND type = 'Party' THEN 'unknown_type' WHEN h_url AND url LIKE 'ftp%' THEN 'no_scheme:url'
  WHEN h_state AND length(state) <> 2 THEN 'no_code:state' WHEN h_min AND h_max AND TRY_CAST(gmin AS INTEGER) > CAST(gmax AS INTEGER) THEN 'grades_reversed'
  WHEN NOT (h_name OR h_url OR h_state OR h_type OR h_min OR h_max OR h_tags) THEN 'no_change' END AS error FROM ed)"""

ORACLES = {
    "snapshot_listing": f"""WITH {_ENTRIES}, g AS (SELECT file, agent, day, dated, lost, CASE WHEN lost THEN 0 ELSE count(*) END AS entries, CASE WHEN lost THEN 0 ELSE count(*) FILTER (pending) END AS pending FROM f GROUP BY file, agent, day, dated, lost),
h AS (SELECT *, agent = 'reviews' AND day = 1 AS bad, CAST(dated AS TIMESTAMP) + CASE WHEN day % 2 = 0 THEN INTERVAL '9 hours 30 minutes 15 seconds' ELSE INTERVAL '0 hours' END AS ran FROM g)
SELECT file, agent, CASE agent WHEN 'metadata' THEN 'Metadata refresh' WHEN 'reviews' THEN 'Review check' WHEN 'deadline' THEN 'Deadline check' ELSE 'New opportunities' END AS label, CASE WHEN agent = 'scraper' THEN 'insert' ELSE 'patch' END AS kind, CASE WHEN NOT bad THEN ran END AS ran_at, day % 2 = 0 AS has_time,
 CASE WHEN NOT bad THEN date_diff('second', ran, TIMESTAMP '{NOW}') // 86400 END AS age_days, CASE WHEN NOT bad THEN date_diff('second', ran, TIMESTAMP '{NOW}') // 86400 >= 7 END AS stale, entries, pending, CASE WHEN agent = 'scraper' THEN 'national' END AS mode, CASE WHEN bad THEN 'unreadable' END AS error FROM h""",
    "snapshot_commit_counts": f"WITH {_ENTRIES} SELECT * FROM c",
    "snapshot_patches": f"""WITH {_ENTRIES} SELECT agent, 'd' || doc_id AS id, CASE agent WHEN 'metadata' THEN CASE WHEN doc_id % 60 = 0 THEN 'no such column|updated_at' ELSE 'lang|updated_at' END WHEN 'reviews' THEN 'last_reviewed_at|review_sources|review_status|review_summary|updated_at' ELSE 'dates_last_checked_at|important_date_note|important_dates|status|updated_at|was_estimated' END AS columns,
 CASE WHEN agent = 'reviews' THEN is_now END AS review_status, CASE WHEN agent = 'metadata' AND doc_id % 60 <> 0 THEN lang END AS lang FROM p WHERE verdict = 'applied' AND agent <> 'scraper'""",
    "snapshot_inserts": f"WITH {_ENTRIES} SELECT file, 'https://Site' || (doc_id % 600) || '.example.org/' AS url, false AS is_active FROM p WHERE verdict = 'applied' AND agent = 'scraper'",
    "snapshot_audit": f"""WITH {_ENTRIES} SELECT agent, 'snapshot-commit' AS mode, TIMESTAMP '{NOW}' AS started_at, TIMESTAMP '{NOW}' AS finished_at, entries AS items_processed, CASE WHEN agent = 'scraper' THEN 0 ELSE applied END AS items_updated, CASE WHEN agent = 'scraper' THEN applied ELSE 0 END AS items_added,
 0 AS errors, CAST(0 AS DECIMAL(18,6)) AS cost_usd, 'Committed snapshot ' || file AS notes FROM c WHERE applied > 0""",
    "snapshot_commit": f"""WITH {_ENTRIES}, {_COMMIT} SELECT own.id, url, true AS is_active, CASE WHEN pat.agent = 'metadata' THEN pat.lang ELSE own.lang END AS lang, CASE WHEN pat.agent = 'reviews' THEN is_now END AS review_status, CASE WHEN pat.agent = 'reviews' THEN 0 END AS sources,
 CASE WHEN pat.agent = 'deadline' THEN false END AS was_estimated, CASE WHEN pat.agent = 'reviews' THEN TIMESTAMP '{NOW}' END AS last_reviewed_at, CASE WHEN pat.agent = 'deadline' THEN TIMESTAMP '{NOW}' END AS dates_last_checked_at, CASE WHEN pat.id IS NOT NULL THEN TIMESTAMP '{NOW}' END AS updated_at FROM own LEFT JOIN pat ON pat.id = own.id
UNION ALL SELECT new_id, 'https://Site' || (doc_id % 600) || '.example.org/', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ins WHERE NOT taken""",
    "snapshot_commit_log": f"""WITH {_ENTRIES}, {_COMMIT}, x AS (SELECT file, doc_id, CASE WHEN agent = 'metadata' AND doc_id % 60 = 0 THEN 'errors' WHEN agent = 'scraper' AND nth > 1 THEN 'skipped_duplicate' ELSE 'applied' END AS v FROM a), y AS (SELECT p.file, p.agent, CASE WHEN t.taken THEN 'errors' ELSE coalesce(x.v, p.verdict) END AS v FROM p LEFT JOIN x ON x.doc_id = p.doc_id LEFT JOIN ins t ON t.doc_id = p.doc_id)
SELECT file, agent, CAST(2 AS BIGINT) AS version, TIMESTAMP '{NOW}' AS committed_at, count(*) AS entries, count(*) FILTER (v = 'applied') AS applied, count(*) FILTER (v = 'skipped_no_change') AS skipped_no_change, count(*) FILTER (v = 'skipped_duplicate') AS skipped_duplicate, count(*) FILTER (v = 'errors') AS errors FROM y GROUP BY 1, 2""",
    "activate_rows": f"""WITH {_REV} SELECT id, CASE WHEN id % 5 = 0 THEN 'approved' ELSE moderation_status END AS moderation_status, CASE WHEN id % 7 = 0 THEN false WHEN id % 5 = 0 THEN true ELSE id % 2 = 0 END AS is_active, CASE WHEN id % 5 = 0 THEN 'admin-console' END AS reviewed_by,
 CASE WHEN id % 5 = 0 THEN TIMESTAMP '{NOW}' END AS reviewed_at, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN TIMESTAMP '{NOW}' END AS updated_at FROM rev""",
    "edit_verdicts": f"WITH {_EDITS} SELECT id, error FROM ev",
    "edited_rows": f"""WITH {_EDITS} SELECT p_partkey AS id, CASE WHEN h_name THEN name ELSE p.p_name END AS name, CASE WHEN h_url THEN url ELSE 'https://x.example' END AS url, CASE WHEN h_state THEN state END AS state, CASE WHEN h_type THEN type ELSE p_type END AS type,
 CASE WHEN h_min THEN TRY_CAST(gmin AS INTEGER) ELSE 9 END AS grade_min, CASE WHEN h_max THEN CAST(gmax AS INTEGER) END AS grade_max, CASE WHEN h_tags THEN tags END AS tags FROM part p LEFT JOIN (SELECT * FROM ev WHERE error IS NULL) v ON v.id = p_partkey""",
    "queue_survivors": "SELECT q.p_partkey AS id, s.p_name AS name, s.p_partkey % 5 <> 0 AS is_active FROM part q LEFT JOIN part s ON q.p_partkey % 2 = 0 AND s.p_partkey = q.p_partkey + 5 WHERE q.p_partkey % 3 = 0",
    "cleaned_updates": """WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN trim(p_name) END AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS org, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type END AS type, CASE WHEN p_partkey % 2 = 0 THEN 'Free' END AS price,
 CASE WHEN p_size % 16 BETWEEN 9 AND 12 THEN CAST(p_size % 16 AS VARCHAR) END AS grade_min, nullif(array_to_string(list_filter(string_split(p_name, ' '), lambda t: t IN ('red', 'gear', 'small', 'widget')), '|'), '') AS subject_tags FROM part)
SELECT id, '{' || concat_ws(',', '"name":"' || name || '"', '"org":"' || org || '"', '"type":"' || type || '"', '"price":"' || price || '"', '"grade_min":"' || grade_min || '"', '"subject_tags":"' || subject_tags || '"') || '}' AS changes FROM c""",
    "changed_rows": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0 OR (CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END) IS DISTINCT FROM (CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END)",
    "submissions": f"""SELECT 'us' || page_id AS id, 'Page ' || page_id AS name, CASE WHEN page_id % 3 = 0 THEN 'Internship' ELSE (['Program', 'Internship', 'Research', 'Competition', 'Conference', 'Journal', 'Program'])[page_id % 7 + 1] END AS type, 'pending_review' AS moderation_status,
 CASE WHEN page_id % 5 IN (0, 2, 3) THEN 'submitted URL is a sub-page (faq/about/apply/etc), not the opportunity''s main page' ELSE '' END AS flags, CASE WHEN page_id % 2 = 0 THEN 'https://apply.example' ELSE regexp_extract(url, '^[^/]*//[^/?#]*') || '/' || (['FAQ', 'program', 'apply/', 'sign-up?x=1', ''])[page_id % 5 + 1] END AS apply_url,
 'apply_url' || CASE WHEN page_id % 4 = 0 THEN '|note' ELSE '' END || '|section' AS details FROM pages""",
    "unique_slugs": r"""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN 'opportunity' ELSE left(regexp_replace(regexp_replace(lower(p_name || CASE WHEN p_partkey % 45 = 7 THEN ' 2' WHEN p_partkey % 61 = 3 THEN ' 3' WHEN p_partkey % 55 = 9 THEN ' 2 2' WHEN p_partkey % 97 = 5 THEN ' 03' ELSE '' END), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50) END AS s FROM part),
t AS (SELECT DISTINCT left(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), 50) || CASE WHEN p_partkey % 2 = 0 THEN '-3' ELSE '' END AS s FROM part WHERE p_partkey % 83 = 1),
r AS (SELECT *, regexp_replace(s, '(-[0-9]+)+$', '') AS root FROM n), q AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id) AS i FROM r),
u AS (SELECT root, list(s) AS used FROM (SELECT s, regexp_replace(s, '(-[0-9]+)+$', '') AS root FROM t) GROUP BY 1),
w AS (SELECT q0.root, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS slug, coalesce(u.used, CAST([] AS VARCHAR[])) AS used FROM (SELECT DISTINCT root FROM q) q0 LEFT JOIN u ON u.root = q0.root
UNION ALL SELECT root, i, id, slug, list_append(used, slug) FROM (SELECT q.root, q.i, q.id, w.used, CASE WHEN NOT list_contains(w.used, q.s) THEN q.s ELSE q.s || '-' || list_min(list_filter(range(2, len(w.used) + 3), lambda k: NOT list_contains(w.used, q.s || '-' || k))) END AS slug FROM w JOIN q ON q.root = w.root AND q.i = w.i + 1))
SELECT id, slug FROM w WHERE i > 0""",
    "low_value_urls": f"SELECT page_id, page_id % 26 < {len(urls.LOW_VALUE)} AS low_value FROM pages",
    "listing_merge": """WITH p AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*') AS site FROM pages), k AS (SELECT DISTINCT lower(site) AS key FROM p WHERE page_id % 4 = 0),
n AS (SELECT page_id, CASE WHEN page_id % 9 = 1 THEN '' ELSE site END AS url, lower(CASE WHEN page_id % 9 = 1 THEN '' ELSE site END) AS key FROM p WHERE page_id % 4 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS nth FROM n)
SELECT 'w' || page_id AS id, 'old' AS name, site AS url, 'Program' AS type, NULL AS price, NULL AS location, NULL AS tags, true AS is_active, 'legacy-seed' AS source FROM p WHERE page_id % 4 = 0
UNION ALL SELECT NULL, 'T' || page_id, url, coalesce((['Program', 'Program', 'Research', 'Internship', 'Competition', 'Volunteer', 'Journal', 'Conference', 'Program'])[page_id % 10 + 1], 'Program'), (['Free', 'Paid', NULL])[page_id % 3 + 1], CASE WHEN page_id % 2 = 0 THEN 'Remote' END, (['a|b', 'solo', 'plain', NULL, NULL])[page_id % 5 + 1], NULL, 'finder'
FROM o WHERE key = '' OR (nth = 1 AND key NOT IN (SELECT key FROM k))""",
    "keyed_accounts": "SELECT CAST(c_custkey AS VARCHAR) AS userid, c_name AS name, c_nationkey AS nation FROM customer",
    "seed_list": f"WITH {_SEEDS} SELECT id, mode, sort_order FROM seeds WHERE mode = 'national' AND is_enabled",
    "seed_fallback": f"WITH {_SEEDS} SELECT NULL AS id, 'abroad' AS mode, 'summer camps' AS angle, 0 AS sort_order UNION ALL SELECT NULL, 'abroad', 'open labs', 1 UNION ALL SELECT id, mode, angle, sort_order FROM seeds WHERE mode = 'seattle' AND is_enabled",
    "seed_migration": f"WITH {_SEEDS} SELECT mode, category, angle || 'more' AS angle FROM seeds WHERE id % 3 <> 0",
    "seeds_by_id": f"WITH {_SEEDS}, w(place, id) AS (VALUES (0, 9), (1, 3), (2, 999999999), (3, 9), (4, 4)) SELECT place, CAST(w.id AS BIGINT) AS id, mode, s.id IS NOT NULL AS found FROM w LEFT JOIN seeds s ON s.id = w.id",
    "seeds_by_place": f"WITH {_SEEDS}, w(place, idx) AS (VALUES (0, 2), (1, 0), (2, 2)), l AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY sort_order, id) - 1 AS idx FROM seeds) SELECT place, w.idx AS \"at\", id, mode FROM w JOIN l ON l.idx = w.idx",
    "seed_creation": f"""WITH {_SEEDS}, n AS (SELECT n_nationkey AS pos, (['national', 'seattle', 'moon', ''])[n_nationkey % 4 + 1] AS mode, CASE WHEN n_nationkey % 5 <> 1 THEN n_name END AS angle, CASE WHEN n_nationkey % 8 = 0 THEN 99 END AS sort_order FROM nation),
e AS (SELECT *, CASE WHEN mode = '' OR angle IS NULL THEN 'blank' WHEN mode = 'moon' THEN 'unknown_mode' END AS error FROM n), t AS (SELECT mode, max(sort_order) AS top FROM seeds GROUP BY 1)
SELECT pos, e.mode, CASE WHEN error IS NULL AND sort_order IS NULL THEN CAST(top + row_number() OVER (PARTITION BY e.mode, error IS NULL AND sort_order IS NULL ORDER BY pos) AS INTEGER) ELSE sort_order END AS sort_order, error FROM e LEFT JOIN t ON t.mode = e.mode""",
    "seeds_per_mode": f"WITH {_SEEDS} SELECT mode, count(*) AS n FROM seeds GROUP BY 1",
    "seed_results": f"""WITH {_SEEDS}, r AS (SELECT o_orderkey % 90 AS id, count(*) AS runs, sum(3) AS found, sum(o_orderkey % 3) AS added, count(*) AS dupes, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS cost, max(o_orderdate) AS ran FROM orders GROUP BY 1)
SELECT s.id, mode, CAST(coalesce(runs, 0) AS BIGINT) AS total_runs, CAST(total_found + coalesce(found, 0) AS BIGINT) AS total_found, ran AS last_run_at, CAST(1 + coalesce(added, 0) AS BIGINT) AS total_added, CAST(coalesce(dupes, 0) AS BIGINT) AS total_dupes, CAST(coalesce(cost, 0) AS DECIMAL(18,4)) AS total_cost FROM seeds s LEFT JOIN r ON r.id = s.id""",
    "run_tallies": """WITH l AS (SELECT l_orderkey AS run, (l_partkey + l_linenumber) % 4 AS v, CASE WHEN l_orderkey % 5 <> 0 THEN l_linenumber % 2 END AS w FROM lineitem)
SELECT run, count(*) AS found, count(*) FILTER (v = 0) AS added, count(*) FILTER (v = 1) AS dupes, count(*) FILTER (v = 2) AS invalid, count(*) FILTER (v = 3) AS errors, sum(coalesce(w, 0)) = 0 AS silent FROM l GROUP BY 1""",
}
