"""Queries over prompts, transcripts, profiles and nested entries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dates, extract, nested, text
from quillspark.operators import costs, editing, profiles, search, tracker
from quillspark.plans.search import SECTION_KINDS
from quillspark.sources import bindings as b

TODAY = b.AS_OF_ORDERS


def _pick(key, *values):
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def json_ids(spark, d):
    """Ids named in JSON text, first seen first."""
    e = b.table(spark, d, "events")
    one = lambda c: F.concat(F.lit('{"id" : "u'), c.cast("string"), F.lit('", "n": 1}'))
    t = F.concat_ws(",", one(F.col("user_id")), one(F.col("event_id") % 7), one(F.col("user_id")), F.lit('{"idx": "no"}'))
    return e.select("event_id", F.array_join(extract.ids(t), "|").alias("ids"))


def prompt_candidates(spark, d):
    p = b.table(spark, d, "part")
    rows = F.concat(F.lit('[{"id": "a'), F.col("p_partkey").cast("string"), F.lit('", "name": "'), "p_name", F.lit('"}, {"id": "b", "other": 1}'), F.when(F.col("p_partkey") % 5 == 0, "").otherwise("]"))
    prompt = F.concat(F.lit("My passion project:  "), "p_name", F.lit("\n"), "p_name", F.lit(" "), "p_name", F.lit(" one two three four five\n\nCandidate opportunities (JSON): "), rows, F.lit("\n\nSelect the best"))
    found = extract.candidates(prompt, "id:string,name:string")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(F.transform(found, lambda c: c["id"]), "|").alias("candidates"), extract.snippet(prompt).alias("snippet"))


def student_lines(spark, d):
    """Transcripts of the conversations' turns, in which users are students."""
    c = b.table(spark, d, "conversations")
    line = F.concat(F.when(F.col("role") == "user", F.when(F.col("turn") % 2 == 0, "Student:").otherwise("STUDENT: ")).otherwise("Coach: "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    told = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    return told.select("conv_id", F.md5(extract.student_lines(F.col("t"))).alias("said_md5"))


def transcript_exchange(spark, d):
    p = b.table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, "YOU: Why?").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("You: Why? Now?\n\nstudent: because: of "), "p_brand")).otherwise(F.concat(F.lit("Other: x\nStudent:"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("  ")))
    t = F.concat(F.lit("Intro. CONVERSATION SO FAR:\nYou: What do you like?\nStudent: "), "p_name", F.lit("\n"), tail, F.lit("\n\nRespond in one line. Respond now."))
    pair = extract.last_exchange(t)
    return p.select(F.col("p_partkey").alias("id"), pair["question"].alias("question"), pair["answer"].alias("answer"))


def entry_fields(spark, d):
    p = b.table(spark, d, "part")
    url = F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string"))
    whole = F.concat(F.lit("Opportunity:  "), "p_name", F.lit(" ("), "p_brand", F.lit(")\nURL: "), url, F.lit("\nKnown info: "), "p_type", F.lit("\nmore\n\nrest"))
    short = F.concat(F.lit("URL: "), url, F.lit(" now\nExtra context: "), "p_type", F.lit(" \nend"))
    found = extract.entry_fields(F.when(F.col("p_partkey") % 4 == 0, "nothing").when(F.col("p_partkey") % 4 == 1, short).otherwise(whole))
    return p.select(F.col("p_partkey").alias("id"), found["name"].alias("name"), found["org"].alias("org"), found["url"].alias("url"), found["summary"].alias("summary"))


def preview_lines(spark, d):
    o = b.table(spark, d, "orders")
    line = F.concat(F.lit('PREVIEW_JSON: {"count": '), (F.col("o_orderkey") % 9).cast("string"), F.lit(', "label": "x"'))
    out = F.concat(F.lit("starting\n"), line, F.lit("}\n"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(line, F.lit("\ndone"))).when(F.col("o_orderkey") % 4 == 1, 'PREVIEW_JSON:{"count": 77}').otherwise(" PREVIEW_JSON: no"))
    found = extract.preview(out)
    return o.select("o_orderkey", found["count"].alias("count"), found["label"].alias("label"))


def unwrapped_answers(spark, d):
    k = F.col("p_partkey")
    answer = _pick(k, '["a", "b"]', '{"n": 1, "tags": ["c"], "more": ["d"]}', '{"n": 1}', "oops", "", '["x", 3]')
    return b.table(spark, d, "part").select(k.alias("id"), F.array_join(extract.unwrapped(answer), "|").alias("items"))


def profile_sections(spark, d):
    p = b.table(spark, d, "part")
    t = F.concat(F.lit("About "), "p_name", F.lit(".\n \nPassion Projects:  "), "p_brand", F.lit("\n\n\n"), F.when(F.col("p_partkey") % 2 == 0, "research project: maps").otherwise("  "), F.lit("\n\nPassion project: last"))
    s = extract.sections(t)
    return p.select(F.col("p_partkey").alias("id"), F.array_join(s["passion"], "|").alias("passion"), F.array_join(s["research"], "|").alias("research"), F.array_join(s["general"], "|").alias("general"))


def legacy_profiles(spark, d):
    p = b.table(spark, d, "part")
    old = F.concat(F.lit('{"interests": [{"text": "'), "p_name", F.lit('"}, {"text": "art"}], "passionProjects": '), F.when(F.col("p_partkey") % 2 == 0, '[{"text": "boats"}]').otherwise("[]"), F.lit("}"))
    new = F.concat(F.lit('{"synthesized": "Likes '), "p_brand", F.lit('", "interests": [{"text": "x"}]}'))
    return p.select(F.col("p_partkey").alias("id"), extract.legacy_profile(F.when(F.col("p_partkey") % 3 == 0, new).otherwise(old)).alias("profile"))


def profile_sufficiency(spark, d):
    """Which texts say enough to match by (20 words), and which too little to start a talk from (under 50)."""
    docs = b.table(spark, d, "documents")
    n = text.word_count(F.col("text"))
    return docs.select("doc_id", (n >= 20).alias("enough"), (n < 50).alias("thin"))


TYPES = ("ECONOMY", "PROMO", "SMALL")


def candidate_rows(spark, d):
    p = b.table(spark, d, "part")
    k = F.col("p_partkey")
    t = F.concat(F.lit('{"name": "'), F.when(k % 6 == 0, " ").otherwise(F.col("p_name")), F.lit(' ", "url": "https://x", "type": "'), "p_type", F.lit('", "price": "'), _pick(k, "Free", "free", "Paid"), F.lit('", "grade_min": '), _pick(k, "9", '"ten"', "null", "11"), F.lit(', "subject_tags": '), _pick(k, '["a","b"]', '"solo"', "null", "[]", '""'), F.lit("}"))
    row = extract.candidate_row(t, F.lit("SEEDED"), TYPES, {"price": ("Free", "Paid")})
    return p.select(k.alias("id"), row.alias("r")).select("id", "r.name", "r.type", "r.price", "r.grade_min", F.array_join("r.subject_tags", "|").alias("tags"), F.col("r").isNotNull().alias("valid"))


def emails(spark, d):
    c = b.table(spark, d, "customer")
    raw = F.concat(F.lit(" "), F.regexp_replace("c_name", "[# ]", _pick(F.col("c_custkey"), "", ".", " ", "@")), _pick(F.col("c_custkey"), "@Mail.example", "@mail", "@a.b"), F.lit(" "))
    return c.select("c_custkey", text.email(raw).alias("email"))


def signup_consent(spark, d):
    """Whether an account may be made; some answers are missing."""
    c = b.table(spark, d, "customer")
    given = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") > 0)
    return c.select("c_custkey", text.consent_error(F.col("c_nationkey") % 2 == 0, F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), given).alias("error"))


def code_defaults(spark, d):
    """Codes that answers gave, and what stands for those that are none: whether an entry runs, a verdict, a tier."""
    o = b.table(spark, d, "orders")
    runs = F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "not_running").otherwise(F.col("o_orderstatus"))
    verdict = F.lower(F.regexp_replace("o_orderpriority", "^1-URGENT$", "Positive"))
    tier = F.when(F.col("o_orderpriority").startswith("2"), "strong").when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority"))
    return o.select("o_orderkey", text.known_or_default(runs, text.RUN_STATUS).alias("run_status"), text.known_or_default(verdict, text.VERDICT).alias("verdict"), text.known_or_default(tier, text.TIER).alias("tier"))


def code_maps(spark, d):
    """Buckets of kinds and types of sections, with their defaults; hues of keys."""
    p = b.table(spark, d, "part")
    k = F.col("p_partkey")
    of = lambda known, key, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), key), F.lit(other))
    bucket = of(SECTION_KINDS, _pick(k, *SECTION_KINDS, "none"), "summerPrograms")
    return p.select(k.alias("id"), bucket.alias("bucket"), of(editing.SECTION_TYPES, bucket, "Program").alias("type"), extract.hue(F.col("p_name")).alias("hue"))


def _dates(k):
    """Date arrays with gaps: null, empty and repeated dates, and some without label or type."""
    one = lambda day, label, kind: F.struct(day.alias("date"), label.alias("label"), kind.alias("type"))
    day = lambda n: F.date_format(F.date_add(F.to_date(F.lit("1998-06-01")), ((k * n) % 97).cast("int")), "yyyy-MM-dd")
    return F.array(one(day(5), F.lit("Final"), F.lit("deadline")), one(F.when(k % 3 == 0, day(11)), F.lit("x"), F.lit("other")), one(F.when(k % 4 == 0, "").otherwise(day(7)), F.lit(""), F.lit(None).cast("string")))


def valid_dates(spark, d):
    p = b.table(spark, d, "part")
    each = p.select(F.col("p_partkey").alias("id"), F.posexplode(nested.valid_dates(_dates(F.col("p_partkey")))).alias("place", "x"))
    return each.select("id", "place", "x.*")


def unified_dates(spark, d):
    """Entries of the older shape (an opening date and deadlines) next to those that have dates already."""
    k = F.col("p_partkey")
    listed = F.transform(_dates(k), lambda x: F.struct(x["date"].alias("date"), x["label"].alias("label")))
    out = nested.unified_dates(F.when(k % 5 == 0, _dates(k)), F.when(k % 2 == 0, "1998-06-01"), F.when(k % 7 != 0, listed))
    return b.table(spark, d, "part").select(k.alias("id"), F.array_join(F.transform(out, lambda x: F.concat_ws("/", x["date"], x["label"], x["type"])), "|").alias("dates"))


def with_openings(spark, d):
    k = F.col("p_partkey")
    typed = F.transform(_dates(k), lambda x: x.withField("type", F.when(k % 3 == 1, F.lit("opens")).otherwise(x["type"])))
    out = dates.with_opening(typed, F.when(k % 4 != 1, "1998-05-01"))
    return b.table(spark, d, "part").select(k.alias("id"), F.size(out).cast("long").alias("n"), out[0]["type"].alias("first"))


def cleaned_lists(spark, d):
    p = b.table(spark, d, "part")
    k = F.col("p_partkey")
    tags = F.when(k % 6 != 0, F.split(F.concat_ws(",", "p_name", F.lit(" , b "), "p_brand", F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f")), ","))
    source = lambda u: F.struct(u.alias("url"), F.lit("n").alias("note"))
    sources = F.array(source(F.when(k % 2 == 0, "u0")), source(F.lit("")), source(F.lit("u2")), source(F.lit("u3")), source(F.lit("u4")))
    return p.select(k.alias("id"), F.array_join(nested.clean_tags(tags), "|").alias("tags"), F.array_join(F.transform(nested.clean_sources(sources), lambda s: s["url"]), "|").alias("sources"), F.array_join(nested.requirements(F.split(F.lit("a b c d e f"), " ")), "").alias("requirements"))


def _actions(k):
    one = lambda t, u: F.struct(F.lit(t).alias("text"), F.lit(u).cast("string").alias("url"))
    listed = F.slice(F.array(one("call", "http://c"), one("write", ""), one("sign", None), one("pay", None), one("go", None), one("rest", None)), F.lit(1), (k % 7).cast("int"))
    return nested.with_generic_actions(k.cast("string"), nested.action_items(k.cast("string"), listed))


def action_lists(spark, d):
    p = b.table(spark, d, "part")
    each = p.select(F.explode(_actions(F.col("p_partkey"))).alias("a"))
    return each.select("a.*")


def action_cycle(spark, d):
    """Two clicks on the first action of every entry, one on the second."""
    k = F.col("p_partkey")
    key = lambda i: F.concat(k.cast("string"), F.when(k % 7 == 0, "-gt").otherwise("-t"), F.lit(str(i)))
    moved = nested.cycled(nested.cycled(nested.cycled(_actions(k), key(0)), key(0)), key(1))
    return b.table(spark, d, "part").select(F.explode(moved).alias("a")).select("a.id", "a.state")


def action_counts(spark, d):
    k = F.col("p_partkey")
    moved = nested.cycled(_actions(k), F.concat(k.cast("string"), F.lit("-t0")))
    return tracker.action_counts(b.table(spark, d, "part").select(k.alias("id"), moved.alias("actions")))


def settings_overlay(spark, d):
    k = F.col("p_partkey")
    defaults = F.create_map(F.lit("delay"), F.lit("5"), F.lit("limit"), F.lit("100"), F.lit("note"), F.lit(""))
    given = F.create_map(F.lit("delay"), F.when(k % 2 == 0, "9"), F.lit("extra"), F.when(k % 3 == 0, "x"))
    out = nested.without_empty(nested.overlaid(defaults, given))
    return b.table(spark, d, "part").select(k.alias("id"), F.array_join(F.array_sort(F.transform(F.map_entries(out), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|").alias("settings"))


def starter_rotation(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(nested.rotated(("a", "b", "c", "d", "e", "f", "g", "h"), F.col("p_partkey")), "").alias("set"))


def _items(spark, d):
    rows = b.tracker_items(spark, d)
    return rows.withColumns({"bucket": _pick(F.col("id"), "internships", "journals", "conferences"), "saved": F.col("id") % 6 == 0})


def saved_split(spark, d):
    visible, saved = tracker.split_saved(_items(spark, d))
    return visible.select("id", F.lit("visible").alias("list")).unionByName(saved.select("id", F.lit("saved").alias("list")))


def toggled_items(spark, d):
    """A click on every tenth item's saved mark, two on every twentieth; every fifteenth is deleted."""
    items = _items(spark, d)
    clicks = items.filter("id % 10 = 0").select("id").unionByName(items.filter("id % 20 = 0").select("id"))
    return tracker.toggled(items, clicks, items.filter("id % 15 = 0").select("id")).select("id", "saved")


def home_stats(spark, d):
    """Status counts of the items that are not saved for later."""
    visible, _ = tracker.split_saved(_items(spark, d))
    return tracker.status_counts(visible, TODAY)


def tracked_totals(spark, d):
    return tracker.totals(_items(spark, d))


def selection_plan(spark, d):
    """Selected results by bucket: those tracked already and those to fetch."""
    o = b.table(spark, d, "orders")
    picked = o.select(F.col("o_orderkey").alias("id"), _pick(F.col("o_custkey"), "summer", "journal", "other").alias("kind"))
    return tracker.selection_plan(picked, _items(spark, d).filter("id % 2 = 0"), SECTION_KINDS, "summerPrograms")


def merged_checks(spark, d):
    items = b.tracker_items(spark, d).select("id", "run_status", "was_estimated")
    checks = items.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "not_running").alias("run_status"), F.when(F.col("id") % 5 == 0, True).alias("was_estimated"))
    return tracker.merged(items, checks)


def tag_enrichment(spark, d):
    """Tags of an entry with what an answer says of them: by the tag it echoes, else by position; every tag stays."""
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.posexplode(F.split("p_name", " ")).alias("place", "tag"))
    answers = p.filter("place < 2").select("id", F.when(F.col("id") % 2 == 0, 1 - F.col("place")).otherwise(F.col("place")).alias("place"), F.when(F.col("id") % 3 == 0, F.col("tag")).when(F.col("id") % 3 == 1, "unknown").alias("echo"), F.concat(F.lit("about "), "tag").alias("intent"))
    return search.enriched_tags(p, answers)


KINDS = {"small": (["SMALL"], False), "rare": (["NOSUCH"], True), "promo": (["PROMO", "ECONOMY"], False)}
ABOUT = "I like red gears and small widgets, I am a sophomore"


def kind_search(spark, d):
    """Rankings of several kinds at once: pool by kind, ranked by score; a row may come under two kinds and stays under both."""
    rows = b.catalog(spark, d)
    return search.across_kinds(rows, KINDS, ABOUT, F.concat_ws(" ", "name", "org"), 12, 4)


def many_profiles(spark, d):
    """Every customer's profile, which tells of the parts of their first order, against the whole catalog, kind by kind."""
    o, l, p, c = (b.table(spark, d, t) for t in ("orders", "lineitem", "part", "customer"))
    first = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("f")).select("c_custkey", F.col("f.o_orderkey").alias("l_orderkey"))
    bought = first.join(l, "l_orderkey").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ", ").alias("names"), F.min("p_type").alias("hint"))
    about = F.concat(F.lit("I like "), F.coalesce("names", F.lit("nothing yet")), F.when(F.col("c_nationkey") % 3 != 0, F.concat(F.lit(". Grade "), 6 + F.col("c_nationkey") % 7)).otherwise(""))
    rows = c.join(bought, "c_custkey", "left").select(F.col("c_custkey").alias("profile"), about.alias("about"), F.when(F.col("c_custkey") % 4 != 0, F.array(F.split("names", " ")[0], "hint")).alias("hints"))
    rows = rows.withColumn("grade", text.grade(F.col("about")))
    asked, placed = profiles.rankings(rows, b.catalog(spark, d), F.concat_ws(" ", "name", "org"), F.split("name", " "), KINDS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",")
    answers = placed.groupBy("query", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.md5(ids).alias("ids_md5"))
    return asked.join(answers, "query").select("profile", "kind", "n", "score", "ids_md5")


def type_search(spark, d):
    """One kind with price and place preferences, which are given up where fewer than 20 remain."""
    rows = b.catalog(spark, d)
    return search.by_kind(rows, ["PROMO"], ABOUT, F.concat_ws(" ", "name", "org"), (F.col("price") == "free") & (F.col("org") == "Brand#7"), 10).select("id", "score")


def result_pages(spark, d):
    """The third page of ten results."""
    return search.page(b.catalog(spark, d).orderBy("name", "id"), 3, 10).select("id", "name")


def surface_days(spark, d):
    return costs.surface_days(b.user_costs(spark, d))


QUERIES = {f.__name__: f for f in (json_ids, prompt_candidates, student_lines, transcript_exchange, entry_fields, preview_lines, unwrapped_answers, profile_sections, legacy_profiles, profile_sufficiency, candidate_rows, emails, signup_consent, code_defaults, code_maps, valid_dates, unified_dates, with_openings, cleaned_lists, action_lists, action_cycle, action_counts, settings_overlay, starter_rotation, saved_split, toggled_items, home_stats, tracked_totals, selection_plan, merged_checks, tag_enrichment, kind_search, many_profiles, type_search, result_pages, surface_days)}

_DAY = "strftime(DATE '1998-06-01' + CAST(k * {0} % 97 AS INTEGER), '%Y-%m-%d')"
_P = "p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_size FROM part)"
_RAW = f"r AS (SELECT k, 0 AS i, {_DAY.format(5)} AS date, 'Final' AS label, 'deadline' AS type FROM p UNION ALL SELECT k, 1, CASE WHEN k % 3 = 0 THEN {_DAY.format(11)} END, 'x', 'other' FROM p UNION ALL SELECT k, 2, CASE WHEN k % 4 = 0 THEN '' ELSE {_DAY.format(7)} END, '', NULL FROM p)"
_ACT = """acts AS (SELECT k, CAST(k AS VARCHAR) || CASE WHEN k % 7 = 0 THEN '-gt' ELSE '-t' END || i AS id, i, CASE WHEN k % 7 = 0 THEN (['Confirm the exact deadline and requirements on the official site', 'Gather required materials (transcripts, recommendation letters, etc.)', 'Complete and submit the application'])[i + 1] ELSE (['call', 'write', 'sign', 'pay', 'go'])[i + 1] END AS text,
 CASE WHEN k % 7 > 0 AND i = 0 THEN 'http://c' END AS url FROM (SELECT k, unnest(range(0, CASE WHEN k % 7 = 0 THEN 3 ELSE least(k % 7, 5) END)) AS i FROM p))"""
_ITEMS = """l AS (SELECT l_orderkey AS id, CAST(l_shipdate AS DATE) AS date, l_returnflag AS type FROM lineitem), items AS (SELECT id, CASE WHEN id % 23 = 0 THEN 'completed' WHEN min(date) >= DATE '1998-07-01' THEN 'not_started' WHEN max(date) >= DATE '1998-06-30' THEN 'in_progress' WHEN max(type) = 'R' AND id % 19 <> 0 THEN 'not_started' ELSE 'completed' END AS status,
 (['internships', 'journals', 'conferences'])[id % 3 + 1] AS bucket, id % 6 = 0 AS saved, max(type) = 'R' AS was_estimated, CASE WHEN id % 23 = 0 THEN 'not_running' WHEN id % 19 = 0 THEN 'unknown' ELSE 'running' END AS run_status FROM l GROUP BY 1)"""
_CAT = "cat AS (SELECT p_partkey AS id, p_name AS name, p_brand AS org, p_type AS type, p_retailprice < 1200 AS free, CASE WHEN p_partkey % 9 <> 0 THEN p_size % 12 END AS lo, CASE WHEN p_partkey % 8 <> 0 THEN p_size % 12 + 3 END AS hi FROM part), ok AS (SELECT *, " + " + ".join(f"CAST(contains(lower(name || ' ' || org), '{t}') AS INTEGER)" for t in ("red", "gears", "small", "widgets", "sophomore")) + " AS score, coalesce(lo, 10) <= 10 AND coalesce(hi, 10) >= 10 AS fits FROM cat)"


def _kind(name: str, types: str, least: int) -> str:
    return f"""{name}_p AS (SELECT * FROM ok WHERE fits AND ((SELECT count(*) FROM ok WHERE type IN ({types})) < {least} OR type IN ({types}))), {name}_s AS (SELECT * FROM {name}_p WHERE (SELECT count(*) FROM {name}_p WHERE score > 0) < 60 OR score > 0 ORDER BY score DESC, id LIMIT 100)"""


ORACLES = {
    "json_ids": "SELECT event_id, array_to_string(CASE WHEN user_id = event_id % 7 THEN ['u' || user_id] ELSE ['u' || user_id, 'u' || (event_id % 7)] END, '|') AS ids FROM events",
    "prompt_candidates": f"WITH {_P} SELECT k AS id, CASE WHEN k % 5 = 0 THEN '' ELSE 'a' || k || '|b' END AS candidates, array_to_string(list_slice(string_split(p_name || ' ' || p_name || ' ' || p_name || ' one two three four five', ' '), 1, 12), ' ') AS snippet FROM p",
    "student_lines": r"""WITH l AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM conversations WHERE role = 'user') SELECT c.conv_id, md5(said) AS said_md5 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, string_agg(s, '; ' ORDER BY turn) AS said FROM l GROUP BY 1) USING (conv_id)""",
    "transcript_exchange": f"WITH {_P} SELECT k AS id, CASE WHEN k % 3 = 1 THEN 'Why? Now?' END AS question, CASE WHEN k % 3 = 1 THEN 'because: of ' || p_brand WHEN k % 3 = 2 AND k % 2 = 0 THEN p_name END AS answer FROM p",
    "entry_fields": f"WITH {_P} SELECT k AS id, CASE WHEN k % 4 > 1 THEN p_name END AS name, CASE WHEN k % 4 > 1 THEN p_brand END AS org, CASE WHEN k % 4 = 0 THEN '' ELSE 'https://x.example/' || k END AS url, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN p_type ELSE p_type || chr(10) || 'more' END AS summary FROM p",
    "preview_lines": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 77 ELSE o_orderkey % 9 END AS count, CASE WHEN o_orderkey % 4 > 1 THEN 'x' END AS label FROM orders",
    "unwrapped_answers": f"WITH {_P} SELECT k AS id, (['a|b', 'c', '', '', '', 'x|3'])[k % 6 + 1] AS items FROM p",
    "profile_sections": f"WITH {_P} SELECT k AS id, p_brand || '|last' AS passion, CASE WHEN k % 2 = 0 THEN 'maps' ELSE '' END AS research, 'About ' || p_name || '.' AS general FROM p",
    "legacy_profiles": f"WITH {_P} SELECT k AS id, CASE WHEN k % 3 = 0 THEN 'Likes ' || p_brand ELSE CASE WHEN k % 2 = 0 THEN 'Passion projects: boats. ' ELSE '' END || 'Interests: ' || p_name || '; art' END AS profile FROM p",
    "profile_sufficiency": r"WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\s+'), lambda w: w <> '')) AS n FROM documents) SELECT doc_id, n >= 20 AS enough, n < 50 AS thin FROM n",
    "candidate_rows": f"WITH {_P} SELECT k AS id, CASE WHEN k % 6 <> 0 THEN p_name END AS name, CASE WHEN k % 6 = 0 THEN NULL WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN p_type ELSE 'SEEDED' END AS type, CASE WHEN k % 6 <> 0 THEN (['Free', NULL, 'Paid'])[k % 3 + 1] END AS price, CASE WHEN k % 6 <> 0 THEN ([9, NULL, NULL, 11])[k % 4 + 1] END AS grade_min, CASE WHEN k % 6 <> 0 THEN (['a|b', 'solo', NULL, NULL, NULL])[k % 5 + 1] END AS tags, k % 6 <> 0 AS valid FROM p",
    "emails": r"""WITH e AS (SELECT c_custkey, lower(trim(' ' || regexp_replace(c_name, '[# ]', (['', '.', ' ', '@'])[c_custkey % 4 + 1], 'g') || (['@Mail.example', '@mail', '@a.b'])[c_custkey % 3 + 1] || ' ')) AS e FROM customer) SELECT c_custkey, CASE WHEN regexp_matches(e, '^[^\s@,()\x22\x27]+@[^\s@,()\x22\x27]+\.[^\s@,()\x22\x27]{2,}$') THEN e END AS email FROM e""",
    "signup_consent": "WITH c AS (SELECT c_custkey, c_nationkey % 2 = 0 AS adult, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS guardian, c_custkey % 9 <> 0 AND c_acctbal > 0 AS terms FROM customer) SELECT c_custkey, CASE WHEN NOT terms THEN 'terms' WHEN NOT adult AND NOT guardian THEN 'guardian' END AS error FROM c",
    "code_defaults": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'not_running' ELSE 'unknown' END AS run_status, CASE WHEN o_orderpriority = '1-URGENT' THEN 'positive' ELSE 'insufficient_data' END AS verdict, CASE WHEN o_orderpriority LIKE '2%' THEN 'strong' ELSE 'look' END AS tier FROM orders",
    "code_maps": f"WITH {_P}, b AS (SELECT k, (['summerPrograms', 'internships', 'researchCompetitions', 'pureCompetitions', 'conferences', 'journals', 'summerPrograms'])[k % 7 + 1] AS bucket FROM p) SELECT k AS id, bucket, CASE bucket WHEN 'summerPrograms' THEN 'Program' WHEN 'internships' THEN 'Internship' WHEN 'researchCompetitions' THEN 'Research' WHEN 'pureCompetitions' THEN 'Competition' WHEN 'conferences' THEN 'Conference' ELSE 'Journal' END AS type, abs(CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: c + ((h * 32 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 - h) AS DOUBLE) * 137.508) % 360 AS hue FROM b JOIN p USING (k)",
    "valid_dates": f"WITH {_P}, {_RAW}, v AS (SELECT k, date, coalesce(nullif(label, ''), 'Date') AS label, coalesce(nullif(type, ''), 'deadline') AS type FROM r WHERE coalesce(date, '') <> '') SELECT k AS id, CAST(row_number() OVER (PARTITION BY k ORDER BY date, label, type) - 1 AS INTEGER) AS place, date, label, type FROM v",
    "unified_dates": f"""WITH {_P}, {_RAW}, u AS (SELECT k, i, CASE WHEN k % 5 = 0 THEN concat_ws('/', date, label, type) ELSE date || '/' || coalesce(nullif(label, ''), 'Deadline') || '/deadline' END AS s FROM r WHERE k % 5 = 0 OR (k % 7 <> 0 AND coalesce(date, '') <> '') UNION ALL SELECT k, -1, '1998-06-01/Opens/opens' FROM p WHERE k % 2 = 0 AND k % 5 <> 0)
SELECT k AS id, coalesce(string_agg(s, '|' ORDER BY i), '') AS dates FROM p LEFT JOIN u USING (k) GROUP BY 1""",
    "with_openings": f"WITH {_P} SELECT k AS id, CASE WHEN k % 3 = 1 OR k % 4 = 1 THEN 3 ELSE 4 END AS n, CASE WHEN k % 3 = 1 THEN 'opens' WHEN k % 4 = 1 THEN 'deadline' ELSE 'opens' END AS first FROM p",
    "cleaned_lists": f"WITH {_P} SELECT k AS id, CASE WHEN k % 6 <> 0 THEN concat_ws('|', p_name, 'b', p_brand, 'c', 'd') END AS tags, CASE WHEN k % 2 = 0 THEN 'u0|u2|u3' ELSE 'u2|u3|u4' END AS sources, 'abcde' AS requirements FROM p",
    "action_lists": f"WITH {_P}, {_ACT} SELECT id, text, url, 'not_started' AS state FROM acts",
    "action_cycle": f"WITH {_P}, {_ACT} SELECT id, CASE i WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' ELSE 'not_started' END AS state FROM acts",
    "action_counts": f"WITH {_P}, {_ACT} SELECT CASE WHEN i = 0 AND k % 7 > 0 THEN 'in_progress' ELSE 'not_started' END AS state, count(*) AS n FROM acts GROUP BY 1",
    "settings_overlay": f"WITH {_P} SELECT k AS id, 'delay=' || CASE WHEN k % 2 = 0 THEN '9' ELSE '5' END || CASE WHEN k % 3 = 0 THEN '|extra=x' ELSE '' END || '|limit=100' AS settings FROM p",
    "starter_rotation": f"WITH {_P} SELECT k AS id, (['abc', 'def', 'gha'])[k % 3 + 1] AS set FROM p",
    "saved_split": f"WITH {_ITEMS} SELECT id, CASE WHEN saved THEN 'saved' ELSE 'visible' END AS list FROM items",
    "toggled_items": f"WITH {_ITEMS} SELECT id, saved <> (id % 10 = 0 AND id % 20 <> 0) AS saved FROM items WHERE id % 15 <> 0",
    "home_stats": f"WITH {_ITEMS} SELECT status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM items WHERE NOT saved GROUP BY 1",
    "tracked_totals": f"WITH {_ITEMS} SELECT count(*) AS tracked, count(DISTINCT bucket) AS buckets FROM items",
    "selection_plan": f"WITH {_ITEMS}, s AS (SELECT o_orderkey AS id, (['summerPrograms', 'journals', 'summerPrograms'])[o_custkey % 3 + 1] AS bucket FROM orders) SELECT s.bucket, count(items.id) AS already, count(*) - count(items.id) AS to_fetch FROM s LEFT JOIN items ON items.id = s.id AND items.id % 2 = 0 GROUP BY 1",
    "merged_checks": f"WITH {_ITEMS} SELECT id, CASE WHEN id % 6 = 0 THEN 'not_running' ELSE run_status END AS run_status, CASE WHEN id % 15 = 0 THEN true ELSE was_estimated END AS was_estimated FROM items",
    "tag_enrichment": f"""WITH {_P}, t AS (SELECT k AS id, unnest(string_split(p_name, ' ')) AS tag, unnest(range(0, len(string_split(p_name, ' ')))) AS place FROM p),
a AS (SELECT id, CASE WHEN id % 2 = 0 THEN 1 - place ELSE place END AS place, CASE WHEN id % 3 = 0 THEN tag WHEN id % 3 = 1 THEN 'unknown' END AS echo, 'about ' || tag AS intent FROM t WHERE place < 2),
m AS (SELECT a.id, a.place, a.intent, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.id = a.id AND t.tag = a.echo) THEN a.echo ELSE (SELECT min(t.tag) FROM t WHERE t.id = a.id AND t.place = a.place) END AS tag FROM a), f AS (SELECT id, tag, arg_min(intent, place) AS intent FROM m WHERE tag IS NOT NULL GROUP BY 1, 2)
SELECT t.id, CAST(t.place AS INTEGER) AS place, t.tag, f.intent FROM t LEFT JOIN f ON f.id = t.id AND f.tag = t.tag""",
    "kind_search": f"""WITH {_CAT}, {_kind('small', "'SMALL'", 15)}, {_kind('rare', "'NOSUCH'", 1)}, {_kind('promo', "'PROMO', 'ECONOMY'", 15)}, u AS (SELECT 'small' AS kind, id, score FROM small_s UNION ALL SELECT 'rare', id, score FROM rare_s UNION ALL SELECT 'promo', id, score FROM promo_s),
n AS (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS place FROM u) SELECT kind, CAST(place AS INTEGER) AS place, id, CASE WHEN place <= 4 THEN 'strong' ELSE 'look' END AS tier FROM n WHERE place <= 12""",
    "many_profiles": f"""WITH f AS (SELECT o_custkey AS c_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1), g AS (SELECT c_custkey, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS names, min(p_type) AS hint FROM f JOIN lineitem ON l_orderkey = k JOIN part ON p_partkey = l_partkey GROUP BY 1),
a AS (SELECT c.c_custkey AS profile, 'I like ' || coalesce(names, 'nothing yet') || CASE WHEN c_nationkey % 3 <> 0 THEN '. Grade ' || (6 + c_nationkey % 7) ELSE '' END AS about, CASE WHEN c_nationkey % 3 <> 0 THEN 6 + c_nationkey % 7 END AS grade, CASE WHEN c.c_custkey % 4 <> 0 THEN [lower(string_split(names, ' ')[1]), lower(hint)] ELSE [] END AS hints FROM customer c LEFT JOIN g ON g.c_custkey = c.c_custkey),
q AS (SELECT profile, grade, hints, list_distinct(list_filter(regexp_extract_all(lower(about), '[a-z0-9'']+'), lambda t: length(t) >= 3 AND NOT list_contains({list(text.STOPWORDS)}, t))) AS terms FROM a),
cat AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_brand) AS t, list_transform(string_split(p_name, ' '), lambda x: lower(x)) AS tags, p_type AS type, CASE WHEN p_partkey % 9 <> 0 THEN p_size % 12 END AS lo, CASE WHEN p_partkey % 8 <> 0 THEN p_size % 12 + 3 END AS hi FROM part),
kinds(kind, types, least) AS (VALUES {', '.join(f"('{k}', {t}, {1 if s else 15})" for k, (t, s) in KINDS.items())}), gate AS (SELECT kind, types, count(*) FILTER (list_contains(types, type)) >= any_value(least) AS on_ FROM kinds, cat GROUP BY 1, 2),
pool AS (SELECT kind, cat.* FROM gate JOIN cat ON NOT on_ OR list_contains(types, type)),
s AS (SELECT profile, kind, id, len(list_filter(terms, lambda w: contains(t, w))) + CASE WHEN list_has_any(tags, hints) THEN 3 ELSE 0 END AS score FROM q, pool WHERE grade IS NULL OR (coalesce(lo, grade) <= grade AND coalesce(hi, grade) >= grade)),
n AS (SELECT *, count(*) FILTER (score > 0) OVER (PARTITION BY profile, kind) AS many FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY profile, kind ORDER BY score DESC, id) AS place FROM n WHERE many < 60 OR score > 0)
SELECT profile, kind, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY place)) AS ids_md5 FROM o WHERE place <= 100 GROUP BY 1, 2""",
    "type_search": f"""WITH {_CAT}, {_kind('promo', "'PROMO'", 15)}, g AS (SELECT count(*) FILTER (free AND org = 'Brand#7') AS n FROM promo_s) SELECT id, score FROM promo_s, g WHERE n < 20 OR (free AND org = 'Brand#7') ORDER BY score DESC, id LIMIT 10""",
    "result_pages": "SELECT p_partkey AS id, p_name AS name FROM part ORDER BY p_name, p_partkey LIMIT 10 OFFSET 20",
    "surface_days": """SELECT CASE event_type WHEN 'click' THEN 'gemini' WHEN 'view' THEN 'claude' WHEN 'purchase' THEN 'deadline_check' WHEN 'error' THEN 'claude' ELSE event_type END AS surface, CAST(ts AS DATE) AS day, count(*) AS calls, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 300) AS BIGINT) AS output_tokens, CAST(sum(event_id % 4) AS BIGINT) AS web_searches,
 CAST(sum(CAST(value AS DECIMAL(14,6))) AS DECIMAL(18,6)) AS cost_usd, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2""",
}
