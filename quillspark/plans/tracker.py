"""Tracker, account and curation queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import dates, text, urls
from quillspark.operators import accounts, curation, enrich, similarity, tracker
from quillspark.sources import bindings as b
from quillspark.sources.shared import shared_dir
from quillspark.streaming import rollup

TODAY = b.AS_OF_ORDERS


def tracker_next_deadline(spark, d):
    rows = tracker.with_next(b.tracker_items(spark, d), TODAY)
    return rows.select("id", F.col("next.date").alias("next_date"), F.col("next.label").alias("label"), dates.days_until(F.col("next.date"), F.to_date(F.lit(TODAY))).alias("days"))


def tracker_milestones(spark, d):
    m = b.tracker_items(spark, d).select("id", F.explode(dates.milestones(F.col("dates"), F.to_date(F.lit(TODAY)))).alias("m"))
    return m.select("id", "m.date", "m.label", "m.past")


def tracker_status(spark, d):
    return tracker.with_status(b.tracker_items(spark, d), TODAY).select("id", "status")


def tracker_status_counts(spark, d):
    return tracker.status_counts(b.tracker_items(spark, d), TODAY)


def tracker_order(spark, d):
    return tracker.by_deadline(b.tracker_items(spark, d), TODAY).select("place", "id", "status")


def calendar_months(spark, d):
    return tracker.months(b.tracker_items(spark, d))


def calendar_headings(spark, d):
    return tracker.year_headings(tracker.calendar_rows(b.tracker_items(spark, d))).filter("heading").select("id", "index", "date")


def calendar_lanes(spark, d):
    """Dates of items in lanes by bucket and month; saved items and those that do not run are left out, missing labels and types have their defaults."""
    l, o = b.table(spark, d, "lineitem"), b.table(spark, d, "orders")
    one = F.struct("l_linenumber", F.when(F.col("l_quantity") % 11 != 0, F.to_date("l_shipdate")).alias("date"), F.when(F.col("l_linenumber") % 5 == 0, "").when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")).alias("label"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag")).alias("type"))
    dated = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["date"].alias("date"), x["label"].alias("label"), x["type"].alias("type"))).alias("dates"))
    name = F.concat(F.lit("Item "), "o_orderkey", F.lit(" "), "o_orderpriority", F.when(F.col("o_orderstatus") == "F", " of the year").otherwise(""))
    run = F.when(F.col("o_orderstatus") == "P", "not_running").when(F.col("o_custkey") % 4 != 0, "running")
    items = o.join(dated, "o_orderkey").select(F.col("o_orderkey").alias("id"), name.alias("name"), F.col("o_orderpriority").alias("bucket"), run.alias("run_status"), "dates")
    saved = o.filter("o_custkey % 6 = 0").select(F.col("o_orderkey").alias("id"))
    return tracker.calendar_lanes(items, saved, TODAY).select("bucket", "month", "date", "label", "id", "text", "type", "past", "current", "next")


def calendar_export(spark, d):
    return tracker.calendar_text(b.tracker_items(spark, d)).select("uid", F.md5("block").alias("block_md5"))


def due_soon(spark, d):
    return tracker.due(b.tracker_items(spark, d), TODAY).select("id", "due", F.col("next.date").alias("next_date"))


def palette_slots(spark, d):
    rows = b.table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("pos"))
    return tracker.colours(rows, "p_brand").select("p_brand", "slot")


def subscription_state(spark, d):
    return accounts.subscription_state(b.subscriptions(spark, d), TODAY).select("userid", "status", "access", "expired", "days_left")


def access_gate(spark, d):
    requests = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey") + F.when(F.col("o_orderkey") % 17 == 0, 10_000_000).otherwise(0)).alias("userid"))
    return accounts.access_gate(requests, b.subscriptions(spark, d), TODAY).select("request", "reason", "blocked")


def promo_redeem(spark, d):
    acc = b.subscriptions(spark, d).withColumn("ends_at", F.col("subscription_end_at")).withColumn("status", F.coalesce("status", F.lit("trial"))).withColumn("used", F.when(F.col("userid") % 4 == 0, F.array(F.lit("SPRING"))).otherwise(F.array().cast("array<string>")))
    codes = acc.select("userid", F.lit("SPRING").alias("code"), (F.col("userid") % 30 + 1).cast("int").alias("days"))
    return accounts.redeemed(acc, codes, TODAY)


def trial_start(spark, d):
    acc = b.subscriptions(spark, d).withColumnRenamed("trial_ends_at", "ends_at").withColumn("status", F.when(F.col("userid") % 3 != 0, F.coalesce("status", F.lit("trial"))))
    return accounts.trials_started(acc, TODAY)


def derived_freshness(spark, d):
    c = b.table(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", accounts.derived_fresh(F.col("text"), F.substring("text", 1, 120)).alias("fresh"))


def review_queue(spark, d):
    return curation.review_queue(b.reviewed_documents(spark, d), "queue", "src0", 500).select("id", "moderation_status")


def queue_answer(spark, d):
    """The refused rows of the queue with the rows that they are duplicates of, and the counts that go with them."""
    rows = b.reviewed_documents(spark, d).withColumn("duplicate_of", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), (F.col("id") % 50 + 1).cast("string"))).when(F.col("id") % 7 == 0, "no such row")).drop("summary")
    out = curation.queue_page(rows, b.catalog(spark, d), "rejected", None, 300)
    return out.select("id", "source", "moderation_status", "survivor", "survivor_active", "total", "of_source", "of_status")


def review_slices(spark, d):
    """The first rows of each slice of the queue, whatever their source."""
    rows = b.reviewed_documents(spark, d)
    out = [curation.review_queue(rows, which, None, 40).select(F.lit(which).alias("slice"), "id") for which in ("queue", "rejected", "all")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def queue_histogram(spark, d):
    return curation.queue_histogram(b.reviewed_documents(spark, d))


def due_for_review(spark, d):
    rows = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("checked_at"))
    return curation.due_for_review(rows, TODAY, 30)


def review_sample(spark, d):
    return curation.sampled(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 100, 17)


def snapshot_plan(spark, d):
    p = b.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[^/]*//[^/]*", 0).alias("url"), F.col("page_id").alias("pos"))
    new = p.filter("page_id % 2 = 1").withColumn("url", F.when(F.col("page_id") % 10 == 1, "").otherwise(F.col("url")))
    return curation.snapshot_plan(new, p.filter("page_id % 2 = 0")).select("page_id", "verdict")


def moderation_apply(spark, d):
    rows = b.reviewed_documents(spark, d).select("id", "moderation_status", F.when(F.col("id") % 4 == 0, F.col("id") - 1).alias("duplicate_of"), F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("reviewed_by"))
    status = F.when(F.col("id") % 12 == 0, "duplicate").when(F.col("id") % 12 == 3, "rejected").when(F.col("id") % 12 == 6, "approved").otherwise("nonsense")
    return curation.moderated(rows, rows.filter("id % 3 = 0").select("id", status.alias("status"), (F.col("id") - 7).alias("duplicate_of")), "console")


def keyed_changes(spark, d):
    rows = b.catalog(spark, d).select("id", "name", "org", "grade_min")
    up = rows.filter("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, F.upper("name")).alias("name"), F.when(F.col("id") % 3 == 0, F.array(F.lit("grade_min"))).alias("cleared"))
    return curation.changed(rows, up, cleared="cleared")


def usage_upsert(spark, d):
    e = b.user_costs(spark, d).select("userid", F.col("feature").alias("surface"), "calls", "cost_usd", "last_at")
    old = e.groupBy("userid", "surface").agg(F.sum("calls").alias("calls"), F.max("last_at").alias("last_at"))
    new = old.filter("userid % 2 = 0").withColumn("calls", F.lit(1).cast("long")).withColumn("last_at", F.lit("2024-02-01").cast("timestamp_ntz"))
    return curation.upserted(old, new, ["userid", "surface"], ["calls"])


def minted_ids(spark, d):
    known = b.table(spark, d, "supplier").select(F.concat(F.lit("ec"), (F.col("s_suppkey") + 20000).cast("string")).alias("id"))
    return curation.next_ids(b.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("pos")), known).select("c_custkey", "new_id")


def conversation_pairs(spark, d):
    from pyspark.sql import Window as W

    c = b.table(spark, d, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumns({"question": F.lag("text").over(w), "before": F.lag("role").over(w)}).filter("role = 'assistant' and before = 'user'")
    return pairs.select("conv_id", "turn", F.md5("question").alias("question"), F.md5("text").alias("answer"))


def json_recover(spark, d):
    e = b.table(spark, d, "events")
    noisy = F.concat(F.lit("Result: "), F.substr("props", F.lit(1), (F.length("props") - F.col("event_id") % 4).cast("int")), F.when(F.col("event_id") % 4 == 0, " and so on }").otherwise(""))
    return e.select("event_id", text.recovered_json(noisy).alias("json"))


def fuzzy_candidates(spark, d):
    p, g = b.table(spark, d, "part"), b.table(spark, d, "pages")
    url = F.concat(F.lit("https://www.site"), (F.col("p_partkey") % 40).cast("string"), F.lit(".example.org/"), urls.name_key(F.col("p_name")).substr(1, 5))
    rows = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.replace(url, F.lit(" "), F.lit("-")).alias("url"), F.col("p_partkey").alias("pos"))
    new = rows.select("id", "url", F.lit("").alias("apply_url"), F.concat(F.col("name"), F.lit(" 2024")).alias("name"))
    out = similarity.duplicate_candidates(new, rows, same=True)
    return out.select("id", "exact", F.array_join("candidates", "|").alias("candidates"))


def greedy_dedupe(spark, d):
    p = b.table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.concat(F.lit("https://a.example/"), (F.col("p_partkey") % 900).cast("string")).alias("url"), F.col("p_partkey").alias("pos"))
    return similarity.greedy_new(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"))


def mock_enriched(spark, d):
    return enrich.mock_dates(b.catalog(spark, d).select("id", "name"), TODAY).select("id", "date")


def stream_daily_rollup(spark, d):
    """The same sums by a stream over the file, written batch by batch and read back."""
    root = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    e = b.table(spark, d, "events")
    stream = rollup.usage_stream(spark, f"{d}/events.parquet*", e.schema)
    rollup.write_daily(stream, f"{root}/sums", f"{root}/state").awaitTermination()
    return rollup.read_daily(spark, f"{root}/sums").select("userid", "day", "surface", "calls", "cost_usd")


QUERIES = {f.__name__: f for f in (tracker_next_deadline, tracker_milestones, tracker_status, tracker_status_counts, tracker_order, calendar_months, calendar_headings, calendar_lanes, calendar_export, due_soon, palette_slots, subscription_state, access_gate, promo_redeem, trial_start, derived_freshness, review_queue, queue_answer, review_slices, queue_histogram, due_for_review, review_sample, snapshot_plan, moderation_apply, keyed_changes, usage_upsert, minted_ids, conversation_pairs, json_recover, fuzzy_candidates, greedy_dedupe, mock_enriched, stream_daily_rollup)}

_ITEMS = """l AS (SELECT l_orderkey AS id, CAST(l_shipdate AS DATE) AS date, l_linestatus AS label, l_returnflag AS type FROM lineitem)"""
_NEXT = f"""{_ITEMS}, nx AS (SELECT id, coalesce(min({{'d': date, 'l': label, 't': type}}) FILTER (date >= DATE '1998-06-30'), max({{'d': date, 'l': label, 't': type}})) AS n FROM l GROUP BY 1)"""
_ST = f"""{_ITEMS}, st AS (SELECT id, CASE WHEN id % 23 = 0 THEN 'completed' WHEN min(date) >= DATE '1998-07-01' THEN 'not_started' WHEN max(date) >= DATE '1998-06-30' THEN 'in_progress' WHEN max(type) = 'R' AND id % 19 <> 0 THEN 'not_started' ELSE 'completed' END AS status FROM l GROUP BY 1)"""
_SUBS = """subs AS (SELECT c_custkey AS userid, CASE WHEN c_custkey % 13 = 0 THEN 'trial' ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'active' WHEN 'BUILDING' THEN 'trial' WHEN 'MACHINERY' THEN 'beta' WHEN 'HOUSEHOLD' THEN 'canceled' ELSE 'past_due' END END AS status,
 CASE WHEN c_custkey % 11 <> 0 THEN ends_at END AS trial_ends_at, CASE WHEN c_custkey % 7 <> 0 THEN ends_at - INTERVAL 30 DAY END AS subscription_end_at FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS ends_at FROM orders GROUP BY 1) ON o_custkey = c_custkey),
acc AS (SELECT *, coalesce(status = 'trial' AND trial_ends_at < TIMESTAMP '1998-07-01', false) AS expired,
 CASE WHEN status = 'active' THEN true WHEN status = 'trial' THEN coalesce(trial_ends_at >= TIMESTAMP '1998-07-01', true) WHEN status IN ('beta', 'canceled') THEN coalesce(subscription_end_at > TIMESTAMP '1998-07-01', false) ELSE false END AS access FROM subs)"""
_REV = """rev AS (SELECT d.doc_id AS id, source, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'insufficient_data' END AS moderation_status FROM documents d LEFT JOIN labels USING (doc_id))"""

ORACLES = {
    "tracker_next_deadline": f"WITH {_NEXT} SELECT id, n.d AS next_date, n.l AS label, CAST(date_diff('day', DATE '1998-07-01', n.d) + 1 AS INTEGER) AS days FROM nx",
    "tracker_milestones": f"WITH {_ITEMS} SELECT DISTINCT id, date, label, date < DATE '1998-06-30' AS past FROM l",
    "tracker_status": f"WITH {_ST} SELECT id, status FROM st",
    "tracker_status_counts": f"WITH {_ST} SELECT status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM st GROUP BY 1",
    "tracker_order": f"WITH {_NEXT}, st AS (SELECT id, CASE WHEN id % 23 = 0 THEN 'completed' WHEN min(date) >= DATE '1998-07-01' THEN 'not_started' WHEN max(date) >= DATE '1998-06-30' THEN 'in_progress' WHEN max(type) = 'R' AND id % 19 <> 0 THEN 'not_started' ELSE 'completed' END AS status FROM l GROUP BY 1) SELECT row_number() OVER (ORDER BY CASE status WHEN 'in_progress' THEN 0 WHEN 'not_started' THEN 1 ELSE 2 END, n.d, id) AS place, id, status FROM st JOIN nx USING (id)",
    "calendar_lanes": """WITH x AS (SELECT l_orderkey AS id, l_linenumber AS i, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber % 5 = 0 THEN '' WHEN l_linenumber % 3 <> 0 THEN l_linestatus END AS label, CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag END AS type FROM lineitem WHERE l_quantity % 11 <> 0),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id, date, coalesce(label, '') ORDER BY i, date, label NULLS FIRST, type NULLS FIRST) = 1), n AS (SELECT o_orderkey AS id, o_orderpriority AS bucket, 'Item ' || o_orderkey || ' ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ' of the year' ELSE '' END AS name FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 6 <> 0)
SELECT bucket, strftime(date, '%Y-%m') AS month, date, CASE WHEN length(name) > 22 THEN left(name, 20) || '…' ELSE name END AS label, n.id, coalesce(nullif(y.label, ''), 'Date') AS text, coalesce(type, 'deadline') AS type, date < DATE '1998-06-30' AS past, strftime(date, '%Y-%m') = '1998-07' AS current, strftime(date, '%Y-%m') = '1998-08' AS next FROM y JOIN n ON n.id = y.id""",
    "calendar_months": f"WITH {_ITEMS} SELECT strftime(date, '%Y-%m') AS month, count(*) AS dates, count(DISTINCT id) AS items FROM l GROUP BY 1",
    "calendar_headings": f"WITH {_ITEMS}, r AS (SELECT id, date, row_number() OVER (PARTITION BY id ORDER BY date, label, type) - 1 AS index FROM l), h AS (SELECT *, lag(year(date)) OVER (PARTITION BY id ORDER BY index) AS y FROM r) SELECT id, CAST(index AS INTEGER) AS index, date FROM h WHERE y IS NULL OR y <> year(date)",
    "calendar_export": f"WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date, label, type) - 1 AS i FROM l) SELECT id || '-' || i AS uid, md5('BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || id || '-' || i || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(date + 1, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || label || chr(13) || chr(10) || 'END:VEVENT') AS block_md5 FROM r",
    "due_soon": f"WITH {_NEXT}, m AS (SELECT id, n.d AS next_date, year(n.d) * 12 + month(n.d) - (1998 * 12 + 7) AS a FROM nx) SELECT id, CASE WHEN a BETWEEN 0 AND 1 THEN 'soon' ELSE 'beyond' END AS due, next_date FROM m WHERE a >= 0",
    "palette_slots": "SELECT p_brand, CAST(least(dense_rank() OVER (ORDER BY min(p_partkey)) - 1, 16) AS INTEGER) AS slot FROM part GROUP BY 1",
    "subscription_state": f"WITH {_SUBS}, e AS (SELECT *, CASE status WHEN 'trial' THEN trial_ends_at WHEN 'beta' THEN subscription_end_at END AS ends FROM acc) SELECT userid, status, access, expired, CASE WHEN ends IS NULL THEN 0 ELSE CAST(greatest(0, ceil(date_diff('second', TIMESTAMP '1998-07-01', ends) / 86400.0)) AS INTEGER) END AS days_left FROM e",
    "access_gate": f"WITH {_SUBS}, r AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 10000000 ELSE 0 END END AS uid FROM orders), g AS (SELECT request, CASE WHEN uid IS NULL THEN 'anonymous' WHEN userid IS NULL THEN 'unknown_user' WHEN access THEN 'ok' WHEN status = 'trial' THEN 'trial_expired' WHEN status = 'past_due' THEN 'payment_due' ELSE 'inactive' END AS reason FROM r LEFT JOIN acc ON uid = userid) SELECT request, reason, reason IN ('trial_expired', 'payment_due', 'inactive') AS blocked FROM g",
    "promo_redeem": f"WITH {_SUBS} SELECT userid, 'SPRING' AS code, status <> 'active' AND userid % 4 <> 0 AS accepted, CASE WHEN status <> 'active' AND userid % 4 <> 0 THEN greatest(TIMESTAMP '1998-07-01', coalesce(subscription_end_at, TIMESTAMP '1998-07-01')) + to_days(CAST(userid % 30 + 1 AS INTEGER)) ELSE subscription_end_at END AS ends_at FROM subs",
    "trial_start": f"WITH {_SUBS} SELECT userid, CASE WHEN userid % 3 <> 0 THEN status ELSE 'trial' END AS status, CASE WHEN userid % 3 = 0 THEN TIMESTAMP '1998-07-15' ELSE trial_ends_at END AS ends_at FROM subs",
    "derived_freshness": r"SELECT conv_id, turn, text = left(text, 120) OR abs(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) - len(list_filter(regexp_split_to_array(trim(left(text, 120)), '\s+'), lambda w: w <> ''))) < 10 AS fresh FROM conversations WHERE role = 'user'",
    "review_queue": f"WITH {_REV} SELECT id, moderation_status FROM rev WHERE (moderation_status IS NULL OR moderation_status IN ('pending', 'insufficient_data')) AND source = 'src0' ORDER BY id % 97 DESC, id DESC LIMIT 500",
    "queue_answer": f"""WITH {_REV}, p AS (SELECT id, coalesce(source, 'none') AS source, coalesce(moderation_status, 'never reviewed') AS moderation_status, CASE WHEN id % 2 = 0 THEN id % 50 + 1 END AS of FROM rev WHERE moderation_status IN ('rejected', 'duplicate') ORDER BY DATE '2024-01-01' + CAST(id % 97 AS INTEGER) DESC, id DESC LIMIT 300)
SELECT p.id, source, moderation_status, p_name AS survivor, CASE WHEN p_name IS NOT NULL THEN p_partkey % 5 <> 0 END AS survivor_active, count(*) OVER () AS total, count(*) OVER (PARTITION BY source) AS of_source, count(*) OVER (PARTITION BY moderation_status) AS of_status FROM p LEFT JOIN part ON p_partkey = of""",
    "review_slices": f"""WITH {_REV}, s AS (SELECT 'queue' AS slice, id FROM rev WHERE moderation_status IS NULL OR moderation_status IN ('pending', 'insufficient_data') UNION ALL SELECT 'rejected', id FROM rev WHERE moderation_status IN ('rejected', 'duplicate') UNION ALL SELECT 'all', id FROM rev)
 SELECT slice, id FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY id % 97 DESC, id DESC) AS n FROM s) WHERE n <= 40""",
    "queue_histogram": f"WITH {_REV} SELECT coalesce(source, 'unknown') AS source, coalesce(moderation_status, 'unreviewed') AS status, count(*) AS n FROM rev GROUP BY 1, 2",
    "due_for_review": "WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS checked_at FROM orders) SELECT * FROM r WHERE checked_at IS NULL OR checked_at < TIMESTAMP '1998-06-01'",
    "review_sample": "SELECT o_orderkey AS id FROM orders ORDER BY md5('17:' || o_orderkey), id LIMIT 100",
    "snapshot_plan": """WITH p AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/]*', 0) AS url FROM pages), n AS (SELECT page_id, CASE WHEN page_id % 10 = 1 THEN '' ELSE lower(regexp_replace(trim(url), '/+$', '')) END AS key FROM p WHERE page_id % 2 = 1),
 k AS (SELECT DISTINCT lower(regexp_replace(trim(url), '/+$', '')) AS key FROM p WHERE page_id % 2 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS nth FROM n)
 SELECT page_id, CASE WHEN o.key = '' THEN 'insert' WHEN k.key IS NOT NULL THEN 'in_catalog' WHEN nth > 1 THEN 'in_file' ELSE 'insert' END AS verdict FROM o LEFT JOIN k ON o.key = k.key""",
    "moderation_apply": f"""WITH {_REV}, r AS (SELECT id, moderation_status, CASE WHEN id % 4 = 0 THEN id - 1 END AS dup, CASE id % 12 WHEN 0 THEN 'duplicate' WHEN 3 THEN 'rejected' WHEN 6 THEN 'approved' END AS s FROM rev)
 SELECT id, coalesce(s, moderation_status) AS moderation_status, CASE WHEN s = 'duplicate' THEN id - 7 WHEN s IS NOT NULL THEN NULL ELSE dup END AS duplicate_of, coalesce(s NOT IN ('rejected', 'duplicate'), true) AS is_active, CASE WHEN s IS NOT NULL THEN 'console' END AS reviewed_by FROM r""",
    "keyed_changes": "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand AS org, CASE WHEN p_partkey % 15 = 0 THEN NULL WHEN p_partkey % 9 <> 0 THEN p_size % 12 END AS grade_min FROM part",
    "usage_upsert": "SELECT CAST(user_id AS VARCHAR) AS userid, event_type AS surface, CAST(count(*) + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS calls, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2024-02-01' ELSE max(ts) END AS last_at FROM events GROUP BY user_id, event_type",
    "minted_ids": "SELECT c_custkey, 'ec' || ((SELECT max(s_suppkey) + 20000 FROM supplier) + row_number() OVER (ORDER BY c_custkey)) AS new_id FROM customer",
    "conversation_pairs": "SELECT conv_id, turn, md5(q) AS question, md5(text) AS answer FROM (SELECT *, lag(text) OVER w AS q, lag(role) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND b = 'user'",
    "mock_enriched": "SELECT p_partkey AS id, DATE '1998-07-01' + CAST(20 + CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 100 AS INTEGER) AS date FROM part",
    "json_recover": """WITH e AS (SELECT event_id, regexp_extract(props, '[0-9]+') AS n, greatest(event_id % 4 - 1, 0) AS c FROM events) SELECT event_id, CASE WHEN length(n) > c THEN '{"k": ' || left(n, CAST(length(n) - c AS INTEGER)) || '}' END AS json FROM e""",
    "stream_daily_rollup": "SELECT CAST(user_id AS VARCHAR) AS userid, CAST(ts AS DATE) AS day, event_type AS surface, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(14,6))) AS DECIMAL(18,6)) AS cost_usd FROM events GROUP BY ALL",
}
