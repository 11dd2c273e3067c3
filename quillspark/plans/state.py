"""Queries over caches, tokens, logs, streams, calendars, exports and outside calls, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.operators import accounts, caches, checks, curation, enrich, tracker, versions
from quillspark.sources import bindings as b
from quillspark.sources.shared import shared_dir
from quillspark.streaming import increments, rollup, state

TODAY = b.AS_OF_ORDERS


def cache_reads(spark, d):
    e = b.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    return caches.read_through(e, 7).select("id", "source")


def deadline_reads(spark, d):
    """Entries whose dates were checked within 7 days are answered as they stand, the others are to be checked."""
    o = b.table(spark, d, "orders")
    checked = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).cast("timestamp")
    now = F.lit(TODAY).cast("timestamp")
    return o.select("o_orderkey", F.when(dates.fresh(checked, now), "cached").otherwise("check").alias("source"), dates.days_since(checked, now).alias("age_days"), dates.expired(checked, now).alias("expired"))


def token_uses(spark, d):
    e = b.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "mint").otherwise("take")
    return caches.tokens_taken(e.select((F.col("user_id") % 40).alias("token"), "ts", F.col("event_id").alias("id"), kind.alias("kind")), 24 * 60).select("id", "verdict")


def log_tails(spark, d):
    e = b.table(spark, d, "events").select(F.col("event_type").alias("agent"), F.col("event_id").alias("line_no"))
    since = spark.createDataFrame([("click", 10), ("view", 0), ("error", 10**9), ("none", 5)], "agent string, since long")
    return caches.log_tail(e, since, 50)


def _in_pieces(spark, events, piece, make, mode="append", end=None):
    """A stream over files that come in three pieces, each a run of its own that goes on from the checkpoint; the folder of its batches."""
    own = state.state_session(spark)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = events.withColumn("_piece", piece)
    for n in range(3):
        part = rows.filter(F.col("_piece") == n).drop("_piece")
        (part.unionByName(end) if end is not None and n == 2 else part).write.mode("append").parquet(f"{root}/in")
        state.write_batches(make(own.readStream.schema(events.schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/state", mode).awaitTermination()
    return f"{root}/out"


def _timed(spark, d, events, make):
    """Ten days a piece; an event in seven comes a piece late, which a watermark of 11 days waits for."""
    piece = F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 10)) + F.when(F.col("id") % 7 == 0, 1).otherwise(0))
    end = spark.createDataFrame([(state.END_KEY, state.END, -1, "take")], "key string, ts timestamp, id long, kind string")
    out = _in_pieces(spark, events.select(F.col("key").cast("string"), F.col("ts").cast("timestamp").alias("ts"), "id", "kind"), piece, make, end=end)
    return state.read_batches(spark, out, state.VERDICTS)


def cache_stream(spark, d):
    """The reads of cache_reads as a stream, whose state and timers are by key."""
    e = b.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", F.lit("take").alias("kind"))
    return _timed(spark, d, e, lambda s: state.read_through_stream(s.drop("kind"), 7, "11 days")).select("id", F.col("verdict").alias("source"))


def token_stream(spark, d):
    """The tokens of token_uses as a stream."""
    kind = F.when(F.col("event_type") == "signup", "mint").otherwise("take")
    e = b.table(spark, d, "events").select((F.col("user_id") % 40).alias("key"), "ts", F.col("event_id").alias("id"), kind.alias("kind"))
    return _timed(spark, d, e, lambda s: state.tokens_stream(s, 24 * 60, "11 days")).filter(F.col("key") != state.END_KEY).select("id", "verdict")


def log_stream(spark, d):
    """The live tail of every log as a stream; readers ask for what follows the first so many lines of all."""
    e = b.table(spark, d, "events")
    lines = e.select(F.col("event_type").alias("agent"), F.col("event_id").alias("line_no"), F.concat("event_type", F.lit(" "), "event_id").alias("line"))
    out = _in_pieces(spark, lines, (F.col("line_no") % 3).cast("int"), lambda s: state.tail_stream(s, 500), "update")
    tails = state.newest_tails(state.read_batches(spark, out, "agent string, total long, dropped long, numbers array<long>, lines array<string>"))
    n = e.groupBy(F.col("event_type").alias("agent")).agg(F.count(F.lit(1)).alias("n"))
    asked = n.select("agent", F.explode(F.array(F.lit(0).cast("long"), F.col("n") - 20, F.col("n") + 5)).alias("since")).unionByName(n.select(F.concat(F.lit("no "), "agent").alias("agent"), F.col("n").alias("since")))
    got = state.log_since(tails, asked)
    return got.select("agent", F.size("lines").cast("long").alias("given"), F.md5(F.array_join("lines", "|")).alias("lines_md5"), "next", "dropped")


def usage_increments(spark, d):
    """Sums and exact numbers of users by day, by surface, by both and in all, after three runs of a stream whose batches add up; the parts are merged as they grow."""
    e = b.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("surface"), F.col("value").cast("decimal(14,6)").alias("cost_usd"), "event_id")
    root = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    kept = increments.UsageSums(spark, f"{root}/sums", most=3)
    for n in range(3):
        e.filter(F.col("event_id") % 3 == n).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        stream.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(lambda rows, batch: kept.add(rows, batch)).trigger(availableNow=True).start().awaitTermination()
        kept.add(e.filter("event_id % 3 = 1"), 0)  # a batch that comes again changes nothing
    return kept.sums()


def _date_checks(spark, d):
    """Three batches of requests, four days apart, each run twice."""
    o, l = b.table(spark, d, "orders"), b.table(spark, d, "lineitem")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "running").otherwise("unknown").alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).cast("timestamp_ntz").alias("last_checked_at"))
    table = versions.VersionedTable(spark, f"{shared_dir(spark)}/checks-{uuid.uuid4().hex}", log_schema=checks.LOG)
    table.create(rows)
    answers = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "not_running").otherwise("odd").alias("status"))
    for n in range(3):
        now = F.lit(TODAY).cast("timestamp") + F.make_interval(days=F.lit(4 * n))
        asked = l.filter(F.col("l_linenumber") % 3 == n).select(F.when(F.col("l_suppkey") % 10 == 0, -F.col("l_suppkey")).otherwise(F.col("l_orderkey")).alias("id"))
        for _ in range(2):
            checks.checked(table, asked, answers, now, ("requests", n))
    return table


def dates_written_back(spark, d):
    """Rows after checks on demand: those that were stale when they were asked for have a new status and time."""
    return _date_checks(spark, d).read().select("id", "status", "last_checked_at")


def date_check_log(spark, d):
    """What was asked in each batch and how it was answered; the log changes with the table, once a batch."""
    return _date_checks(spark, d).log().select("id", "source", "status", "checked_at", "version")


def log_append(spark, d):
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    again = o.filter("id % 3 = 0")
    return curation.appended(o.filter("id % 2 = 0"), again.unionByName(again), ["id"])


def replaced_rows(spark, d):
    """Rows upserted whole, the last of a key; then some deleted."""
    rows = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("org"))
    l = b.table(spark, d, "lineitem")
    new = l.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name"), F.lit(None).cast("string").alias("org"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate").alias("pos")).filter("id % 4 = 0")
    return curation.without(curation.replaced(rows, new, ["id"]), rows.filter("id % 6 = 0"))


def catalog_export(spark, d):
    return curation.exported(b.catalog(spark, d))


def summary_changes(spark, d):
    """Summaries that another source gives and that differ."""
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("summary"))
    sheet = docs.filter("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, F.concat(F.col("summary"), F.lit("!"))).when(F.col("id") % 5 == 0, " ").otherwise(F.trim("summary")).alias("summary"))
    return curation.differing(docs, sheet, "summary").select("id", F.md5("new").alias("new"))


def first_turns(spark, d):
    c = b.table(spark, d, "conversations").select("conv_id", "role", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    return curation.first_by_key(c, ["conv_id", "role"], "turn")


def account_values(spark, d):
    """One value of every account's bag set anew."""
    c = b.table(spark, d, "customer")
    bag = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("theme"), F.lit("dark"), F.lit("segment"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("segment"), F.col("c_mktsegment")))
    out = accounts.with_value(bag, "theme", F.lit("light"))
    return c.select("c_custkey", F.size(out).cast("long").alias("n"), F.element_at(out, F.lit("theme")).alias("theme"), F.element_at(out, F.lit("segment")).alias("segment"))


def calendar_files(spark, d):
    return tracker.calendar_documents(b.tracker_items(spark, d)).select("id", F.md5("document").alias("document_md5"))


def calendar_sync(spark, d):
    items = b.tracker_items(spark, d)
    known = tracker.calendar_rows(items).filter("id % 3 = 0").select(F.concat_ws("-", "id", "index").alias("uid"), (F.col("id") % 9 == 0).alias("gone"))
    return tracker.calendar_ops(items, known)


def enriched_rows(spark, d):
    """Rows that an outside call answers, a few at a time; here a repeatable stand-in for it."""

    def call(frame):
        return frame.assign(verdict=["long" if len(n) > 12 else "short" for n in frame["name"]], searches=frame["id"] % 3)[["id", "verdict", "searches"]]

    return enrich.enriched(b.catalog(spark, d).select("id", "name"), call, "id long, verdict string, searches long", size=25)


def mock_ranking(spark, d):
    return enrich.mock_ranking(b.catalog(spark, d).filter("is_active"))


def subject_inference(spark, d):
    docs = b.table(spark, d, "documents")
    added = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", F.get(F.array(*map(F.lit, enrich.SUBJECTS)), (F.col("doc_id") % 17).cast("int")), F.lit("and LAW, computer science, physics, logic, business"))).otherwise("")
    return docs.select("doc_id", F.array_join(enrich.inferred_subjects(F.concat_ws(" ", F.coalesce("text", F.lit("")), added)), "|").alias("subjects"))


def scored_results(spark, d):
    rows = b.catalog(spark, d).select("id", "name")
    scores = rows.filter("id % 7 = 0").select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).alias("id"), (100_000 - F.col("id")).alias("rank"), (F.col("id") % 11).alias("score"))
    return enrich.scored(rows, scores)


def active_kinds(spark, d):
    """Kinds that were inferred for an entry and are in use, in the order given."""
    k = F.col("p_partkey")
    inferred = F.array(*(F.get(F.array(F.lit("summer"), F.lit("journal"), F.lit("web"), F.lit("internship")), ((k + i) % 4).cast("int")) for i in range(3)))
    return b.table(spark, d, "part").select(k.alias("id"), F.array_join(F.filter(inferred, lambda x: x.isin("summer", "internship")), "|").alias("kinds"))


def date_values(spark, d):
    """Dates as texts in several forms: instants, ages, lengths, labels."""
    o = b.table(spark, d, "orders")
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.get(F.array(F.lit("T10:30:00Z"), F.lit(""), F.lit("T25:00"), F.lit("T00:00:00+02:00")), (F.col("o_orderkey") % 4).cast("int")))
    at = dates.timestamp(raw)
    end = F.lit(TODAY).cast("timestamp")
    return o.select("o_orderkey", at.cast("timestamp_ntz").alias("instant"), F.coalesce(at > end, F.lit(False)).alias("ahead"), dates.duration(at, end).alias("seconds"), F.date_format("o_orderdate", "MMM yyyy").alias("label"))


def batch_numbers(spark, d):
    """Rows in batches of 25, in order."""
    from quillspark.operators.numbering import numbered

    rows = numbered(b.table(spark, d, "part").select("p_partkey"), [F.col("p_partkey")])
    return rows.select("p_partkey", F.floor((F.col("place") - 1) / 25).cast("long").alias("batch"))


def grade_fields(spark, d):
    """Edited grades and codes: whole numbers from 1 to 13 and known codes, else null."""
    k = F.col("p_partkey")
    raw = F.get(F.array(F.lit("9"), F.lit("0"), F.lit("13"), F.lit("14"), F.lit("x"), F.lit(None).cast("string")), (k % 6).cast("int"))
    return b.table(spark, d, "part").select(k.alias("id"), curation.validated_grade(raw).alias("grade"), curation.within(F.col("p_type"), ["ECONOMY", "PROMO"]).alias("type"))


def stream_surface_rollup(spark, d):
    """Sums by surface and day as a stream over the file, written batch by batch and read back."""
    root = f"{shared_dir(spark)}/surface-{uuid.uuid4().hex}"
    stream = rollup.usage_stream(spark, f"{d}/events.parquet*", b.table(spark, d, "events").schema)
    rollup.write_daily(stream, f"{root}/sums", f"{root}/state", rollup.by_surface).awaitTermination()
    return rollup.read_daily(spark, f"{root}/sums", ("day", "surface")).select("day", "surface", "calls", "cost_usd")


QUERIES = {f.__name__: f for f in (cache_reads, deadline_reads, token_uses, log_tails, cache_stream, token_stream, log_stream, usage_increments, dates_written_back, date_check_log, log_append, replaced_rows, catalog_export, summary_changes, first_turns, account_values, calendar_files, calendar_sync, enriched_rows, mock_ranking, subject_inference, scored_results, active_kinds, date_values, batch_numbers, grade_fields, stream_surface_rollup)}

_CACHE = """WITH RECURSIVE f AS (SELECT user_id AS key, min(ts) AS t FROM events GROUP BY 1 UNION ALL SELECT f.key, (SELECT min(ts) FROM events e WHERE e.user_id = f.key AND e.ts >= f.t + INTERVAL 7 DAY) AS t FROM f WHERE f.t IS NOT NULL),
w AS (SELECT key, t, min(event_id) AS id FROM f JOIN events ON user_id = key AND ts = t GROUP BY 1, 2) SELECT event_id AS id, CASE WHEN w.id IS NOT NULL THEN 'fetch' ELSE 'cached' END AS source FROM events LEFT JOIN w ON w.id = event_id"""
_TOKENS = """WITH m AS (SELECT user_id % 40 AS token, min(ts) AS made FROM events WHERE event_type = 'signup' GROUP BY 1), t AS (SELECT event_id AS id, user_id % 40 AS token, ts, made, ts >= made AND ts <= made + INTERVAL 1 DAY AS alive FROM events LEFT JOIN m ON m.token = user_id % 40 WHERE event_type <> 'signup'),
f AS (SELECT token, arg_min(id, (ts, id)) AS first FROM t WHERE alive GROUP BY 1) SELECT t.id, CASE WHEN made IS NULL OR ts < made THEN 'unknown' WHEN NOT alive THEN 'expired' WHEN t.id = first THEN 'ok' ELSE 'used' END AS verdict FROM t LEFT JOIN f ON f.token = t.token"""
_CHECKS = """o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'running' ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS seen, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'not_running' ELSE 'unknown' END AS answer FROM orders),
q AS (SELECT DISTINCT CASE WHEN l_suppkey % 10 = 0 THEN -l_suppkey ELSE l_orderkey END AS id, l_linenumber % 3 AS n FROM lineitem),
a AS (SELECT o.*, a.n IS NOT NULL AS a0, b.n IS NOT NULL AS a1, c.n IS NOT NULL AS a2, coalesce(seen > TIMESTAMP '1998-06-24', false) AS f0 FROM o LEFT JOIN q a ON a.id = o.id AND a.n = 0 LEFT JOIN q b ON b.id = o.id AND b.n = 1 LEFT JOIN q c ON c.id = o.id AND c.n = 2),
b AS (SELECT *, a0 AND NOT f0 AS c0 FROM a), c AS (SELECT *, a1 AND NOT (c0 OR coalesce(seen > TIMESTAMP '1998-06-28', false)) AS c1 FROM b), e AS (SELECT *, a2 AND NOT (c1 OR (NOT c0 AND coalesce(seen > TIMESTAMP '1998-07-02', false))) AS c2 FROM c)"""
_ROWS = "r AS (SELECT l_orderkey AS id, CAST(l_shipdate AS DATE) AS date, l_linestatus AS label, l_returnflag AS type FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date, label, type) - 1 AS i FROM r)"
_BLOCK = "'BEGIN:VEVENT' || nl || 'UID:' || id || '-' || i || nl || 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d') || nl || 'DTEND;VALUE=DATE:' || strftime(date + 1, '%Y%m%d') || nl || 'SUMMARY:' || label || nl || 'END:VEVENT'"
_SUBJECTS = "[" + ", ".join(f"'{s}'" for s in enrich.SUBJECTS) + "]"

ORACLES = {
    "cache_reads": _CACHE,
    "cache_stream": _CACHE,
    "deadline_reads": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS c FROM orders) SELECT o_orderkey, CASE WHEN c > TIMESTAMP '1998-06-24' THEN 'cached' ELSE 'check' END AS source, CAST(floor(date_diff('second', c, TIMESTAMP '1998-07-01') / 86400.0) AS BIGINT) AS age_days, coalesce(TIMESTAMP '1998-07-01' > c, true) AS expired FROM o""",
    "token_uses": _TOKENS,
    "token_stream": _TOKENS,
    "log_stream": """WITH l AS (SELECT event_type AS agent, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events), c AS (SELECT agent, any_value(n) AS n FROM l GROUP BY 1),
q AS (SELECT agent, n, unnest([0, n - 20, n + 5]) AS since FROM c) SELECT q.agent, count(l.nth) AS given, md5(coalesce(string_agg(q.agent || ' ' || event_id, '|' ORDER BY event_id), '')) AS lines_md5, any_value(q.n) AS next, greatest(any_value(q.n) - 500, 0) AS dropped
FROM q LEFT JOIN l ON l.agent = q.agent AND l.nth > greatest(q.since, q.n - 500) GROUP BY q.agent, q.since UNION ALL SELECT 'no ' || agent, 0, md5(''), 0, 0 FROM c""",
    "log_tails": """WITH s(agent, since) AS (VALUES ('click', 10), ('view', 0), ('error', 1000000000), ('none', 5)), l AS (SELECT event_type AS agent, event_id AS line_no, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS nth FROM events)
SELECT s.agent, count(line_no) FILTER (nth <= 50) AS given, count(line_no) FILTER (nth > 50) AS dropped, min(line_no) FILTER (nth <= 50) AS first_line, max(line_no) FILTER (nth <= 50) AS last_line FROM s LEFT JOIN l ON l.agent = s.agent AND line_no >= since GROUP BY 1""",
    "usage_increments": """SELECT CAST(ts AS DATE) AS day, event_type AS surface, CASE WHEN grouping(CAST(ts AS DATE)) + grouping(event_type) = 0 THEN 'day+surface' WHEN grouping(event_type) = 1 AND grouping(CAST(ts AS DATE)) = 1 THEN 'all' WHEN grouping(event_type) = 1 THEN 'day' ELSE 'surface' END AS level, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(14,6))) AS DECIMAL(38,6)) AS cost_usd, count(DISTINCT user_id) AS users
FROM events GROUP BY GROUPING SETS ((CAST(ts AS DATE), event_type), (CAST(ts AS DATE)), (event_type), ())""",
    "dates_written_back": f"WITH {_CHECKS} SELECT id, CASE WHEN c0 OR c1 OR c2 THEN answer ELSE status END AS status, CASE WHEN c2 THEN TIMESTAMP '1998-07-09' WHEN c1 THEN TIMESTAMP '1998-07-05' WHEN c0 THEN TIMESTAMP '1998-07-01' ELSE seen END AS last_checked_at FROM e",
    "date_check_log": f"""WITH {_CHECKS} SELECT id, CASE WHEN c0 THEN 'check' ELSE 'cached' END AS source, CASE WHEN c0 THEN answer ELSE status END AS status, TIMESTAMP '1998-07-01' AS checked_at, CAST(2 AS BIGINT) AS version FROM e WHERE a0
UNION ALL SELECT id, CASE WHEN c1 THEN 'check' ELSE 'cached' END, CASE WHEN c0 OR c1 THEN answer ELSE status END, TIMESTAMP '1998-07-05', 3 FROM e WHERE a1 UNION ALL SELECT id, CASE WHEN c2 THEN 'check' ELSE 'cached' END, CASE WHEN c0 OR c1 OR c2 THEN answer ELSE status END, TIMESTAMP '1998-07-09', 4 FROM e WHERE a2
UNION ALL SELECT id, 'unknown', NULL, TIMESTAMP '1998-07-01' + to_days(CAST(4 * n AS INTEGER)), 2 + n FROM q WHERE id < 0""",
    "log_append": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "replaced_rows": """WITH n AS (SELECT l_partkey AS id, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_returnflag, l_shipdate)) AS name FROM lineitem WHERE l_partkey % 4 = 0 GROUP BY 1), u AS (SELECT p_partkey AS id, p_name AS name, p_brand AS org FROM part WHERE p_partkey NOT IN (SELECT id FROM n) UNION ALL SELECT id, name, NULL FROM n)
SELECT * FROM u WHERE NOT (id % 6 = 0 AND id IN (SELECT p_partkey FROM part))""",
    "catalog_export": """SELECT p_partkey AS id, '{"id":' || p_partkey || ',"name":"' || p_name || '","org":"' || p_brand || '","type":"' || p_type || '","price":"' || CASE WHEN p_retailprice < 1200 THEN 'free' ELSE 'paid' END || '"' || CASE WHEN p_partkey % 9 <> 0 THEN ',"grade_min":' || (p_size % 12) ELSE '' END || CASE WHEN p_partkey % 8 <> 0 THEN ',"grade_max":' || (p_size % 12 + 3) ELSE '' END || '}' AS json FROM part WHERE p_partkey % 5 <> 0""",
    "summary_changes": "WITH s AS (SELECT doc_id AS id, text AS old, nullif(trim(CASE WHEN doc_id % 3 = 0 THEN text || '!' WHEN doc_id % 5 = 0 THEN ' ' ELSE trim(text, ' ') END, ' '), '') AS new FROM documents WHERE doc_id % 2 = 0) SELECT id, md5(new) AS new FROM s WHERE new IS NOT NULL AND old IS DISTINCT FROM new",
    "first_turns": "SELECT conv_id, role, min(turn) AS turn, arg_min(md5(coalesce(text, '')), turn) AS md5 FROM conversations GROUP BY 1, 2",
    "account_values": "SELECT c_custkey, 2 AS n, 'light' AS theme, c_mktsegment AS segment FROM customer",
    "calendar_files": f"WITH {_ROWS}, b AS (SELECT id, string_agg({_BLOCK}, chr(13) || chr(10) ORDER BY i) AS body, any_value(nl) AS nl FROM (SELECT *, chr(13) || chr(10) AS nl FROM n) GROUP BY 1) SELECT id, md5('BEGIN:VCALENDAR' || nl || 'VERSION:2.0' || nl || 'CALSCALE:GREGORIAN' || nl || 'METHOD:PUBLISH' || nl || 'X-WR-TIMEZONE:UTC' || nl || body || nl || 'END:VCALENDAR') AS document_md5 FROM b",
    "calendar_sync": f"WITH {_ROWS} SELECT id || '-' || i AS uid, CASE WHEN id % 3 = 0 AND id % 9 <> 0 THEN 'patch' ELSE 'post' END AS op, date AS start_day, date + 1 AS end_day, label AS title FROM n",
    "enriched_rows": "SELECT p_partkey AS id, CASE WHEN length(p_name) > 12 THEN 'long' ELSE 'short' END AS verdict, p_partkey % 3 AS searches FROM part",
    "mock_ranking": "SELECT id, place, CASE WHEN place <= 4 THEN 'strong' ELSE 'look' END AS tier FROM (SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS place FROM part WHERE p_partkey % 5 <> 0) WHERE place <= 12",
    "subject_inference": f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || CASE WHEN doc_id % 3 = 0 THEN ({_SUBJECTS})[doc_id % 17 + 1] || ' and LAW, computer science, physics, logic, business' ELSE '' END) AS t FROM documents), m AS (SELECT doc_id, list_filter({_SUBJECTS}, lambda s: contains(t, lower(s))) AS m FROM t)
SELECT doc_id, CASE WHEN len(m) < 2 THEN 'STEM|Mixed' ELSE array_to_string(m[1:5], '|') END AS subjects FROM m""",
    "scored_results": "SELECT p_partkey AS id, p_name AS name, 100000 - p_partkey AS rank, p_partkey % 11 AS score FROM part WHERE p_partkey % 14 = 0",
    "active_kinds": "SELECT p_partkey AS id, array_to_string(list_filter(list_transform([0, 1, 2], lambda i: (['summer', 'journal', 'web', 'internship'])[(p_partkey + i) % 4 + 1]), lambda x: x IN ('summer', 'internship')), '|') AS kinds FROM part",
    "date_values": """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '10 hours 30 minutes' WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) WHEN 3 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 2 HOUR END AS instant FROM orders)
SELECT o_orderkey, instant, coalesce(instant > TIMESTAMP '1998-07-01', false) AS ahead, CAST(date_diff('second', instant, TIMESTAMP '1998-07-01') AS DOUBLE) AS seconds, strftime(day, '%b %Y') AS label FROM d""",
    "batch_numbers": "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 25 AS batch FROM part",
    "grade_fields": "SELECT p_partkey AS id, ([9, NULL, 13, NULL, NULL, NULL])[p_partkey % 6 + 1] AS grade, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type END AS type FROM part",
    "stream_surface_rollup": "SELECT CAST(ts AS DATE) AS day, event_type AS surface, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(14,6))) AS DECIMAL(18,6)) AS cost_usd FROM events GROUP BY ALL",
}
