"""Search and catalog queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text, urls
from quillspark.operators import curation, search
from quillspark.sources import bindings as b

WANTED = "I love the red widget and small gear things from brand 4"


def prefilter_top100(spark, d):
    rows = b.catalog(spark, d)
    out = search.prefilter(rows, WANTED, F.concat_ws(" ", "name", "org"), ["ECONOMY", "SMALL"], ["Red", "gear"], grade=9, tags=F.split("name", " "))
    return out.select("id", "score")


def relaxed_search(spark, d):
    rows = b.catalog(spark, d)
    return search.relaxed(rows, (F.col("price") == "free") & (F.col("type") == "PROMO") & (F.col("org") == "Brand#7")).select("id", "type", "org")


def facet_values(spark, d):
    return search.facets(b.catalog(spark, d), ["type", "org", "price"])


def faceted_results(spark, d):
    return search.faceted(b.catalog(spark, d), {"type": ["ECONOMY", "PROMO"], "org": ["Brand#1", "Brand#2", "Brand#3"], "price": []}).select("id", "type", "org")


def result_order(spark, d):
    rows = b.catalog(spark, d)
    tier = F.when(F.col("id") % 3 == 0, "strong").when(F.col("id") % 3 == 1, "good").otherwise("other")
    rows = rows.withColumns({"tier": tier, "tracked": F.col("id") % 10 == 0, "selected": F.col("id") % 7 == 0})
    return search.result_order(rows).select("place", "id")


def ranked_candidates(spark, d):
    pool = b.catalog(spark, d)
    ranking = pool.filter("id % 5 = 0").select("id", (F.col("id") / 5 + 1).cast("int").alias("place"), F.when(F.col("id") % 2 == 0, "strong").otherwise("odd").alias("tier"))
    return search.ranked(pool, ranking).select("place", "id", "name", "tier")


def tag_match(spark, d):
    docs = b.table(spark, d, "documents")
    return docs.filter(search.tag_match("thatst the robotics club", F.col("text"))).select("doc_id", F.lit("match").alias("verdict"))


def untracked_anti(spark, d):
    o, l = b.table(spark, d, "orders"), b.table(spark, d, "lineitem")
    tracked = l.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 1500).alias("o_custkey"))
    return search.without_tracked(o.select("o_orderkey", "o_custkey"), tracked, ["o_orderkey", "o_custkey"])


def survivor_search(spark, d):
    return search.survivors(b.catalog(spark, d), "17", ["name", "org"], 25).select("id", "name", "org", "is_active", "exact")


def catalog_scan(spark, d):
    """The active rows as the public list has them."""
    return b.catalog(spark, d).filter("is_active").orderBy("id").select("id", "name", "org", "type", "price", "grade_min", "grade_max")


def catalog_keys(spark, d):
    """The URL keys of all rows, active or not, each once."""
    written = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "url", F.lit("//"))).otherwise(F.upper("url"))
    return b.table(spark, d, "pages").select(urls.weak(written).alias("key")).filter("key <> ''").distinct()


def domain_peers(spark, d):
    """How many other rows share each page's registrable domain."""
    p = b.table(spark, d, "pages").select("page_id", urls.registrable(urls.host(F.col("url"))).alias("domain"))
    n = p.groupBy("domain").agg((F.count(F.lit(1)) - 1).alias("peers"))
    return p.join(n, "domain").select("page_id", F.when(F.col("domain") != "", F.col("peers")).otherwise(0).alias("peers"))


def url_keys(spark, d):
    rows = urls.parsed(b.table(spark, d, "pages").select("page_id", "url"), "url")
    return rows.select("page_id", urls.weak(F.col("url")).alias("weak"), urls.bare(F.col("url")).alias("bare"), "host", "path", "query", "match_key", "domain")


def url_duplicate_audit(spark, d):
    """URLs that stand for one page: each page's own, and its neighbour's written in another way."""
    p = b.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    again = p.filter("id % 3 = 0").select((F.col("id") + 1).alias("id"), F.concat(F.upper("url"), F.lit("/")).alias("url"))
    return curation.url_duplicates(p.unionByName(again))


def name_duplicate_audit(spark, d):
    return curation.name_duplicates(b.catalog(spark, d).select("id", F.concat_ws(" ", "name", F.lit("2024")).alias("name")))


def keyword_scores(spark, d):
    docs = b.table(spark, d, "documents")
    terms = text.search_terms(F.lit("The thing that shines in winter, thin ingots and stones about which we could use more"))
    return docs.select("doc_id", text.keyword_score(terms, F.col("text")).cast("long").alias("score"), text.word_count(F.col("text")).cast("long").alias("words"))


def text_shapes(spark, d):
    p = b.catalog(spark, d)
    name = F.concat_ws(" & ", "name", "org")
    return p.select("id", text.slug(name).alias("slug"), text.shortened(name, 22, 20).alias("short"), text.html_escaped(name).alias("html"), text.merged(F.col("name"), F.col("org")).alias("merged"), text.merged(name, F.col("org")).alias("merged_again"))


def grade_parse(spark, d):
    p = b.catalog(spark, d)
    said = F.when(F.col("id") % 5 == 0, F.concat(F.lit("I am in grade "), (F.col("id") % 12 + 1).cast("string"))).when(F.col("id") % 5 == 1, F.concat((F.col("id") % 12 + 1).cast("string"), F.lit("th grade student"))).when(F.col("id") % 5 == 2, "A Sophomore who likes art").when(F.col("id") % 5 == 3, "middle school").otherwise("no idea")
    return p.select("id", text.grade(said).cast("long").alias("grade"))


#: What a prompt contains and the feature that sends it, tried in this order; case counts.
SIGNATURES = [
    ("infer which subject categories", "infer_subjects"),
    ("Rank the best 10-12 matches", "ranking"),
    ("find real, current", "venue_search"),
    ("maintain a single, coherent running profile", "profile_synthesis"),
    ("decide whether a student's profile has enough detail", "profile_readiness"),
    ("exactly THREE distinct", "chat_starters"),
    ("helping a high schooler build a detailed personal profile", "profile_chat"),
    ("distill a casual chat conversation into new facts", "chat_findings"),
    ("classify and extract structured tracking data", "tracker_extract"),
    ("extract structured tracking data", "tracker_extract"),
    ("extract ONLY information that would be relevant", "resume_import"),
    ("helping a student find the best-fit extracurricular", "ranking"),
    ("interests/goals to the best opportunities", "tag_intent"),
    ("Write directly to them in second person", "tag_suggestions"),
    ("extracting specific interests, goals, and pursuits", "infer_subjects"),
]

#: Words that place a description in a section, tried in this order; the last section is the default.
SECTIONS = [
    ("conferences", ["conference", "workshop", "symposium"]),
    ("journals", ["journal", "publish", "manuscript"]),
    ("researchCompetitions", ["science fair", "research competition", "project competition", "app challenge", "hackathon"]),
    ("pureCompetitions", ["olympiad", "quiz", "exam", "competition"]),
    ("internships", ["internship", "intern", "lab position", "mentored"]),
    ("summerPrograms", ["summer", "camp", "program", "academy"]),
]

#: The type that a section's entries have, and the section of a kind.
SECTION_KINDS = {"summer": "summerPrograms", "internship": "internships", "research-competition": "researchCompetitions", "pure-competition": "pureCompetitions", "conference": "conferences", "journal": "journals"}


def feature_classify(spark, d):
    """Documents as prompts: one in two gets one of the signatures at its end, some in another case."""
    n = len(SIGNATURES)
    signs = F.array(*(F.lit(s) for s, _ in SIGNATURES))
    sign = F.get(signs, (F.col("doc_id") / 2).cast("int") % n)
    added = F.when(F.col("doc_id") % 2 == 0, sign).when(F.col("doc_id") % 5 == 0, F.upper(sign)).otherwise("")
    prompt = F.concat_ws(" ", F.coalesce("text", F.lit("")), added)
    return b.table(spark, d, "documents").select("doc_id", text.first_match(prompt, [(label, [s]) for s, label in SIGNATURES], "other", fold=False).alias("feature"))


def section_classify(spark, d):
    words = F.array(*(F.lit(w) for _, ws in SECTIONS for w in ws))
    added = F.when(F.col("doc_id") % 3 == 0, F.upper(F.get(words, F.col("doc_id").cast("int") % 21))).otherwise("")
    whole = F.concat_ws(" ", F.coalesce("text", F.lit("")), added)
    return b.table(spark, d, "documents").select("doc_id", text.first_match(whole, SECTIONS, "summerPrograms").alias("section"))


def tag_mentions(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.array_join(text.mentions(F.col("text"), ["the", "and", "con", "und", "les", "para", "thing"], 2, ["general", "misc"], 3), "|").alias("tags"))


QUERIES = {f.__name__: f for f in (prefilter_top100, relaxed_search, facet_values, faceted_results, result_order, ranked_candidates, tag_match, untracked_anti, survivor_search, catalog_scan, catalog_keys, domain_peers, url_keys, url_duplicate_audit, name_duplicate_audit, keyword_scores, text_shapes, grade_parse, feature_classify, section_classify, tag_mentions)}

_CATALOG = """cat AS (SELECT p_partkey AS id, p_name AS name, p_brand AS org, p_type AS type, CASE WHEN p_retailprice < 1200 THEN 'free' ELSE 'paid' END AS price,
  CASE WHEN p_partkey % 9 <> 0 THEN p_size % 12 END AS grade_min, CASE WHEN p_partkey % 8 <> 0 THEN p_size % 12 + 3 END AS grade_max, p_partkey % 5 <> 0 AS is_active FROM part)"""
_SCORE = " + ".join(f"CASE WHEN contains(h, '{t}') THEN 1 ELSE 0 END" for t in ("red", "widget", "small", "gear", "things", "brand"))
_SCORE2 = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in ("thing", "shines", "winter", "thin", "ingots", "stones"))
_WEAK = "lower(regexp_replace(trim(url), '/+$', ''))"
_BARE = f"regexp_replace(regexp_replace({_WEAK}, '^https?://', ''), '^www\\.', '')"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_FEATURE = "CASE " + " ".join(f"WHEN contains(p, {_quoted(s)}) THEN '{label}'" for s, label in SIGNATURES) + " ELSE 'other' END"
_SECTION = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(p, {_quoted(w)})' for w in ws)} THEN '{label}'" for label, ws in SECTIONS) + " ELSE 'summerPrograms' END"
_VOCAB = "['the', 'and', 'con', 'und', 'les', 'para', 'thing']"

ORACLES = {
    "prefilter_top100": f"""WITH {_CATALOG}, g AS (SELECT count(*) FILTER (type IN ('ECONOMY', 'SMALL')) AS n FROM cat),
p AS (SELECT cat.*, lower(name || ' ' || org) AS h FROM cat, g WHERE (n < 15 OR type IN ('ECONOMY', 'SMALL')) AND coalesce(grade_min, 9) <= 9 AND coalesce(grade_max, 9) >= 9),
s AS (SELECT id, {_SCORE} + CASE WHEN list_has_any(string_split(lower(name), ' '), ['red', 'gear']) THEN 3 ELSE 0 END AS score FROM p), k AS (SELECT count(*) FILTER (score > 0) AS n FROM s)
SELECT id, score FROM s, k WHERE k.n < 60 OR score > 0 ORDER BY score DESC, id LIMIT 100""",
    "relaxed_search": f"""WITH {_CATALOG}, k AS (SELECT count(*) FILTER (price = 'free' AND type = 'PROMO' AND org = 'Brand#7') AS n FROM cat) SELECT id, type, org FROM cat, k WHERE n < 20 OR (price = 'free' AND type = 'PROMO' AND org = 'Brand#7')""",
    "facet_values": f"""WITH {_CATALOG}, e AS (SELECT DISTINCT 'type' AS field, type AS value FROM cat UNION SELECT 'org', org FROM cat UNION SELECT 'price', price FROM cat) SELECT field, string_agg(value, '|' ORDER BY value) AS choices, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""",
    "faceted_results": f"""WITH {_CATALOG} SELECT id, type, org FROM cat WHERE type IN ('ECONOMY', 'PROMO') AND org IN ('Brand#1', 'Brand#2', 'Brand#3')""",
    "result_order": f"""WITH {_CATALOG} SELECT row_number() OVER (ORDER BY CASE WHEN id % 10 = 0 THEN 0 WHEN id % 7 = 0 THEN 1 ELSE 2 END, id % 3, id) AS place, id FROM cat""",
    "ranked_candidates": f"""WITH {_CATALOG} SELECT CAST(id / 5 + 1 AS INTEGER) AS place, id, name, CASE WHEN id % 2 = 0 THEN 'strong' ELSE 'look' END AS tier FROM cat WHERE id % 5 = 0""",
    "tag_match": """SELECT doc_id, 'match' AS verdict FROM documents WHERE contains(lower(text), 'thatst the robotics club') OR (contains(lower(text), 'thatst')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'robotics')::INT + contains(lower(text), 'club')::INT) >= 2""",
    "untracked_anti": """SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 45 AND l_orderkey = o.o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 45 AND l_partkey % 1500 = o.o_custkey)""",
    "survivor_search": f"""WITH {_CATALOG}, f AS (SELECT *, false AS exact FROM cat WHERE (name ILIKE '%17%' OR org ILIKE '%17%') AND id <> 17 ORDER BY is_active DESC, name, id LIMIT 25)
SELECT id, name, org, is_active, exact FROM (SELECT *, true AS exact FROM cat WHERE id = 17 UNION ALL SELECT * FROM f)""",
    "url_keys": rf"""WITH t AS (SELECT page_id, url, trim(coalesce(url, '')) AS t FROM pages), q AS (SELECT *, CASE WHEN t = '' THEN '' WHEN contains(t, '://') THEN t ELSE 'https://' || ltrim(t, '/') END AS w FROM t),
u AS (SELECT page_id, {_WEAK} AS weak, {_BARE} AS bare, regexp_replace(lower(regexp_extract(w, '^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
 list_filter(string_split(regexp_extract(w, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts,
 list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(w, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: {{'n': url_decode(replace(regexp_extract(p, '^[^=]*'), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))}}), lambda p: lower(p.n) NOT IN ({', '.join(_quoted(x) for x in urls.TRACKING)}))) AS pairs FROM q),
v AS (SELECT page_id, weak, bare, host, '/' || array_to_string(CASE WHEN lower(parts[-1]) IN ({', '.join(_quoted(x) for x in urls.INDEX_FILES)}) THEN parts[:-2] ELSE parts END, '/') AS path,
 array_to_string(list_transform(pairs, lambda p: replace(url_encode(p.n), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') AS query, list_filter(string_split(host, '.'), lambda p: p <> '') AS labels FROM u)
SELECT page_id, weak, bare, host, path, query, CASE WHEN host = '' THEN '' ELSE host || regexp_replace(lower(path), '/+$', '') || CASE WHEN query <> '' THEN '?' || lower(query) ELSE '' END END AS match_key,
 array_to_string(CASE WHEN len(labels) <= 2 THEN labels WHEN length(labels[-1]) = 2 AND labels[-2] IN ({', '.join(_quoted(x) for x in urls.SECOND_LEVEL)}) THEN labels[-3:] ELSE labels[-2:] END, '.') AS domain FROM v""",
    "catalog_scan": f"WITH {_CATALOG} SELECT id, name, org, type, price, grade_min, grade_max FROM cat WHERE is_active",
    "catalog_keys": f"SELECT DISTINCT {_WEAK} AS key FROM (SELECT CASE WHEN page_id % 2 = 0 THEN ' ' || url || '//' ELSE upper(url) END AS url FROM pages) WHERE url IS NOT NULL",
    "domain_peers": r"""WITH h AS (SELECT page_id, list_filter(string_split(regexp_extract(lower(url), '^[^:]+://([^/?#:]*)', 1), '.'), lambda p: p <> '') AS p FROM pages), d AS (SELECT page_id, array_to_string(p[-2:], '.') AS domain FROM h) SELECT page_id, count(*) OVER (PARTITION BY domain) - 1 AS peers FROM d""",
    "url_duplicate_audit": f"""WITH a AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1, upper(url) || '/' FROM pages WHERE page_id % 3 = 0), k AS (SELECT page_id, {_BARE} AS url_key FROM a) SELECT url_key, count(*) AS n, min(page_id) AS first_id, max(page_id) AS last_id FROM k GROUP BY 1 HAVING count(*) > 1""",
    "name_duplicate_audit": f"""WITH {_CATALOG}, k AS (SELECT id, trim(regexp_replace(regexp_replace(lower(name || ' 2024'), '\\b(19|20)[0-9][0-9]\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM cat)
SELECT name_key, count(*) AS n, array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') AS first_ids FROM k GROUP BY 1 HAVING count(*) > 1""",
    "keyword_scores": f"""SELECT doc_id, CAST({_SCORE2} AS BIGINT) AS score, CAST(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents""",
    "text_shapes": f"""WITH {_CATALOG}, n AS (SELECT *, name || ' & ' || org AS full_name FROM cat)
SELECT id, left(regexp_replace(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50) AS slug, CASE WHEN length(full_name) > 22 THEN left(full_name, 20) || '…' ELSE full_name END AS short,
 replace(full_name, '&', '&amp;') AS html, name || '. ' || org AS merged, full_name AS merged_again FROM n""",
    "grade_parse": f"""WITH {_CATALOG} SELECT id, CAST(CASE WHEN id % 5 < 2 AND id % 12 >= 5 THEN id % 12 + 1 WHEN id % 5 = 2 THEN 10 WHEN id % 5 = 3 THEN 8 END AS BIGINT) AS grade FROM cat""",
    "feature_classify": f"""WITH g AS (SELECT *, ([{', '.join(_quoted(x) for x, _ in SIGNATURES)}])[doc_id // 2 % {len(SIGNATURES)} + 1] AS sign FROM documents), p AS (SELECT doc_id, coalesce(text, '') || ' ' || CASE WHEN doc_id % 2 = 0 THEN sign WHEN doc_id % 5 = 0 THEN upper(sign) ELSE '' END AS p FROM g)
SELECT doc_id, {_FEATURE} AS feature FROM p""",
    "section_classify": f"""WITH p AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || CASE WHEN doc_id % 3 = 0 THEN upper(([{', '.join(_quoted(w) for _, ws in SECTIONS for w in ws)}])[doc_id % 21 + 1]) ELSE '' END) AS p FROM documents) SELECT doc_id, {_SECTION} AS section FROM p""",
    "tag_mentions": f"""WITH f AS (SELECT doc_id, list_filter({_VOCAB}, lambda v: contains(lower(text), v)) AS t FROM documents) SELECT doc_id, CASE WHEN len(t) < 2 THEN 'general|misc' ELSE array_to_string(list_slice(t, 1, 3), '|') END AS tags FROM f""",
}
