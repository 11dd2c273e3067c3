"""Operator 3: benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's window is ten neighbouring words, or the whole item when it has fewer. A window can only occur where its
rarest word does, so the order of its words by rarity in the corpus (one counting pass over all documents) needs a
prefix of one word. Document places that hold such a word join the windows it stands for; the place must leave room
for the window on both sides (position and length bounds), and the words are then compared exactly. Words under an
occurrence are hit.

Defined results: null texts have no words and no hits; items without words or without an id are ignored; items that
repeat a window are all listed; rows with a null doc_id keep their row with no hits; rows that repeat a doc_id and its
text get the same result each, and texts that share a doc_id are judged apart. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 10
#: Largest table of windows or of item words, in rows, that is sent to every task; beyond it the joins shuffle.
BROADCAST_ROWS = 200_000
#: Largest table of seeds, by the bytes of all their windows and items, that is sent to every task.
BROADCAST_BYTES = 64 << 20

#: The characters of a word, before and after A-Z are lower-cased, and the letters themselves.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """Lower-case A-Z alone; lower() does the same for texts of single bytes, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """The words in order. Only the ends of a split can be empty; they are cut off."""
    return F.split(F.regexp_replace(fold(text), f"^{_GAP}|{_GAP}$", ""), _GAP)


def pieces_of(text: Column) -> Column:
    """The words in order; an empty one may come first and last, which joins nothing and moves all places alike."""
    return F.split(fold(text), _GAP)


def has_words(text: Column) -> Column:
    return text.rlike(_WORD)


def count_words(text: Column) -> Column:
    ends = [F.when(F.substr(text, F.lit(at), F.lit(1)).rlike(_GAP), 1).otherwise(0) for at in (1, -1)]
    return F.when(text == "", 0).otherwise(F.size(F.split(text, _GAP)) - ends[0] - ends[1]).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table whose rows are counted first; a larger one is left to shuffled joins."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _seeds_fit(seeds: DataFrame) -> bool:
    """Whether all windows that the seeds hold, with their items, fit into every task."""
    if seeds.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    each = F.aggregate("seeds", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(F.array_join(s["words"], " ")) + F.octet_length(F.array_join(s["items"], " ")) + 16 * F.size(s["words"]) + 64)
    return (seeds.agg(F.sum(each)).head()[0] or 0) <= BROADCAST_BYTES


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, size, items): each distinct window with the ids, as strings, of the items that hold it."""
    items = benchmark.filter(has_words(F.col("text")) & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, window))).alias("words"))
    return each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select("words", F.size("words").alias("size"), "items")


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with `text_key`, which tells apart texts that share a doc_id."""
    return docs.withColumn("text_key", F.xxhash64("text"))


KEY = ("doc_id", "text_key")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, start, size, items): every place where a window occurs.

    Where the seeds fit into every task, a text's words are compared as they are met. Where they do not, only (key, place, word)
    is shuffled, and the words of documents with places that may hold a window are fetched once more.
    The outer forms of explode split a text once: for the inner ones the optimizer also splits it in a filter."""
    texts = keyed(docs.filter("doc_id is not null and text is not null").select("doc_id", "text")).select(*KEY, pieces_of(F.col("text")).alias("w"))
    windows = written(item_windows(benchmark, window), "item_windows")
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    counts = texts.select(F.explode_outer("w").alias("word")).join(_small(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    placed = windows.select("words", "size", "items", F.posexplode("words").alias("offset", "word"))
    rarest = (
        placed.join(counts, "word", "left")
        .groupBy("words", "size", "items")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("rarest"))
        .filter("rarest.n > 0")
        .select("words", "size", "items", F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"))
    )
    seeds = written(rarest.groupBy("word").agg(F.collect_list(F.struct("words", "size", "items", "offset")).alias("seeds")), "seeds")
    start = F.col("at") - F.col("s.offset")
    if _seeds_fit(seeds):
        places = texts.select(*KEY, "w", F.posexplode_outer("w").alias("at", "word")).join(F.broadcast(seeds), "word").select(*KEY, "w", "at", F.explode("seeds").alias("s"))
    else:
        met = texts.select(*KEY, F.posexplode_outer("w").alias("at", "word")).join(seeds, "word").select(*KEY, "at", F.explode("seeds").alias("s")).filter(start >= 0)
        met = written(met.distinct(), "places")
        of_these = met.select(*KEY).distinct()
        places = met.join(texts.join(of_these, list(KEY), "left_semi").dropDuplicates(list(KEY)), list(KEY))
    return (
        places.filter((start >= 0) & (start + F.col("s.size") <= F.size("w")))
        .filter(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("s.size")) == F.col("s.words"))
        .select(*KEY, start.alias("start"), "s.size", "s.items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_hit, n_items, item_ids) of the documents in which a window occurs."""
    found = occurrences(docs, benchmark, window)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"]))))
    return (
        found.groupBy(*KEY)
        .agg(F.collect_set(F.struct("start", "size", "items")).alias("spans"))
        .select(*KEY, F.size(covered).cast("long").alias("n_hit"), items.alias("item_ids"))
        .select(*KEY, "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = contamination(docs, table(spark, sf_dir, "benchmark"))
    rows = keyed(docs).select(*KEY, F.coalesce(count_words(F.col("text")), F.lit(0)).alias("n_words"))
    return rows.join(hits, list(KEY), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


_SQL_WORDS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT item_id, list_slice(w, s + 1, s + 10) AS win, least(len(w), 10) AS k
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, s, k, list_slice(w, s + 1, s + k) AS win
       FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
