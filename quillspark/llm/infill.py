"""Operator 13: fill-in-middle transformation over relational units.

A text's units are the matches of UNIT: rows (text, ordinal, length). A window sums lengths along the ordinals, so a unit knows
where it ends; the cut requests of a text (prefix and middle end after so many units) meet the units by ordinal, and the ends
so found are gathered to a row of offsets a text. Offsets then cut the text by substring. Only texts that are rearranged have
rows of units, and rows of equal id and text, which are cut alike, share them; what is shuffled is lengths, not texts, until the offsets meet
their texts. Offsets are a table of their own, so that a common row's texts can be split between tasks there.

The output is undone from itself: no marker occurs in a text that is rearranged, and as all markers begin with the only "<" in
them, none can arise where two parts meet, so the first of each marker is the one that was put there.

Defined results: a null text is empty; empty texts, texts with a marker and those that the draw leaves out are plain; a null
doc_id draws as an empty one; white space alone is one unit, and white space at the end is a unit of its own; rows that repeat
an id and text get the same result each, texts that share an id are cut apart; lengths are code points and texts of any length
are whole; an empty table gives an empty result. Other columns pass whatever their names, but for those that are made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, table, written

SEED = 42
#: Of a hundred texts, how many are rearranged, and how many of these suffix first.
RATE, SPM_RATE = 50, 80
#: A unit, and the markers of prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Columns that the transformation makes.
MADE = ("form", "n", "prefix_chars", "middle_chars", "output")


def _draw(n: int) -> Column:
    """The nth number that the digest of seed and id gives."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * n - 7, 8), 16, 10).cast("long")


def drawn(docs: DataFrame) -> DataFrame:
    """docs with `text` not null and `form`: plain, psm or spm."""
    text = F.col("text")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (_draw(3) % 100 >= RATE)
    form = F.when(plain, "plain").when(_draw(4) % 100 < SPM_RATE, "spm").otherwise("psm")
    return docs.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("form", form)


def _text_key() -> Column:
    """Tells apart ids and texts by a digest of both."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256))


def units(lengths: DataFrame) -> DataFrame:
    """lengths: key, lengths. (key, ordinal, end): where each unit ends, ordinals from 1."""
    each = lengths.select("key", F.posexplode("lengths").alias("at", "length"))
    along = W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return each.select("key", (F.col("at") + 1).alias("ordinal"), F.sum("length").over(along).alias("end"))


def offsets(rows: DataFrame) -> DataFrame:
    """rows of doc_id and text, none plain. (key, n, first, second): number of units, and the code points before either cut."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNIT), 0), lambda u: F.length(u))
    cut = [(_draw(i) % (F.size("lengths") + 1)).cast("int") for i in (1, 2)]
    each = rows.withColumn("lengths", lengths).select(_text_key().alias("key"), "lengths", F.least(*cut).alias("a"), F.greatest(*cut).alias("b"))
    each = written(each, "unit_lengths")  # texts are matched once, for the units and for the requests
    once = each.groupBy("key").agg(F.first("lengths").alias("lengths"), F.first("a").alias("a"), F.first("b").alias("b"))
    requests = once.select("key", F.size("lengths").alias("n"), "a", "b")
    # one request row a text, met by ordinal: both sides stay where the key put them
    met = requests.alias("r").join(units(once).alias("u"), (F.col("r.key") == F.col("u.key")) & F.col("u.ordinal").isin(F.col("r.a"), F.col("r.b")), "left")
    end = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0)).cast("int")
    cuts = met.groupBy("r.key", "r.n", "r.a", "r.b").agg(end("a").alias("first"), end("b").alias("second")).select("key", "n", "first", "second")
    cuts = written(cuts, "cuts")
    drop(each)
    return cuts


def infilled(docs: DataFrame) -> DataFrame:
    """docs with form, n (units), prefix_chars, middle_chars (null if plain) and output."""
    rows = drawn(docs.drop(*MADE))
    cuts = offsets(rows.filter("form <> 'plain'").select("doc_id", "text"))
    text, first, second = F.col("text"), F.col("_first"), F.col("_second")
    cuts = cuts.select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("first").alias("_first"), F.col("second").alias("_second"))
    keyed = rows.withColumn("_key", F.when(F.col("form") != "plain", _text_key()))
    plain = keyed.filter("form = 'plain'").select(*rows.columns, F.regexp_count("text", F.lit(UNIT)).alias("n"), *(F.lit(None).cast("int").alias(c) for c in ("prefix_chars", "middle_chars")), text.alias("output"))
    prefix, middle, suffix = F.substr(text, F.lit(1), first), F.substr(text, first + 1, second - first), F.substr(text, second + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).otherwise(spm)
    moved = keyed.filter("form <> 'plain'").join(cuts, "_key").select(*rows.columns, F.col("_n").alias("n"), first.alias("prefix_chars"), (second - first).alias("middle_chars"), output.alias("output"))
    return plain.unionByName(moved)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone."""

    def parts(opening: str, between: str) -> tuple[Column, Column, Column]:
        at = F.locate(between, output)
        to = F.locate(MIDDLE, output)
        one = F.substr(output, F.lit(len(opening) + 1), at - len(opening) - 1)
        return one, F.substr(output, at + len(between), to - at - len(between)), F.substr(output, to + len(MIDDLE))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    other_suffix, other_prefix, other_middle = parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(other_prefix, other_middle, other_suffix))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infilled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("n").cast("long").alias("n"),
        "form",
        F.col("prefix_chars").cast("long").alias("prefix_chars"),
        F.col("middle_chars").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _h(n: int) -> str:
    return f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * n - 7}, 8) AS BIGINT)"


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, t, regexp_extract_all(t, '{UNIT}') AS u,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_h(3)} % 100 >= {RATE} THEN 'plain' WHEN {_h(4)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
           FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
c AS (SELECT *, len(u) AS n, least({_h(1)} % (len(u) + 1), {_h(2)} % (len(u) + 1)) AS a, greatest({_h(1)} % (len(u) + 1), {_h(2)} % (len(u) + 1)) AS b FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
