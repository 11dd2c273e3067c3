"""Operator 8: mix sources to target weights by hierarchical budgeting.

The leaves of the tree domain / language / source have a supply of tokens (words between white space), times the
epochs that may be repeated. A budget flows down: children share it by weight, none gets more than its subtree can
supply, and what one cannot use goes to its siblings before anything returns to an ancestor. All of it is integer
arithmetic over the leaf table in window functions, so any SQL engine gets the same budgets.

Each leaf then takes a prefix of its tokens from seeded epochs: an epoch is an order of the leaf's documents by a hash
of seed, epoch and id. The running sum is taken in two levels: sums of hash ranges first, then inside a range, so
a leaf with a third of all rows is dealt over as many tasks as it has ranges.

Defined results: null lang or source is a child named ''; documents without tokens are taken by no epoch; ties in the
hash order go by id, then by the text's checksum; rows that repeat id, text, lang and source count once and are taken
together; rows with a null doc_id take part like others. A weight that is not given is 1; a weight of 0 switches a child and
all below it off, and its share goes to the others. An empty table gives none. Documents that are passed on are whole: the
last one of a leaf's prefix is not cut, so a leaf may exceed its budget by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

LEVELS = ("domain", "lang", "source")
#: Production parameters: weights by level and name, epochs, share of all tokens to take, seed, hash ranges of a leaf.
WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
EPOCHS = 2
SHARE = (7, 10)
SEED = 17
RANGES = 1024
DOMAINS = 4


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _number(text: Column) -> Column:
    """The first 60 bits of a text's md5 as a number: any SQL engine can say the same."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def domain(source: Column) -> Column:
    """A source's domain; the tables name none, so sources are dealt to DOMAINS groups by hash."""
    return F.concat(F.lit("d"), (_number(source) % DOMAINS).cast("string"))


def _weight(level: str, weights: dict) -> Column:
    known = weights.get(level) or {}
    if any(v < 0 for v in known.values()):
        raise ValueError("weights are 0 or more")
    if not known:
        return F.lit(1).cast("long")
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col(level)), F.lit(1)).cast("long")


def _share(children: DataFrame, parents: list[str], level: str, weights: dict) -> DataFrame:
    """children: parents, level, supply, budget (the parent's). The budget becomes the child's own, at most its supply."""
    # a child without weight has no supply, so what it counts as here never matters
    w = children.withColumn("weight", F.greatest(_weight(level, weights), F.lit(1).cast("long")))
    # those that run short first, by supply / weight
    order = [F.col("supply").cast("double") / F.col("weight"), F.col(level)]
    group = W.partitionBy(*parents).orderBy(*order)
    before, after = group.rowsBetween(W.unboundedPreceding, -1), group.rowsBetween(0, W.unboundedFollowing)
    big = lambda c: c.cast("decimal(38,0)")
    w = w.withColumn("left", F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0))).withColumn("shares", F.sum("weight").over(after))
    w = w.withColumn("short", big(F.col("supply")) * big(F.col("shares")) <= big(F.col("left")) * big(F.col("weight")))
    whole = W.partitionBy(*parents)
    first = F.max(F.when(~F.col("short"), F.struct("shares", "left"))).over(whole)  # the first that does not run short has the largest shares
    w = w.withColumn("rest", first)
    part = F.floor(big(F.col("rest.left")) * big(F.col("weight")) / big(F.col("rest.shares"))).cast("long")
    return w.withColumn("budget", F.when(F.col("short"), F.col("supply")).otherwise(F.least(F.col("supply"), part))).drop("weight", "left", "shares", "short", "rest")


def leaf_budgets(leaves: DataFrame, weights: dict, epochs: int, share: tuple[int, int]) -> DataFrame:
    """leaves: domain, lang, source, n_tokens. Adds each leaf's budget; the whole budget is share[0] / share[1] of all tokens."""
    on = F.lit(True)
    for level in LEVELS:
        on = on & (_weight(level, weights) > 0)
    leaves = leaves.withColumn("supply", F.when(on, F.col("n_tokens") * epochs).otherwise(0).cast("long"))
    total = leaves.agg(F.floor(F.sum("n_tokens") * share[0] / share[1]).cast("long").alias("budget"))
    above: list[str] = []
    got = leaves.groupBy("domain").agg(F.sum("supply").alias("supply")).crossJoin(F.broadcast(total))
    for level in LEVELS:
        if above:
            got = leaves.groupBy(*above, level).agg(F.sum("supply").alias("supply")).join(got.select(*above, "budget"), above)
        got = _share(got, above, level, weights)
        above.append(level)
    return leaves.join(got.select(*LEVELS, "budget"), list(LEVELS)).select(*LEVELS, "n_tokens", "budget")


def _keyed(docs: DataFrame) -> DataFrame:
    lang, source = (F.coalesce(F.col(c), F.lit("")) for c in ("lang", "source"))
    return docs.withColumns({"_domain": domain(source), "_lang": lang, "_source": source, "_check": F.coalesce(F.crc32("text"), F.lit(0))})


def mix(docs: DataFrame, weights: dict = WEIGHTS, epochs: int = EPOCHS, share: tuple[int, int] = SHARE, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, checksum, epoch, taken): a row per document and epoch taken; the last of a prefix may be cut."""
    keys = list(LEVELS)
    rows = _keyed(docs).select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_check").alias("checksum"), tokens(F.col("text")).alias("n_tokens"))
    slim = written(rows.filter("n_tokens > 0").distinct(), "mixing")
    budgets = leaf_budgets(slim.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens")), weights, epochs, share)
    # whole epochs go at once; what is left over is a prefix of one more
    plan = written(budgets.select(*keys, F.floor(F.col("budget") / F.col("n_tokens")).cast("long").alias("whole"), (F.col("budget") % F.col("n_tokens")).alias("rest")), "mixing_plan")
    placed = slim.join(_hint(plan), keys).withColumn("place", _number(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string"))))
    placed = placed.withColumn("range", F.shiftright("place", 61 - ranges.bit_length()).cast("int"))
    sums = placed.filter("rest > 0").groupBy(*keys, "range", "rest").agg(F.sum("n_tokens").alias("n"))
    running = F.sum("n").over(W.partitionBy(*keys).orderBy("range"))
    sums = written(sums.select(*keys, "range", (running - F.col("n")).alias("before"), "n", "rest").filter("before < rest").drop("rest"), "mixing_ranges")
    at = [*keys, "range"]
    ranged = placed.join(_hint(sums), at)
    full = ranged.filter("before + n <= rest").withColumn("taken", F.col("n_tokens"))
    inside = W.partitionBy(*at).orderBy("place", "doc_id", "checksum").rowsBetween(W.unboundedPreceding, -1)
    edge = ranged.filter("before + n > rest").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    edge = edge.filter("start < rest").withColumn("taken", F.least(F.col("n_tokens"), F.col("rest") - F.col("start")))
    every = placed.filter("whole > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch")).withColumn("taken", F.col("n_tokens"))
    out = ["doc_id", *keys, "n_tokens", "checksum", "epoch", "taken"]
    return full.withColumn("epoch", F.col("whole")).select(*out).unionByName(edge.withColumn("epoch", F.col("whole")).select(*out)).unionByName(every.select(*out))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that mix() takes, once for each epoch, with their own columns and whole texts."""
    picks = mix(docs, **parameters).select(F.col("doc_id").alias("_id"), F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("checksum").alias("_c"))
    rows = _keyed(docs)
    on = rows["doc_id"].eqNullSafe(picks["_id"]) & (rows["_check"] == picks["_c"]) & (rows["_domain"] == picks["_d"]) & (rows["_lang"] == picks["_l"]) & (rows["_source"] == picks["_s"])
    return rows.join(picks, on).select(*docs.columns)


#: Largest table of leaves or of their hash ranges, in rows, that is sent to every task.
BROADCAST_ROWS = 100_000


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("checksum")


def _sql_level(source: str, above: list[str], level: str) -> str:
    weight = f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {max(v, 1)}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"
    by = f"PARTITION BY {', '.join(above)}" if above else ""
    order = f"({by} ORDER BY CAST(supply AS DOUBLE) / weight, {level} ROWS BETWEEN"
    keys = ", ".join([*above, level])
    return f"""(SELECT {keys}, CAST(CASE WHEN short THEN supply ELSE least(supply, rest.l * weight // rest.s) END AS BIGINT) AS budget FROM (
 SELECT *, max({{'s': shares, 'l': l}}) FILTER (NOT short) OVER ({by}) AS rest FROM (SELECT *, supply * shares <= l * weight AS short FROM (
 SELECT *, budget - coalesce(sum(supply) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(weight) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
 FROM (SELECT {keys}, supply, budget, {weight} AS weight FROM {source})))))"""


def _sql() -> str:
    number = "CAST(concat('0x', substr(md5({0}), 1, 15)) AS BIGINT)"
    levels, above = [], []
    for level in LEVELS:
        keys = ", ".join([*above, level])
        if not above:
            source = f"(SELECT domain, sum(n_tokens) * {EPOCHS} AS supply, (SELECT sum(n_tokens) * {SHARE[0]} // {SHARE[1]} FROM leaves) AS budget FROM leaves GROUP BY 1)"
        else:
            on = ", ".join(above)
            source = f"(SELECT * FROM (SELECT {keys}, sum(n_tokens) * {EPOCHS} AS supply FROM leaves GROUP BY ALL) JOIN b_{above[-1]} USING ({on}))"
        levels.append(f"b_{level} AS {_sql_level(source, above, level)}")
        above.append(level)
    return f"""
WITH slim AS (SELECT DISTINCT doc_id, text, 'd' || {number.format("coalesce(source, '')")} % {DOMAINS} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL),
used AS (SELECT * FROM slim WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS n_tokens FROM used GROUP BY ALL),
{", ".join(levels)},
plan AS (SELECT domain, lang, source, CAST(budget // n_tokens AS BIGINT) AS whole, budget % n_tokens AS rest FROM leaves JOIN b_source USING (domain, lang, source)),
placed AS (SELECT used.*, whole, rest, {number.format(f"'{SEED}:' || whole || ':' || doc_id")} AS place FROM used JOIN plan USING (domain, lang, source)),
part AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch, CAST(least(n_tokens, rest - before) AS BIGINT) AS taken FROM part WHERE before < rest
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole)) AS epoch, n_tokens AS taken FROM placed
"""


#: The production query in DuckDB SQL, made from the same parameters.
ORACLE_SQL = _sql()
