"""Entity resolution: candidate joins on keys and a lossless filter before the name ratio, tiered verdicts, greedy acceptance."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions import urls
from quillspark.operators import graph
from quillspark.sources.shared import dealt, materialised

SAME, SIMILAR = 0.82, 0.88
#: Names that say nothing.
GENERIC = ("custom opportunity", "opportunity", "program", "summer program", "internship", "competition", "conference", "journal", "untitled")
PEERS = 3
#: Rounds that decide rows side by side, before chains are walked.
ROUNDS = 4


def _ratio(a: str | None, b: str | None) -> float:
    if not a or not b or len(a) < 4 or len(b) < 4 or a in GENERIC or b in GENERIC:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(a, b, strict=True)])


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, which no sum of matching blocks exceeds; a bit for each character of a."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    every = free = (1 << len(a)) - 1
    for ch in b:
        hit = free & at.get(ch, 0)
        free = (free + hit | free - hit) & every
    return len(a) - free.bit_count()


def _like(a: str, b: str, least: float) -> float:
    """The ratio of two names if their common characters allow `least`, else 0."""
    return _ratio(a, b) if 2.0 * _common(a, b) >= least * (len(a) + len(b)) - 1e-9 else 0.0


def like_ratio(a, b, least: float):
    """The ratio of names that may be alike, else 0: common characters in order tell most others at a tenth of the cost."""

    @F.pandas_udf(DoubleType())
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_like(x, y, least) for x, y in zip(a, b, strict=True)], dtype="float64")

    # else the filter on its result would be moved in front of the deal, and the ratio worked out twice
    return ratios.asNondeterministic()(a, b)


def with_keys(rows: DataFrame) -> DataFrame:
    parts = urls.parsed(rows, "url").withColumnRenamed("match_key", "key").drop("query")
    return parts.withColumns({"path": F.regexp_replace(F.lower("path"), "/+$", ""), "name_key": urls.name_key(F.col("name"))})


def name_tokens(name):
    """Neighbouring characters, each with how often the pair stood before: equal multisets of pairs are equal sets of tokens."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substr(name, i, F.lit(2)))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)).cast("string")))


def shared_least(total, least: float):
    """The fewest tokens that two names with `total` characters together share when their ratio is `least` or more.

    They match in M >= least * total / 2 characters and k blocks. Between two blocks at least one character is not matched, so
    k <= total - 2 M + 1, and a block of s characters has s - 1 tokens: M - k >= 3 M - total - 1 tokens are shared."""
    return 3 * F.ceil(F.round(F.lit(least) * total / 2, 9)).cast("int") - total - 1


def _prefixed(names: DataFrame, least: float) -> DataFrame:
    """(name, tokens, keys): the tokens of each name, rare ones first, and how many of them have to meet a like name's.

    The shorter of two like names has least / (2 - least) of the longer one's length at least, which bounds what they share."""
    tokens = names.withColumn("token", F.explode(name_tokens(F.col("name"))))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    listed = tokens.join(counts, "token").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tokens"))
    size = F.length("name")
    shared = F.floor((size + F.ceil(size * (least / (2 - least)) - 1e-9)) * (1.5 * least - 1) - 1)
    return listed.withColumn("keys", F.greatest(F.lit(1), size - F.greatest(F.lit(1), shared)).cast("int"))


def alike_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(name_key, k_key, ratio) for the distinct names of a (name_key) and b (k_key) whose ratio is `least` or more.

    A prefix-filtered join on rare tokens finds the pairs, the number of tokens that they share bounds the ratio, and only what is left
    is compared character by character. Runs jobs when it is called."""
    fits = lambda c: (F.length(c) >= 4) & ~F.col(c).isin(*GENERIC)
    left, right = a.filter(fits("name_key")).select("name_key").distinct(), b.filter(fits("k_key")).select("k_key").distinct()
    every = materialised(_prefixed(left.select(F.col("name_key").alias("name")).unionByName(right.select(F.col("k_key").alias("name"))).distinct(), least), "names")
    rows = lambda names, c: names.join(every, F.col(c) == F.col("name")).select(c, F.explode(F.slice("tokens", F.lit(1), F.col("keys"))).alias("token"))
    x, y = F.length("name_key"), F.length("k_key")
    a, b = rows(left, "name_key"), rows(right, "k_key")
    # names are few for the pairs that they make, so tasks go by pairs
    work = a.join(b.groupBy("token").count(), "token").agg(F.sum("count")).head()[0] or 0
    met = dealt(a, work, "token").join(dealt(b, work, "token"), "token").filter(2 * F.least(x, y) >= least * (x + y)).select("name_key", "k_key").distinct()
    met = dealt(met, work, "name_key", "k_key")
    met = met.join(every.select(F.col("name").alias("name_key"), F.col("tokens").alias("_a")), "name_key").join(every.select(F.col("name").alias("k_key"), F.col("tokens").alias("_b")), "k_key")
    near = materialised(met.filter(F.size(F.array_intersect("_a", "_b")) >= shared_least(x + y, least)).select("name_key", "k_key"), "near")
    return dealt(near, near.count(), "name_key", "k_key").withColumn("ratio", like_ratio("name_key", "k_key", least)).filter(F.col("ratio") >= least)


def _least(rows: DataFrame, by: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each group; Spark limits the groups before it shuffles them, too."""
    w = W.partitionBy(*by).orderBy(*(order or ("c_pos", "c_id")))
    return rows.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= n).drop("_nth")


def _least_apart(rows: DataFrame, by: list[str], n: int, *order) -> DataFrame:
    """The first rows of each group, enough that n stay whichever one apply page is taken out: n of each page, 2 n in all."""
    return _least(_least(rows, [*by, "c_apply_key"], n, *order), by, 2 * n, *order)


def _nearest(pairs: DataFrame, rows: DataFrame, by: list[str], apart: list[str], n: int) -> DataFrame:
    """Of pairs (by, c_name_key, likeness `by`) those whose rows can be among the first n of `by`.

    A name is left out when the rows of nearer names are n or more whichever one value of each column in `apart` is taken out."""
    group = [*(x for x in by if x in rows.columns), "c_name_key"]
    of_value = {f"_{a}": F.when(F.col(a) != "", F.count(F.lit(1)).over(W.partitionBy(*group, a))).otherwise(0) for a in apart}
    lost = sum((F.max(a) for a in of_value), F.lit(0))
    sure = rows.withColumns(of_value).groupBy(*group).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - lost).alias("_sure"))
    nearer = F.sum("_sure").over(W.partitionBy(*by).orderBy(F.desc("by"))) - F.sum("_sure").over(W.partitionBy(*by, "by"))
    return pairs.join(sure, group).withColumn("_nearer", nearer).filter(F.col("_nearer") < n).drop("_sure", "_nearer")


def _above(path):
    """The paths that a path lies under, without the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def duplicate_candidates(submissions: DataFrame, catalog: DataFrame, most: int = 5, same: bool = False) -> DataFrame:
    """submissions: id, url, apply_url, name; catalog: id, url, name, pos, and apply_url where it has one. (id, exact, candidates) by tier.

    same: the submissions are rows of the catalog, and none is compared with itself. Submissions with equal keys are one class.
    For a class only rows that can be among its first are paired: the first `top` of a key, of a key and name, of a domain and
    name, and so on; what a rule after that takes away (a row itself, an apply page, the own domain) is allowed for in the
    numbers kept, so no pair that counts is lost. An exact duplicate empties the candidate list.
    """
    top = most + 1
    apply_key = F.when(F.trim(F.coalesce("apply_url", F.lit(""))) == "", "").otherwise(urls.match_key(F.col("apply_url")))
    s = with_keys(dealt(submissions, submissions.count(), "id")).withColumn("apply_key", apply_key)
    c = with_keys(dealt(catalog, catalog.count(), "id")).withColumn("apply_key", apply_key if "apply_url" in catalog.columns else F.lit(""))
    s = materialised(s.select(*(F.col(x).alias(f"s_{x}") for x in ("id", "key", "apply_key", "path", "domain", "name_key"))), "submissions")
    c = materialised(c.select(*(F.col(x).alias(f"c_{x}") for x in ("id", "key", "apply_key", "path", "domain", "name_key", "pos"))), "catalog").filter("c_key <> ''")
    kind = ["s_key", "s_apply_key", "s_path", "s_domain", "s_name_key"]
    of_class = [*kind, *c.columns]
    classes = materialised(s.select(*kind).distinct(), "classes")
    alike = alike_names(s.select(F.col("s_name_key").alias("name_key")), c.select(F.col("c_name_key").alias("k_key")), SAME)
    alike = materialised(alike.select(F.col("name_key").alias("s_name_key"), F.col("k_key").alias("c_name_key"), F.col("ratio").alias("by")), "alike")

    of_key = materialised(_least(c, ["c_key"], top), "keyed")
    of_name = materialised(_least_apart(c, ["c_key", "c_name_key"], top), "named")
    of_domain = materialised(_least_apart(of_name, ["c_domain", "c_name_key"], 3 * top), "sited")
    elsewhere = materialised(_least_apart(of_domain, ["c_name_key"], 9 * top), "elsewhere")
    same_page, same_name = F.col("s_key") == F.col("c_key"), F.col("s_name_key") == F.col("c_name_key")
    same_site = (F.col("s_domain") == F.col("c_domain")) & (F.col("s_domain") != "")
    applies = (F.col("s_key") != "") & ((F.col("s_key") == F.col("c_apply_key")) | (F.col("s_apply_key") == F.col("c_key")) & (F.col("s_apply_key") != ""))

    keyed = classes.filter("s_key <> ''")
    twins = keyed.join(alike, "s_name_key").join(of_name.withColumnRenamed("c_key", "s_key"), ["s_key", "c_name_key"]).withColumn("c_key", F.col("s_key")).select(*of_class)
    twins = _least(twins.unionByName(keyed.join(of_name, same_page & same_name)).distinct(), kind, top)
    by_key = keyed.join(of_key, same_page)
    by_apply = keyed.filter("s_apply_key <> ''").join(of_key, F.col("s_apply_key") == F.col("c_key"))
    by_applied = keyed.join(_least(c.filter("c_apply_key <> ''"), ["c_apply_key"], top), F.col("s_key") == F.col("c_apply_key"))
    under = _least_apart(of_name.withColumn("_up", F.explode(_above(F.col("c_path")))), ["c_domain", "_up", "c_name_key"], 3 * top)
    sited = classes.filter("s_domain <> ''")
    below = sited.join(under, (F.col("s_domain") == F.col("c_domain")) & (F.col("s_path") == F.col("_up")))
    above = sited.withColumn("_up", F.explode(_above(F.col("s_path")))).join(_least_apart(of_name, ["c_domain", "c_path", "c_name_key"], 3 * top), (F.col("s_domain") == F.col("c_domain")) & (F.col("_up") == F.col("c_path")))
    named = classes.select("s_domain", "s_key", "s_apply_key", "s_name_key").distinct()
    asked = classes.select("s_domain", "s_name_key").distinct()
    best = (F.desc("by"), "c_pos", "c_id")
    # the first rows of a name at a site, and of a name anywhere, are chosen once for all pages that ask; names that come too late meet no rows
    site = ["s_domain", "s_name_key"]
    local = of_domain.withColumn("s_domain", F.col("c_domain"))
    here = _nearest(asked.filter("s_domain <> ''").join(alike, "s_name_key"), local, site, ["c_apply_key", "c_key"], top)
    here = _least_apart(here.join(local, ["s_domain", "c_name_key"]), [*site, "c_key"], top, *best)
    here = named.join(_least_apart(here, site, 3 * top, *best), site).filter(~applies)
    there = _nearest(alike.filter(F.col("by") >= SIMILAR), elsewhere, ["s_name_key"], ["c_apply_key", "c_key", "c_domain"], top)
    there = _least_apart(there.join(elsewhere, "c_name_key"), ["s_name_key", "c_key"], top, *best)
    there = _least_apart(_least_apart(there, ["s_name_key", "c_domain"], 3 * top, *best), ["s_name_key"], 9 * top, *best)
    there = named.join(asked.join(there, "s_name_key").filter(~same_site), site).filter(~applies)
    by_name = _least(here, named.columns, top, *best).select(*named.columns, *c.columns).unionByName(_least(there, named.columns, top, *best).select(*named.columns, *c.columns))
    by_name = classes.join(by_name, named.columns).select(*of_class)
    # of a domain with few rows all are at hand, of any other one too many
    few = _least(c, ["c_domain"], PEERS + int(same) + 1)
    few = few.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("c_domain"))).filter(F.col("_n") <= PEERS + int(same))
    by_site = sited.join(few, F.col("s_domain") == F.col("c_domain")).select(*of_class, F.lit(True).alias("few"))

    pairs = twins.select(*of_class)
    for more in (by_key, by_apply, by_applied, below, above, by_name):
        pairs = pairs.unionByName(more.select(*of_class))
    pairs = pairs.withColumn("few", F.lit(False)).unionByName(by_site).groupBy(*of_class).agg(F.max("few").alias("few"))
    names = ["s_name_key", "c_name_key"]
    same_page = same_page & (F.col("s_key") != "")
    like = F.coalesce(F.col("by"), F.lit(0.0))
    tier = (
        F.when(same_page & (same_name | (like >= SAME)), "exact")
        .when(same_page, "strong")
        .when(applies, "strong")
        .when(same_site & urls.is_prefix(F.col("s_path"), F.col("c_path")), "strong")
        .when(same_site & (like >= SAME), "strong")
        .when(like >= SIMILAR, "weak")
        .when(same_site & F.col("few"), "weak")
    )
    pairs = materialised(pairs.join(alike, names, "left").withColumn("tier", tier).filter("tier is not null"), "pairs")
    # names that are not alike count only where the site alone makes a pair
    ratios = pairs.filter(F.col("by").isNull() & ~same_page & ~applies).select(*names).distinct().withColumn("ratio", name_ratio(*names))
    pairs = pairs.join(ratios, names, "left").withColumn("ratio", F.coalesce("by", "ratio"))
    by = F.when(same_page, 1.0).when(applies, 0.0).otherwise(F.col("ratio"))
    found = pairs.withColumn("rank", F.when(F.col("tier") == "exact", 0).when(F.col("tier") == "strong", 1).otherwise(2))
    found = found.withColumn("place", F.struct("rank", (-by).alias("by"), F.col("c_pos").alias("pos"), F.col("c_id").alias("id"), "tier")).withColumn("hit", F.col("rank") == 0)
    # exact ones stand first by position; the others by rank, likeness and position
    found = found.withColumn("place", F.when(F.col("hit"), F.col("place").withField("by", F.lit(0.0))).otherwise(F.col("place")))
    first = _least(found, [*kind, "hit"], top, "place").groupBy(*kind).agg(F.sort_array(F.collect_list("place")).alias("found"))
    mine = s.join(first, kind).withColumn("found", F.filter("found", lambda p: ~(F.lit(same) & (p["id"] == F.col("s_id")))))
    exact = F.get(F.filter("found", lambda p: p["rank"] == 0), F.lit(0))["id"]
    listed = F.transform(F.slice("found", 1, most), lambda p: F.concat_ws(":", p["tier"], p["id"].cast("string")))
    return mine.filter(F.size("found") > 0).select(F.col("s_id").alias("id"), exact.alias("exact"), F.when(exact.isNotNull(), F.array().cast("array<string>")).otherwise(listed).alias("candidates"))


def fuzzy_new(new: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """New rows whose name is like no known name: pairs of distinct names by shared runs and the lossless bound, then the ratio."""
    keyed = new.withColumn("name_key", urls.name_key(F.col("name")))
    hits = alike_names(keyed.select("name_key"), known.select(urls.name_key(F.col("name")).alias("k_key")), least).select("name_key").distinct()
    return keyed.join(hits, "name_key", "left_anti").drop("name_key")


def greedy_new(new: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """new: id, name, url, pos; known: name, url. (id, accepted) for all new rows, as one walk in order of (pos, id) decides.

    A row is refused if a known row or one accepted before has its URL key or a like name. Known rows are excluded by joins.
    Of the rest, each of ROUNDS rounds accepts every row before which no undecided row is like it, and refuses those that follow
    an accepted one. That settles groups of any size whose rows are all alike. What is still undecided stands in chains, where a row is like the next one
    but not like the one after: its connected parts are walked in order, each by one task. Runs jobs when it is called; their
    number does not depend on the length of a chain but for the rounds that find the parts, which go by its logarithm.
    """
    seen = known.select(urls.weak(F.col("url")).alias("url_key")).filter("url_key <> ''").distinct()
    fresh = new.withColumn("url_key", urls.weak(F.col("url"))).join(seen, "url_key", "left_anti")
    fresh = fuzzy_new(fresh, known, least).select("id", "url_key", urls.name_key(F.col("name")).alias("name_key"), F.struct("pos", "id").alias("at"))
    left = materialised(fresh, "undecided")
    names = left.select("name_key").distinct()
    alike = materialised(alike_names(names, names.withColumnRenamed("name_key", "k_key"), least).select("name_key", "k_key"), "alike")

    def first_met(rows: DataFrame, others: DataFrame) -> DataFrame:
        """The first of the others with a row's URL key, and with a name like its name."""
        by_url = others.filter("url_key <> ''").groupBy("url_key").agg(F.min("at").alias("at_url"))
        by_name = others.groupBy(F.col("name_key").alias("k_key")).agg(F.min("at").alias("at_name"))
        by_name = alike.join(by_name, "k_key").groupBy("name_key").agg(F.min("at_name").alias("at_name"))
        return rows.join(by_url, "url_key", "left").join(by_name, "name_key", "left")

    earlier = F.coalesce(F.col("at_url") < F.col("at"), F.lit(False)) | F.coalesce(F.col("at_name") < F.col("at"), F.lit(False))
    taken = left.select("id").limit(0)
    for _ in range(ROUNDS):
        accepted = materialised(first_met(left, left).filter(~earlier).select(*left.columns), "accepted")
        taken = taken.unionByName(accepted.select("id"))
        rest = left.join(accepted.select("id"), "id", "left_anti")
        left = materialised(first_met(rest, accepted).filter(~earlier).select(*left.columns), "undecided")
        if left.isEmpty():
            break
    else:
        taken = taken.unionByName(_walked(left, alike))
    return new.select("id").join(taken.withColumn("accepted", F.lit(True)), "id", "left").select("id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def _walked(left: DataFrame, alike: DataFrame) -> DataFrame:
    """The ids that a walk in order accepts among undecided rows: id, url_key, name_key, at; alike: name_key, k_key."""
    here = left.select("name_key").distinct()
    pairs = alike.join(here, "name_key").join(here.withColumnRenamed("name_key", "k_key"), "k_key")
    pairs = materialised(pairs.select("name_key", "k_key"), "walk_pairs")
    name, url = F.concat(F.lit("n "), "name_key"), F.concat(F.lit("u "), "url_key")
    links = pairs.select(name.alias("a"), F.concat(F.lit("n "), "k_key").alias("b")).unionByName(left.filter("url_key <> ''").select(name.alias("a"), url.alias("b")))
    part = graph.parts(links)
    # names without links of either kind stand alone; their rows are all accepted
    rows = left.withColumn("node", name).join(part, "node", "left").select(F.coalesce("part", F.concat(F.lit("i "), F.col("id").cast("string"))).alias("part"), "id", "url_key", "name_key", F.col("at.pos").alias("pos"))
    tied = pairs.withColumn("node", name).join(part, "node").select("part", "name_key", "k_key")

    def walk(rows: pd.DataFrame, tied: pd.DataFrame) -> pd.DataFrame:
        like: dict[str, list[str]] = {}
        for a, b in zip(tied["name_key"], tied["k_key"], strict=True):
            like.setdefault(a, []).append(b)
        urls_, names, out = set(), set(), []
        for i, u, n in rows.sort_values(["pos", "id"])[["id", "url_key", "name_key"]].itertuples(index=False):
            if not (u and u in urls_ or any(k in names for k in like.get(n, ()))):
                out.append(i)
                urls_.add(u)
                names.add(n)
        return pd.DataFrame({"id": out})

    kind = left.schema["id"].dataType.simpleString()
    return rows.groupBy("part").cogroup(tied.groupBy("part")).applyInPandas(walk, f"id {kind}")


def greedy(batch: DataFrame, least: float = 0.85, group: str = "batch") -> DataFrame:
    """batch: id, name, url, pos, batch. Accepts rows in order unless an accepted one before has the same URL key or a like name.

    The order decides, so one batch is one task; a batch is what one collection run found (tens of rows). It knows
    nothing of the catalog or of other batches: greedy_new does.
    """
    keyed = batch.withColumns({"url_key": urls.weak(F.col("url")), "name_key": urls.name_key(F.col("name"))})

    def accept(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "id"])
        seen, names, out = set(), [], []
        for u, n in zip(rows["url_key"], rows["name_key"], strict=True):
            dup = bool(u) and u in seen or any(_ratio(n, k) >= least for k in names)
            out.append(not dup)
            if not dup:
                seen.add(u)
                names.append(n)
        return rows.assign(accepted=out)[["id", "accepted"]]

    return keyed.groupBy(group).applyInPandas(accept, f"id {batch.schema['id'].dataType.simpleString()}, accepted boolean")
