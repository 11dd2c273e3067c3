"""Operator 6: URL filters. Rules first; where none fits, host words are segmented and scored.

Names are the letter runs of host labels and path segments, whole and with repeats. A unigram model counts words over the texts of
all pages; the substrings of each distinct name that are as long as some word meet their counts in a join, and a Viterbi pass over one name's few substrings
splits it into the likeliest words. Multinomial naive Bayes scores the words: pages whose segmented words hold a seed word
teach the class `block`, the others `allow`; counts per word and class are an aggregate over all pages, and a page's score
is a sum over its names. Everything is keyed by names or words, so nothing grows on the driver, and hot hosts are
counted before they are joined.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is allowed; repeated
rows give repeated results; ties between rules of one length go to the first in the list; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Largest rule list; rules are a parameter, compiled into one expression.
MOST_RULES = 2_000

#: The rules of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Seed words of the class block.
SEEDS = ("adult", "bet", "bonus", "casino", "cheap", "crack", "dating", "free", "jackpot", "keygen", "loan", "lottery", "pills", "poker", "porn", "prize", "sex", "slots", "spam", "torrent", "viagra", "warez", "win", "xxx")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(verdict, rule), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        cases.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*cases) if cases else F.lit(None).cast("struct<verdict:string,rule:string>")


def names_of(host: Column, path: Column) -> Column:
    """Letter runs of host and path, folded and whole."""
    return F.regexp_extract_all(F.lower(F.concat_ws("/", host, path)), F.lit(r"\p{L}+"), F.lit(0))


def page_words(html: Column) -> Column:
    """Words of a page outside scripts, styles, comments and tags."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


@dataclass(frozen=True)
class Split:
    words: tuple[str, ...]
    cost: float


def viterbi(name: str, pieces: list[tuple[int, int, float]], unknown: float) -> Split:
    """The cheapest split of a name; pieces are (start, length, cost), an unknown run costs `unknown` and 2.3 a letter."""
    n = len(name)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for start, size, cost in pieces:
        ending[start + size].append((start, cost))
    best = [(0.0, 0)] + [(math.inf, 0)] * n  # cost, and where the last word starts
    run = (math.inf, 0)  # the best split whose last word is an unknown run
    letter = math.log(10)
    for end in range(1, n + 1):
        run = min((run[0] + letter, run[1]), (best[end - 1][0] + unknown + letter, end - 1))
        best[end] = min([run, *((best[s][0] + c, s) for s, c in ending[end])])
    words, end = [], n
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return Split(tuple(reversed(words)), best[n][0])


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for name, total, pieces in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            log_total = math.log(max(total or 1, 1))
            known = [(p["start"], p["size"], log_total - math.log(p["n"])) for p in pieces or []]
            out.append(list(viterbi(name, known, log_total).words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """names: name; counts: word, n. (name, words) of each distinct name."""
    names = names.distinct()
    size = F.length("name")
    lengths = counts.agg(F.collect_set(F.length("word")).alias("lengths"))  # one row: the band of lengths that words have
    starts = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("start")).crossJoin(F.broadcast(lengths))
    spans = starts.select("name", "start", F.explode(F.filter("lengths", lambda k: k <= size - F.col("start") + 1)).alias("size"))
    subs = spans.select("name", (F.col("start") - 1).alias("start"), "size", F.substr("name", F.col("start"), F.col("size")).alias("word"))
    pieces = subs.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("start", "size", "n")).alias("pieces"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return names.join(pieces, "name", "left").crossJoin(F.broadcast(total)).select("name", "total", "pieces").mapInArrow(_segment, "name string, words array<string>")


def judge_urls(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block) and the segmented words of the host."""
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html"))
    counts = written(base.select(F.explode(page_words(F.col("html"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    # hosts are few and hot, paths many: equal name lists are counted before anything is joined
    keyed = base.drop("html").withColumn("names", names_of(F.col("host"), F.col("path")))
    lists = written(keyed.groupBy("names").agg(F.count(F.lit(1)).alias("n")), "name_lists")
    split = written(segment_names(lists.select(F.explode("names").alias("name")), counts), "names")
    # multinomial: a name counts as often as it stands in the url
    counted = F.transform(F.array_distinct("names"), lambda x: F.struct(x.alias("name"), F.size(F.filter("names", lambda y: y == x)).alias("times")))
    each = lists.select(F.col("names").alias("key"), "n", F.explode_outer(counted).alias("c")).select("key", "n", "c.name", "c.times").join(split, "name", "left")
    seeded = each.groupBy("key").agg(F.max(F.coalesce(F.exists("words", lambda w: w.isin(*seeds)), F.lit(False))).alias("block"), F.first("n").alias("n"))
    seeded = written(seeded, "seeded")
    words = each.drop("n").join(seeded, "key").select((F.col("n") * F.col("times")).alias("n"), "block", F.explode("words").alias("word"))
    per_word = words.groupBy("word").agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))).alias("good"))
    per_word = written(per_word, "word_classes")
    totals = per_word.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.count(F.lit(1)).alias("vocabulary"))
    prior = seeded.agg(F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("pages_bad"), F.sum(F.when(F.col("block"), 0).otherwise(F.col("n"))).alias("pages_good"))
    v = F.col("vocabulary")
    odds = F.log((F.col("bad") + 1) / (F.col("all_bad") + v)) - F.log((F.col("good") + 1) / (F.col("all_good") + v))
    word_odds = per_word.crossJoin(F.broadcast(totals)).select("word", odds.alias("odds"))
    scored = each.select("key", "times", F.explode_outer("words").alias("word")).join(word_odds, "word", "left").groupBy("key").agg(F.sum(F.col("odds") * F.col("times")).alias("odds"), F.array_join(F.sort_array(F.collect_set("word")), " ").alias("words"))
    start = F.log((F.col("pages_bad") + 1) / (F.col("pages_good") + 1))
    scored = scored.crossJoin(F.broadcast(prior)).select("key", (F.coalesce("odds", F.lit(0.0)) + start).alias("score"), "words")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = keyed.withColumn("hit", rule).join(scored, F.col("names") == F.col("key"), "left")
    by_method = F.when((F.col("score") > 0) & (F.col("host") != ""), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", by_method).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("words", F.lit("")).alias("words"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
