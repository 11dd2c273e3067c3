"""Importance resampling against a plain count over all texts, on hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, resampling

SCHEMA = "doc_id long, text string, scope string, gain string, rank string, id long, word string"
r = random.Random(9)
VOCABULARY = ["".join(r.choice("abcdeÉß日") for _ in range(r.randint(1, 6))) for _ in range(150)]


def prose(n):
    return r.choice([" ", ", ", "\n", "--"]).join(r.choice(VOCABULARY).title() if r.random() < 0.2 else r.choice(VOCABULARY) for _ in range(n))


ROWS = [(i, prose(r.choice([0, 3, 19, 20, 21, 80]))) for i in range(300)]
ROWS += [(None, prose(40)), (None, None), (400, None), (401, ""), (402, "!! ?"), (403, "long word " * 5000), (404, "x" * 3000 + " y"), (405, "A a A 1_2")]
ROWS += [(7, prose(25)), (7, ROWS[7][1]), (406, "same text " * 15), (406, "same text " * 15)] + [(500 + i, "copy of one text that many rows hold " * 4) for i in range(150)]
TARGET = [prose(30) for _ in range(20)] + [None, "", "only here in target"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "c", "g", "r", 1, "w") for i, t in rows], SCHEMA)


def words(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)


def features(text, least, most):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(least, most + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, least=1, most=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x, least, most)))
    for x in target:
        t.update(map(bucket, features(x, least, most)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, x in rows:
        f = features(x, least, most)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        out.append((i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def with_ranks(rows, percent=10):
    enough = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[3]))
    n = percent * len(enough) // 100
    left = Counter(enough[:n])
    rank = {}
    for place, x in enumerate(enough[:n], 1):
        rank.setdefault(x, []).append(place)
    out = []
    for x in rows:
        out.append((x[0], x[2], x[3], x[4], rank[x].pop(0) if left[x] and rank.get(x) else None))
    return out


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 700)
    monkeypatch.setattr(resampling, "SCOPE_WORDS", 100)


def test_scores_and_ranks(spark, small_chunks):
    got = resampling.ranked(resampling.weights(table(spark, ROWS), spark.createDataFrame([(t,) for t in TARGET], "text string")))
    got = sorted((tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    want = sorted(with_ranks(plain(ROWS, TARGET)), key=str)
    assert got == want and sum(x[4] is not None for x in got) > 15


@pytest.mark.parametrize("least, most, buckets", [(1, 3, 500), (2, 2, 10_000)])
def test_longer_runs(spark, least, most, buckets, small_chunks):
    rows = ROWS[:80] + ROWS[300:312]
    got = resampling.weights(table(spark, rows), spark.createDataFrame([(t,) for t in TARGET], "text string"), least, most, buckets)
    want = sorted(((i, n, f, w) for i, n, f, w, _ in plain(rows, TARGET, least, most, buckets)), key=str)
    assert sorted((tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight").collect()), key=str) == want


def test_the_dictionary_has_each_word_once_and_tuples_stand_for_their_words(spark, small_chunks):
    own = resampling.coded(table(spark, ROWS), 1, 2, "t")
    known = resampling.dictionary(own)
    rows = known.collect()
    assert len({x.id for x in rows}) == len(rows) == len({x.word for x in rows}) and {x.word for x in rows} == {w for _, t in ROWS for w in words(t)}
    word = {x.id: x.word for x in rows}
    got = Counter()
    for x in resampling.id_tuples(own, known, 2).collect():
        got[" ".join(word[i] for i in x.gram)] += x.n
    assert got == Counter(f for _, t in ROWS for f in features(t, 1, 2))
    assert own.filter("words is not null").count() > 4 and own.filter("words is null").count() > own.filter("words is not null").count()


def test_drawn_rows_come_whole(spark):
    docs, target = table(spark, ROWS), spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resampled(docs, target, 50)
    drawn = {x[0] for x in with_ranks(plain(ROWS, TARGET), 50) if x[4] is not None}
    assert got.columns == docs.columns and {x.doc_id for x in got.collect()} == drawn


def test_empty_tables(spark):
    docs, target = table(spark, ROWS[:30]), spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert resampling.ranked(resampling.weights(docs.limit(0), target)).count() == 0
    got = resampling.weights(docs, target.limit(0)).select("doc_id", "n_words", "n_features", "weight").collect()
    assert sorted(map(tuple, got)) == sorted(x[:4] for x in plain(ROWS[:30], []))


def test_no_row_grows_with_what_a_task_reads(spark):
    """Rows that hold a whole chunk's or scope's lists fill an executor, as Spark's reader decodes thousands of rows at once."""
    rows = [(i, " ".join(f"w{(i * 61 + j) % 4000}" for j in range(2500))) for i in range(60)] + [(99, None)]
    docs = table(spark, rows).coalesce(1)
    for most in (1, 2):
        own = resampling.coded(docs, 1, most, "t")
        largest = own.agg(*(F.max(F.size(c)).alias(c) for c, kind in own.dtypes if kind.startswith("array"))).first()
        assert max(x or 0 for x in largest) <= 1024
    got = resampling.weights(docs, spark.createDataFrame([(t,) for t in TARGET], "text string")).select("doc_id", "n_words", "n_features", "weight").collect()
    assert sorted(map(tuple, got)) == sorted(x[:4] for x in plain(rows, TARGET))


@pytest.mark.parametrize("least, most", [(1, 1), (1, 3)])
def test_texts_in_many_pieces(spark, least, most, small_chunks, monkeypatch):
    """Pieces of three values and batches of five rows: texts, scopes and batches end at places of their own."""
    monkeypatch.setattr(resampling, "PIECE", 3, raising=False)
    monkeypatch.setattr(resampling, "HELD", 17, raising=False)
    monkeypatch.setitem(common._WRITING, "spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    rows = ROWS[:60] + ROWS[300:310]
    got = resampling.weights(table(spark, rows), spark.createDataFrame([(t,) for t in TARGET], "text string"), least, most)
    want = sorted((x[:4] for x in plain(rows, TARGET, least, most)), key=str)
    assert sorted((tuple(x) for x in got.select("doc_id", "n_words", "n_features", "weight").collect()), key=str) == want
