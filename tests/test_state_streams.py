"""Streams with state against the batch operators, in pieces, out of order, and after a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import caches
from quillspark.streaming import state

r = random.Random(3)
DAY = dt.datetime(2024, 1, 1)
EVENTS = [(r.choice("abcde"), DAY + dt.timedelta(minutes=r.randrange(40 * 24 * 60) if r.random() < 0.9 else 777), i, r.choice(["mint", "take", "take", "take"])) for i in range(600)]
EVENTS += [("hot", DAY + dt.timedelta(hours=i), 1000 + i, "take" if i % 50 else "mint") for i in range(500)] + [("tie", DAY, 2000 + i, "take") for i in range(5)] + [("tie", DAY, 2010, "mint")]
SCHEMA = "key string, ts timestamp, id long, kind string"


def pieces(spark, folder):
    """Three writes; an event in seven comes a piece late, by less than the watermark waits. Yields after each write."""
    cut = lambda ts: min(2, (ts - DAY).days // 14)
    parts = [[], [], []]
    for e in EVENTS:
        n = cut(e[1])
        parts[min(2, n + (e[2] % 7 == 0))].append(e)
    for n, rows in enumerate(parts):
        r.shuffle(rows)
        end = [(state.END_KEY, state.END, -1, "take")] if n == 2 else []
        spark.createDataFrame(rows + end, SCHEMA).repartition(2).write.mode("append").parquet(folder)
        yield n


def run(spark, tmp_path, make):
    own = state.state_session(spark)
    folder, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for _ in pieces(spark, folder):
        # every piece is a run of its own: the second and third go on from the checkpoint
        state.write_batches(make(own.readStream.schema(SCHEMA).parquet(folder)), target, f"file://{tmp_path}/state").awaitTermination()
    return state.read_batches(spark, target, state.VERDICTS)


@pytest.mark.parametrize("days", [1, 7])
def test_cache_stream_equals_batch(spark, tmp_path, days):
    got = run(spark, tmp_path, lambda s: state.read_through_stream(s.drop("kind"), days, "16 days"))
    rows = spark.createDataFrame(EVENTS, SCHEMA)
    want = {(x.id, x.source) for x in caches.read_through(rows.select("key", "ts", "id"), days).collect()}
    found = [(x.id, x.verdict) for x in got.collect()]
    assert len(found) == len(EVENTS) and set(found) == want and got.select("batch").distinct().count() > 1


def test_token_stream_equals_batch(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: state.tokens_stream(s, 36 * 60, "16 days"))
    rows = spark.createDataFrame(EVENTS, SCHEMA).withColumnRenamed("key", "token")
    want = {(x.id, x.verdict) for x in caches.tokens_taken(rows, 36 * 60).collect()}
    found = [(x.id, x.verdict) for x in got.filter("key <> ''").collect()]
    assert len(found) == len(want) and set(found) == want and {v for _, v in want} == {"ok", "used", "expired", "unknown"}


def test_log_ring_keeps_the_newest_and_counts_the_rest(spark, tmp_path):
    own = state.state_session(spark)
    folder, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    lines = [(a, i, f"{a} {i}") for i in range(900) for a in ("x", "y") if a == "x" or i % 100 == 0]
    for n in range(3):
        part = [e for e in lines if n * 300 <= e[1] < n * 300 + 300]
        spark.createDataFrame(part, "agent string, line_no long, line string").repartition(3).write.mode("append").parquet(folder)
        stream = own.readStream.schema("agent string, line_no long, line string").parquet(folder)
        state.write_batches(state.tail_stream(stream, 250), target, f"file://{tmp_path}/state", "update").awaitTermination()
    tails = state.newest_tails(state.read_batches(spark, target, "agent string, total long, dropped long, numbers array<long>, lines array<string>"))
    got = {x.agent: x for x in tails.collect()}
    assert (got["x"].total, got["x"].dropped, got["x"].numbers) == (900, 650, list(range(650, 900))) and (got["y"].total, got["y"].dropped, len(got["y"].lines)) == (9, 0, 9)
    asked = spark.createDataFrame([("x", 0), ("x", 700), ("x", 899), ("x", 5000), ("y", 4), ("none", 3)], "agent string, since long")
    got = sorted((x.agent, len(x.lines), x.lines[:1], x.next, x.dropped) for x in state.log_since(tails, asked).collect())
    assert got == [("none", 0, [], 0, 0), ("x", 0, [], 900, 650), ("x", 1, ["x 899"], 900, 650), ("x", 200, ["x 700"], 900, 650), ("x", 250, ["x 650"], 900, 650), ("y", 5, ["y 400"], 9, 0)]


class Rows:
    """A state of one key, which counts the rows that go to and fro."""

    def __init__(self):
        self.rows, self.moved = [], 0

    def appendValue(self, row):
        self.appendList([row])

    def appendList(self, rows):
        self.rows += rows
        self.moved += len(rows)

    def put(self, rows):
        self.rows, self.moved = list(rows), self.moved + len(rows)

    def get(self):
        self.moved += len(self.rows)
        return iter(self.rows)

    def clear(self):
        self.rows = []


class One:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = tuple(value)

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.rows, self.one, self.timers = Rows(), One(), []

    def getListState(self, *_):
        return self.rows

    def getValueState(self, *_):
        return self.one

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_key_s_events_are_a_few_rows_of_state(monkeypatch):
    import pandas as pd

    n, day = 30_000, 86_400_000_000
    at = list(range(0, n * 60_000_000, 60_000_000))
    random.Random(4).shuffle(at)
    own, h = state.ReadThrough(7), Handle()
    own.init(h)
    for k in range(0, n, 10_000):
        part = pd.DataFrame({"micros": at[k : k + 10_000], "id": at[k : k + 10_000], "kind": "take"})
        assert not list(own.handleInputRows(("k",), iter([part]), h))
    found = []
    for h.watermark in (5 * day // 1000, 9 * day // 1000, 100 * day // 1000):
        for out in own.handleExpiredTimer(("k",), h, None):
            found += zip(out["id"].tolist(), out["verdict"].tolist(), strict=True)
    assert found == [(x, "cached" if x % (7 * day) else "fetch") for x in sorted(at)] and not h.rows.rows
    assert h.rows.moved < 100  # not several times 30,000
