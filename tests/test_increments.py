"""Sums that are kept up to date, and batches that write table and log exactly once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import checks, versions
from quillspark.streaming import increments

r = random.Random(2)
EVENTS = [(dt.datetime(2024, 1, r.randint(1, 9), r.randint(0, 23)), r.choice([r.randint(0, 40), 10**9 + r.randint(0, 3), None]), r.choice("ab"), r.randint(0, 500)) for _ in range(900)]


def plain(events, by):
    out = {}
    for ts, user, surface, cost in events:
        key = tuple({"day": ts.date(), "surface": surface}[c] if c in by else None for c in ("day", "surface"))
        n = out.setdefault(key, [0, 0, set()])
        n[0] += 1
        n[1] += cost
        n[2] |= {user} - {None}
    return {(*k, "+".join(by) or "all", n, c, len(u)) for k, (n, c, u) in out.items()}


@pytest.mark.parametrize("most", [2, 4, 100])
def test_increments_equal_one_pass(spark, tmp_path, most):
    kept = increments.UsageSums(spark, f"file://{tmp_path}/s", most=most)
    assert kept.sums().count() == 0
    for batch in range(7):
        part = spark.createDataFrame([(t, u, s, c) for t, u, s, c in EVENTS[batch::7]], "ts timestamp, user_id long, surface string, c long").withColumn("cost_usd", F.col("c").cast("decimal(14,6)"))
        kept.add(part, batch)
        kept.add(part, batch)
    got = {(x.day, x.surface, x.level, x.calls, int(x.cost_usd), x.users) for x in kept.sums().collect()}
    assert got == set().union(*(plain(EVENTS, by) for by in increments.SETS))
    assert len(kept.manifest()["parts"]) < most
    before = sorted(map(str, kept.sums().collect()))
    kept.swept()
    assert sorted(map(str, kept.sums().collect())) == before


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    kept = increments.UsageSums(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(t, u, s) for t, u, s, _ in EVENTS], "ts timestamp, user_id long, surface string").withColumn("cost_usd", F.lit(1).cast("decimal(14,6)"))
    kept.add(rows.filter("surface = 'a'"), 0)
    kept.add(rows.filter("surface = 'b'"), 1)
    before = sorted(map(str, kept.sums().collect()))
    with monkeypatch.context() as m:
        m.setattr(kept, "publish", lambda _: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            kept.merge()
    assert sorted(map(str, kept.sums().collect())) == before and len(kept.swept()) == 1
    kept.merge()
    assert sorted(map(str, kept.sums().collect())) == before and len(kept.manifest()["parts"]) == 1


def test_checks_write_both_tables_once(spark, tmp_path, monkeypatch):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, "running", at(1)), (2, "running", at(9)), (3, "unknown", None), (4, "running", at(1))], "id long, status string, last_checked_at timestamp_ntz")
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t", buckets=3, log_schema=checks.LOG)
    table.create(rows)
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (99,)], "id long")
    answers = spark.createDataFrame([(1, "not_running"), (3, "odd"), (2, "not_running")], "id long, status string")
    now = F.lit("2024-01-10").cast("timestamp")
    with monkeypatch.context() as m:  # dies before the switch: neither the rows nor the log change
        m.setattr(table, "publish", lambda _: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            checks.checked(table, asked, answers, now, ("w", 0))
    assert table.log().count() == 0 and sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
    for _ in range(2):
        checks.checked(table, asked, answers, now, ("w", 0))
    assert sorted((x.id, x.status, x.last_checked_at.day if x.last_checked_at else None) for x in table.read().collect()) == [(1, "not_running", 10), (2, "running", 9), (3, "unknown", 10), (4, "running", 1)]
    assert sorted((x.id, x.source, x.status) for x in table.log().collect()) == [(1, "check", "not_running"), (2, "cached", "running"), (3, "check", "unknown"), (99, "unknown", None)]
    checks.checked(table, asked.filter("id = 1"), answers, now, ("w", 1))
    assert sorted(x.source for x in table.log().filter("id = 1").collect()) == ["cached", "check"] and table.versions() == [1, 2, 3]
