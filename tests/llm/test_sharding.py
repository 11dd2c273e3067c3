"""Rendezvous sharding against a plain walk over all shards, on hard rows."""

import hashlib
import math
import zlib

from quillspark.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot string, lang string, _range long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "t", "en", 1) for i, t in rows], SCHEMA)


def walk(doc_id, text, weights):
    key = str(doc_id) if doc_id is not None else "text:" + hashlib.sha256((text or "").encode()).hexdigest()
    draws = []
    for s, w in enumerate(weights):
        u = int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16)
        draws.append(w / -math.log((u + 0.5) / 16**13))
    return draws.index(max(draws))


ROWS = [(i, f"text {i} É") for i in range(3000)] + [(7, "other"), (7, "text 7 É"), (None, "a"), (None, None), (None, "b"), (5000, None), (5001, ""), (5002, "x" * 200_000)] + [(9000, "copy")] * 1500


def test_every_row_stands_in_the_shard_that_wins(spark):
    weights = [1.0, 2.0, 0.0, 0.5, 1.5]
    got = sharding.sharded(table(spark, ROWS), weights).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    want = sorted((str(i), len((t or "").encode()) + 1, crc(t), walk(i, t, weights), walk(i, t, [*weights, 1.0])) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 5) for r in got)
    for s in range(5):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in own]
        assert order == sorted(order)
    assert not any(r.shard == 2 for r in got)


def test_shares_follow_weights_and_few_rows_move(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    heavy = {r.shard: r["count"] for r in sharding.with_shards(docs, [1.0, 3.0, 4.0]).groupBy("shard").count().collect()}
    assert all(abs(heavy[s] - 20_000 * w / 8) < 400 for s, w in enumerate([1, 3, 4]))
    before = sharding.with_shards(docs, [1.0] * 8)
    moved = before.filter("grown_shard <> shard")
    assert {r.grown_shard for r in moved.select("grown_shard").distinct().collect()} == {8} and abs(moved.count() - 20_000 / 9) < 250
    # more weight for one shard: rows move only into it
    more = sharding.with_shards(docs, [1.0] * 7 + [2.0]).selectExpr("doc_id", "shard AS after")
    changed = before.join(more, "doc_id").filter("shard <> after")
    assert changed.filter("after <> 7").count() == 0 and changed.count() > 0


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = table(spark, ROWS)
    back = sharding.write_shards(docs, f"file://{tmp_path}/out", [1.0, 1.0, 2.0], files=2)
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    assert sorted((str(r.doc_id), r.text or "", r.lang, r.shard) for r in back.collect()) == sorted((str(i), t or "", "en", walk(i, t, [1, 1, 2])) for i, t in ROWS)


def test_an_empty_table_and_bad_weights(spark):
    import pytest

    assert sharding.sharded(table(spark, ROWS[:1]).limit(0)).count() == 0
    for weights in ([], [0.0, 0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.rendezvous(sharding.F.lit("k"), weights)


def test_no_python_in_the_plan(spark):
    plan = sharding.sharded(table(spark, ROWS[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
