"""What goes wrong only on larger tables: sums that outgrow their type, files that are small for their rows, joins and states that outgrow a task."""

import decimal
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import checks, profiles, runs, search, similarity, tracker, versions
from quillspark.plans import registry
from quillspark.sources import bindings, shared

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def dear(spark, tmp_path_factory):
    """The smallest tables with orders that together pass 10^12."""
    d = tmp_path_factory.mktemp("dear")
    for f in os.listdir(SF):
        if f != "orders.parquet":
            os.symlink(f"{SF}/{f}", d / f)
    spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_totalprice", F.col("o_totalprice") * 10_000).write.parquet(f"{d}/orders.parquet")
    return str(d)


def test_ledger_sums_pass_twelve_digits(spark, dear):
    want = spark.read.parquet(f"{dear}/orders.parquet").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).head()[0]
    assert want > 10**12
    row = registry.QUERIES["cost_totals_reconciled"](spark, dear).head()
    assert row.runs_usd == want and row.ledger_usd == want + row.checks_usd
    total = registry.QUERIES["cost_report"](spark, dear).filter("section = 'total'").head()
    assert total.detail.split("|")[-1] == str(row.ledger_usd) and total.cost_usd == row.attributed_usd


def test_run_sums_pass_twelve_digits(spark):
    r = spark.range(4).select(F.col("id"), F.lit("a").alias("agent"), F.lit("sweep").alias("mode"), F.lit(0).alias("errors"), F.lit(1).alias("items_processed"), F.lit("1998-06-15").cast("timestamp_ntz").alias("started_at"), F.lit("900000000000").cast("decimal(18,6)").alias("cost_usd"))
    want = decimal.Decimal(3_600_000_000_000)
    assert runs.agent_totals(r, spark.createDataFrame([("a", "A")], "agent string, label string")).head().cost_usd == want
    assert runs.kpi_periods(r, "1998-07-01", 30).head().cost_usd == want


def test_changes_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path, monkeypatch):
    rows = spark.range(200_000).select("id", F.lit("unknown").alias("status"), F.lit(None).cast("timestamp_ntz").alias("last_checked_at"))
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t", log_schema=checks.LOG)
    table.create(rows)
    staged = []
    was = versions.VersionedTable.stage
    monkeypatch.setattr(versions.VersionedTable, "stage", lambda self, out: staged.append(out._jdf.queryExecution().sparkPlan().toString()) or was(self, out))
    checks.checked(table, rows.select("id"), rows.select("id", F.lit("running").alias("status")), F.lit("1998-07-01"))
    assert len(staged) == 1 and "Broadcast" not in staged[0]
    assert table.read().groupBy("status").count().collect() == [("running", 200_000)] and table.log().count() == 200_000


def test_many_profiles_meet_classes_of_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{a}{b}" for a in "abcdef" for b in "xyz"]
    rows = [(i, rng.choice("AB") if i % 50 else "C", rng.choice((None, 3, 6, 9)), rng.choice((None, 8, 12)), " ".join(rng.sample(words, 2)), rng.sample(words, 1)) for i in range(3000)]
    people = [(i, " ".join(rng.sample(words, rng.randint(0, 6))), rng.sample(words, rng.randint(0, 2)), rng.choice((None, 5, 11, 40))) for i in range(200)]
    kinds = {"a": (["A"], False), "few": (["C"], True), "none": (["X"], True)}
    catalog = spark.createDataFrame(rows, "id long, type string, grade_min int, grade_max int, name string, tags array<string>")
    sizes, was = {}, profiles.materialised
    monkeypatch.setattr(profiles, "materialised", lambda df, name: (lambda out: (sizes.__setitem__(name, out.count()), out)[1])(was(df, name)))
    got = {}
    for r in profiles.many_profiles(spark.createDataFrame(people, "profile long, about string, hints array<string>, grade int"), catalog, F.col("name"), F.col("tags"), kinds, 100).collect():
        got.setdefault((r.profile, r.kind), []).append((r.place, r.id, r.score))
    for p, about, hints, grade in people:
        grade = grade if grade in range(14) else None
        for kind, (types, _) in kinds.items():
            pool = [r for r in rows if kind == "none" or r[1] in types]
            pool = [r for r in pool if grade is None or (r[2] is None or r[2] <= grade) and (r[3] is None or r[3] >= grade)]
            scored = [(sum(w in r[4] for w in set(about.split())) + 3 * bool(set(hints) & set(r[5])), r[0]) for r in pool]
            positive = [s for s in scored if s[0] > 0]
            want = sorted(positive if len(positive) >= 60 else scored, key=lambda s: (-s[0], s[1]))[:100]
            assert sorted(got.get((p, kind), [])) == [(n + 1, i, s) for n, (s, i) in enumerate(want)]
    assert sizes["profile_scores"] <= 200 * 3 * 100


def test_tasks_grow_with_the_rows(spark):
    few, many = (shared.dealt(spark.range(10), n, "id").rdd.getNumPartitions() for n in (10, 10_000_000))
    assert few == 1 and many == 10_000_000 // shared.TASK_ROWS
    items = bindings.tracker_items(spark, SF)
    assert "REPARTITION_BY_NUM" in items._jdf.queryExecution().executedPlan().toString()


def test_tags_meet_answers_once(spark):
    tags = [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "c"), (2, 1, None), (3, 0, "d"), (4, 0, "a"), (4, 1, "b"), (None, 0, "a")]
    answers = [(1, 1, "a", "second"), (1, 0, "no such", "by place"), (1, 2, "b", "echoed"), (2, 0, None, "no echo"), (2, 1, "c", "late"), (2, None, "c", "nowhere"), (4, 1, "a", None), (4, 0, "b", "x"), (9, 0, "a", "no entry"), (None, 0, "a", "none")]
    out = search.enriched_tags(spark.createDataFrame(tags, "id long, place int, tag string"), spark.createDataFrame(answers, "id long, place int, echo string, intent string"))
    assert {(r.id, r.place): (r.tag, r.intent) for r in out.collect()} == {
        (1, 0): ("a", "by place"), (1, 1): ("b", "echoed"), (1, 2): ("a", "by place"), (2, 0): ("c", "no echo"), (2, 1): (None, None),
        (3, 0): ("d", None), (4, 0): ("a", None), (4, 1): ("b", "x"), (None, 0): ("a", None),
    }
    assert "Join" not in plan(out)


def test_months_need_no_distinct(spark):
    items = spark.sql("SELECT 1L AS id, array(named_struct('date', DATE '2024-01-05', 'label', 'x'), named_struct('date', DATE '2024-02-01', 'label', 'x'), named_struct('date', DATE '2024-01-31', 'label', 'x')) AS dates UNION ALL SELECT 2L, array(named_struct('date', DATE '2024-01-01', 'label', 'x'), named_struct('date', CAST(NULL AS DATE), 'label', 'x'))")
    out = tracker.months(items)
    assert sorted(map(tuple, out.collect()), key=str) == [("2024-01", 3, 2), ("2024-02", 1, 1), (None, 1, 1)]
    assert "distinct" not in plan(out)


def most_rows(spark, since):
    """The most rows that one step of any plan gave out since so many executions."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    done = store.executionsList(since, 10_000)
    for i in range(done.size()):
        key = done.apply(i).executionId()
        values, nodes = store.executionMetrics(key), store.planGraph(key).allNodes()
        for metrics in (nodes.apply(j).metrics() for j in range(nodes.size())):
            for m in (metrics.apply(j) for j in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_rows_of_like_names_do_not_meet_every_page(spark, monkeypatch):
    """60 names that are all alike on 30 pages of one site: each name's first rows are chosen once, not anew for each page that asks."""
    data = [(60 * p + n, f"https://www.site{p}.example.org/page", f"summer robotics camp for girls {n:02}", 60 * p + n) for p in range(30) for n in range(60)]
    rows = spark.createDataFrame(data, "id long, url string, name string, pos long").coalesce(1)
    new = rows.select("id", "url", F.lit("").alias("apply_url"), "name")
    tasks, was = {}, similarity.materialised
    monkeypatch.setattr(similarity, "materialised", lambda df, name: tasks.__setitem__(name, df.rdd.getNumPartitions()) or was(df, name))
    monkeypatch.setattr(shared, "SMALL_ROWS", 600)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.id: (r.exact, list(r.candidates)) for r in similarity.duplicate_candidates(new, rows, same=True).collect()}
    # on its own page a row's first like name is the page's first row, or the second for that row
    assert got == {i: (60 * (i // 60) + (i % 60 == 0), []) for i in range(1800)}
    assert 0 < most_rows(spark, since) < 600_000
    assert tasks["submissions"] == tasks["catalog"] == 3
