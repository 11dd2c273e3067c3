"""Snapshots as files, late data, caches and edits on small hand-worked cases."""

import datetime as dt
import json

from pyspark.sql import functions as F

from quillspark.functions import extract, nested
from quillspark.operators import caches, curation, editing, search, seeds
from quillspark.operators import snapshots as s
from quillspark.sources import snapshots as src
from quillspark.streaming import rollup


def test_snapshot_files_are_found_by_name(spark, tmp_path):
    good = [{"id": "a", "review_status": "verified", "previous_review_status": None, "extra": 1}, {"id": "b", "review_status": "x", "previous_review_status": "x"}, "odd", None]
    files = {
        "review_check_dry_run_20260818.json": json.dumps(good, indent=1),
        "scrape_review_seattle_20260818-101500.json": "[]",
        "deadline_check_dry_run_20260101.json": '[{"id": "x", "changed": tru',
        "metadata.json": "[]",
        "scrape_review_national_99999999.json": '[{"url": "https://A.org/"}, {"url": "https://a.org"}, {"url": ""}, {"name": "n"}]',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = src.snapshot_files(spark, str(tmp_path))
    got = {r.file: r for r in s.listing(found, "2026-08-25 00:00:00").collect()}
    assert set(got) == set(files) - {"metadata.json"}
    r = got["review_check_dry_run_20260818.json"]
    assert (r.entries, r.pending, r.age_days, r.stale, r.has_time, r.mode, r.error) == (4, 1, 7, True, False, None, None)
    r = got["scrape_review_seattle_20260818-101500.json"]
    assert (r.entries, r.pending, r.age_days, r.stale, r.has_time, r.mode) == (0, 0, 6, False, True, "seattle")
    assert got["deadline_check_dry_run_20260101.json"].error == "unreadable"
    assert got["scrape_review_national_99999999.json"].ran_at.year >= 2024  # no date: when the file was written
    none = spark.createDataFrame([], "url string")
    plan = s.plan(src.entries(found), none)
    counts = {r.file: (r.entries, r.applied, r.skipped_no_change, r.skipped_duplicate) for r in s.commit_counts(plan).collect()}
    assert counts == {"review_check_dry_run_20260818.json": (4, 1, 3, 0), "scrape_review_national_99999999.json": (4, 1, 2, 1)}
    again = s.commit_counts(s.plan(src.entries(found), s.inserts(plan))).filter("agent = 'scraper'").first()
    assert (again.applied, again.skipped_duplicate) == (0, 2)  # committing twice inserts nothing
    assert [r.items_added for r in s.audit_rows(s.commit_counts(plan), "2026-08-25").orderBy("agent").collect()] == [0, 1]


def test_a_file_name_with_a_folder_is_no_snapshot(spark):
    names = spark.createDataFrame([("../review_check_dry_run_1.json",), ("review_check_dry_run_1.json",), ("reviewXcheck_dry_run_1.json",)], "file string")
    assert [r[0] for r in names.select(src.agent_of(F.col("file"))).collect()] == [None, "reviews", None]


def test_late_events_change_their_day_and_too_late_ones_do_not(spark, tmp_path):
    schema = "ts timestamp, userid string, surface string, cost_usd decimal(14,6)"
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    folder = str(tmp_path / "in")
    # a watermark moves after a batch: the third file's row for day 1 is too late, the second's is not
    batches = [[(at(1, 5), "u", "a", 1), (at(2, 1), "u", "a", 1)], [(at(1, 9), "u", "a", 1), (at(9, 1), "u", "a", 1)], [(at(9, 2), "u", "a", 1)], [(at(1, 10), "u", "a", 1), (at(9, 3), "u", "a", 1)]]
    for rows in batches:
        spark.createDataFrame([(t, u, x, __import__("decimal").Decimal(c)) for t, u, x, c in rows], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        rollup.write_daily(stream, str(tmp_path / "sums"), str(tmp_path / "state")).awaitTermination()
    got = {r.day.day: r.calls for r in rollup.read_daily(spark, str(tmp_path / "sums")).collect()}
    assert got == {1: 2, 2: 1, 9: 3}


def test_sessions_end_after_a_gap(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "u") for m in (0, 10, 35, 50)] + [(dt.datetime(2024, 1, 1, 2), "u")], "ts timestamp, userid string")
    assert sorted(r.calls for r in rollup.sessions(rows).collect()) == [1, 4]


def test_reads_through_a_cache(spark):
    days = [0, 1, 6, 7, 8, 13, 15, 40]
    rows = spark.createDataFrame([(i, "k", dt.datetime(2024, 1, 1) + dt.timedelta(days=x)) for i, x in enumerate(days)] + [(90, "other", dt.datetime(2024, 1, 3)), (89, "other", dt.datetime(2024, 1, 3))], "id long, key string, ts timestamp_ntz")
    got = {r.id: r.source for r in caches.read_through(rows).collect()}
    assert [i for i in sorted(got) if got[i] == "fetch"] == [0, 3, 6, 7, 89]


def test_tokens_serve_once(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("a", t(0), 1, "mint"), ("a", t(3), 2, "take"), ("a", t(4), 3, "take"), ("b", t(0), 4, "mint"), ("b", t(6), 5, "take"), ("c", t(1), 6, "take")], "token string, ts timestamp_ntz, id int, kind string")
    assert {r.id: r.verdict for r in caches.tokens_taken(rows).collect()} == {2: "ok", 3: "used", 5: "expired", 6: "unknown"}


def test_upserts_replace_and_appends_do_not_repeat(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, org string")
    new = spark.createDataFrame([(2, "c", None, 1), (2, "d", None, 2), (3, "e", "z", 1)], "id int, name string, org string, pos int")
    assert sorted(map(tuple, curation.replaced(rows, new, ["id"]).collect())) == [(1, "a", "x"), (2, "d", None), (3, "e", "z")]
    once = curation.appended(rows, new.drop("pos"), ["id"])
    assert once.count() == 3 and curation.appended(once, new.drop("pos"), ["id"]).count() == 3


def test_edits_of_live_rows_are_refused(spark):
    rows = spark.createDataFrame([(1, "n", "https://x", "Program", False), (2, "n", "https://x", "Program", True)], "id int, name string, url string, type string, is_active boolean")
    edits = spark.createDataFrame([(1, {"name": " new ", "type": ""}), (2, {"name": "z"}), (3, {"name": "z"}), (1, {"zeta": "1", "alpha": "2"})], "id int, fields map<string,string>")
    got = [(r.id, r.error) for r in editing.edit_verdicts(edits, rows).collect()]
    assert sorted(got, key=str) == sorted([(1, None), (1, "not_editable:alpha,zeta"), (2, "live_row"), (3, "no_row")], key=str)
    out = editing.edited(rows, editing.edit_verdicts(edits.limit(1), rows)).orderBy("id").collect()
    assert (out[0].name, out[0].type, out[1].name) == ("new", None, "n")


def test_seed_choice_keeps_order_and_repeats(spark):
    rows = spark.createDataFrame([(5, "national", 1), (6, "national", 0)], "id long, mode string, sort_order int")
    assert [(r.id, r.found) for r in seeds.chosen_by_id(rows, [6, 9, 6]).collect()] == [(6, True), (9, None), (6, True)]
    assert [r.id for r in seeds.chosen_by_place(rows, [1, 0, 7]).collect()] == [5, 6]


def test_every_tag_stays_with_its_first_answer(spark):
    tags = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "id int, place int, tag string")
    answers = spark.createDataFrame([(1, 0, "b", "first"), (1, 1, None, "second"), (1, 2, "zz", "third")], "id int, place int, echo string, intent string")
    assert {r.tag: r.intent for r in search.enriched_tags(tags, answers).collect()} == {"a": None, "b": "first", "c": "third"}


def test_lists_and_actions(spark):
    r = spark.range(1).select(
        nested.clean_tags(F.array(F.lit(" a "), F.lit(None).cast("string"), F.lit(" "))).alias("tags"),
        nested.clean_tags(F.array(F.lit(" "))).alias("none"),
        nested.with_generic_actions(F.lit("k"), F.lit(None).cast(f"array<{nested.ACTION}>")).alias("generic"),
        nested.rotated(("a", "b", "c", "d"), F.lit(1)).alias("second"),
        extract.sections(F.lit("x\n\nPASSION PROJECT: y\n\n\nresearch projects: z")).alias("s"),
    ).first()
    assert r.tags == ["a"] and r.none is None and [a.id for a in r.generic] == ["k-gt0", "k-gt1", "k-gt2"] and r.second == ["d", "a", "b"]
    assert (r.s.passion, r.s.research, r.s.general) == (["y"], ["z"], ["x"])
