"""JSON arrays that many tasks read, and commits that are all or nothing."""

import json
import random

import pytest

from pyspark.sql import functions as F

from quillspark.operators import versions
from quillspark.sources import json_arrays
from quillspark.sources import snapshots as src

r = random.Random(4)
STRINGS = ["", "plain", 'a "quoted" one', "back\\slash", "ends with \\", "} , { ] [", '\\"}', "É日本😀", "tab\tand\nline", "x" * 300, '"}","{"', "\\\\"]


def value(depth=0):
    k = r.random()
    if depth > 3 or k < 0.45:
        return r.choice([*STRINGS, 1, -2.5, True, None])
    if k < 0.75:
        return {r.choice(STRINGS) + str(i): value(depth + 1) for i in range(r.randint(0, 4))}
    return [value(depth + 1) for _ in range(r.randint(0, 3))]


@pytest.fixture
def short_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_elements_of_files_that_many_tasks_read(spark, tmp_path, short_ranges):
    want = {}
    for i in range(5):
        items = [value() if r.random() < 0.3 else {"id": k, "v": value(1)} for k in range(r.randint(1, 30))]
        text = json.dumps(items, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        (tmp_path / f"f{i}.json").write_text(r.choice(["", " \n"]) + text + r.choice(["", "\n", "  "]), encoding="utf-8")
        want[f"f{i}.json"] = items
    (tmp_path / "one.json").write_text(json.dumps([{"long": "y" * 2000, "z": ["}"] * 300}]))
    want["one.json"] = [{"long": "y" * 2000, "z": ["}"] * 300}]
    files, elements = json_arrays.read_elements(spark, str(tmp_path))
    assert all(x.readable and x.is_list and x.n == len(want[x.path.rsplit("/")[-1]]) for x in files.collect())
    got = {}
    for x in elements.collect():
        got.setdefault(x.path.rsplit("/")[-1], {})[x.position] = json.loads(x.text)
    assert {f: [v[i] for i in range(len(v))] for f, v in got.items()} == want
    # one file's ranges were really several tasks' work
    assert json_arrays._fragments(spark, str(tmp_path / "one.json"), "*.json").select("block").distinct().count() > 1


@pytest.mark.parametrize("short", [False, True])
def test_broken_files_are_listed(spark, tmp_path, short, request):
    if short:
        request.getfixturevalue("short_ranges")
    texts = {
        "cut": '[{"a": 1}, {"b": "x', "cut_after": '[{"a": 1}', "open_string": '[{"a": "}]', "trailing": "[1, 2,]", "twice": "[1] [2]", "garbage": "[1] x", "bad_element": "[1, {a: 2}]", "too_many": "[1]]", "blank": "", "spaces": " \n",
        "not_a_list": '{"not": "a list"}', "number": "12", "bad_value": "{nope", "empty": "[]", "empty_spaced": " [ \n ] ", "good": '[{"a": "]"}, []]', "mixed": '[{"a": 1]}', "leading": "[,1]", "ends_in_brace": '[1, {"a": {"b": {}}}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    files, elements = json_arrays.read_elements(spark, str(tmp_path))

    def readable(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    got = {x.path.rsplit("/")[-1][:-5]: (x.readable, x.n) for x in files.collect()}
    assert got == {n: (readable(t), len(json.loads(t)) if readable(t) and isinstance(json.loads(t), list) else 0) for n, t in texts.items()}
    assert {x.path.rsplit("/")[-1][:-5] for x in elements.collect()} == {"good"}


def catalog(spark, root):
    rows = spark.createDataFrame([(f"r{i}", f"https://r{i}.org", "old", True, None, None) for i in range(40)], "id string, url string, name string, is_active boolean, review_status string, updated_at timestamp_ntz")
    table = versions.VersionedTable(spark, f"file://{root}/t", buckets=8)
    table.create(rows)
    return table


def changes(spark, table, *rows):
    """rows: (id, op, name) or (id, "patch", {column: text})."""
    kind = table.read().schema.simpleString()
    made = []
    for i, op, x in rows:
        row = None if op in ("patch", "delete") else (i, f"https://{i}.org", x, False, None, None)
        made.append((i, op, row, x if op == "patch" else None))
    return spark.createDataFrame(made, f"id string, op string, row {kind}, columns map<string,string>")


def test_changes_touch_only_their_buckets_and_old_versions_stay(spark, tmp_path):
    table = catalog(spark, tmp_path)
    before = {x.id: x for x in table.read().collect()}
    v = table.changed(changes(spark, table, ("r1", "patch", {"name": "new", "updated_at": "2024-01-01 00:00:00"}), ("r2", "delete", None), ("r3", "upsert", "whole"), ("n1", "insert", "added"), ("r4", "insert", "refused"), ("gone", "patch", {"name": "x"}), ("gone2", "delete", None)))
    after = {x.id: x for x in table.read().collect()}
    assert v == 2 and len(after) == 40 and "r2" not in after and "gone" not in after and "gone2" not in after
    assert (after["r1"].name, after["r1"].url, str(after["r1"].updated_at)) == ("new", "https://r1.org", "2024-01-01 00:00:00")
    assert (after["r3"].name, after["r3"].is_active) == ("whole", False) and after["n1"].name == "added" and after["r4"].name == "old"
    assert {x.id: x for x in table.read(1).collect()} == before
    one, two = table.manifest(1)["stages"], table.manifest(2)["stages"]
    touched = table.changed(changes(spark, table, ("r5", "patch", {"name": None})))
    three = table.manifest(touched)["stages"]
    assert sum(two[b] != three[b] for b in two) == 1 and one != two and table.read().filter("id = 'r5'").first().name is None


def test_a_writer_that_dies_before_the_switch_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = catalog(spark, tmp_path)
    before = sorted(map(tuple, table.read().collect()))

    def die(manifest):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(table, "publish", die)
        with pytest.raises(RuntimeError):
            table.changed(changes(spark, table, ("r1", "patch", {"name": "new"}), ("n1", "insert", "x")))
    assert sorted(map(tuple, table.read().collect())) == before and table.versions() == [1]
    assert len(table.swept()) == 1 and table.swept() == []
    assert table.changed(changes(spark, table, ("r1", "patch", {"name": "new"}))) == 2 and table.read().filter("name = 'new'").count() == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    table = catalog(spark, tmp_path)
    assert table.changed(changes(spark, table, ("r1", "patch", {"name": "first"}))) == 2
    with pytest.raises(versions.Conflict):
        table.changed(changes(spark, table, ("r1", "patch", {"name": "second"})), base=1)
    assert table.read().filter("id = 'r1'").first().name == "first" and table.versions() == [1, 2]


def test_a_table_without_rows_left(spark, tmp_path):
    table = catalog(spark, tmp_path)
    table.changed(table.read().select("id", F.lit("delete").alias("op"), F.lit(None).cast(table.read().schema.simpleString()).alias("row"), F.lit(None).cast("map<string,string>").alias("columns")))
    assert table.read().count() == 0 and table.read(1).count() == 40


def test_commit_of_snapshots(spark, tmp_path):
    files = {
        "scrape_review_national_20260818.json": [{"id": "n1", "url": "https://New.org/"}, {"url": "https://r1.org"}, {"url": "https://two.org"}, {"id": "r2", "url": "https://three.org"}, {"name": "no url"}],
        "scrape_review_seattle_20260819.json": [{"id": "n9", "url": "https://new.org"}, {"id": "n1", "url": "https://four.org"}],
        "review_check_dry_run_20260818.json": [{"id": "r1", "review_status": "verified", "previous_review_status": None}, {"id": "r2", "review_status": "x", "previous_review_status": "x"}],
        "review_check_dry_run_20260820.json": [{"id": "r1", "review_status": "rejected", "previous_review_status": "verified"}, {"id": "lost", "review_status": "y", "previous_review_status": None}],
        "refresh_opportunities_dry_run_20260818.json": [{"id": "r3", "changes": {"name": "renamed"}}, {"id": "r4", "changes": {"name": "z", "salary": "1"}}, {"id": "r5", "changes": {}}, {"changes": {"name": "q"}}],
    }
    (tmp_path / "in").mkdir()
    for name, items in files.items():
        (tmp_path / "in" / name).write_text(json.dumps(items))
    (tmp_path / "in" / "deadline_check_dry_run_20260818.json").write_text('[{"id": "r1", "chan')
    wide = "review_summary string, review_sources array<struct<url:string,note:string>>, last_reviewed_at timestamp_ntz"
    rows = spark.createDataFrame([(f"r{i}", f"https://r{i}.org", "old", True, None, None, None, None, None) for i in range(6)], "id string, url string, name string, is_active boolean, review_status string, updated_at timestamp_ntz, " + wide)
    table = versions.VersionedTable(spark, f"file://{tmp_path}/t", buckets=4)
    table.create(rows)
    entries = src.entries(src.snapshot_files(spark, str(tmp_path / "in")))
    log = {x.file: (x.entries, x.applied, x.skipped_no_change, x.skipped_duplicate, x.errors) for x in versions.commit_snapshots(table, entries, "2026-08-25 10:00:00").collect()}
    assert log == {
        "scrape_review_national_20260818.json": (5, 2, 1, 1, 1),
        "scrape_review_seattle_20260819.json": (2, 0, 0, 1, 1),
        "review_check_dry_run_20260818.json": (2, 1, 1, 0, 0),
        "review_check_dry_run_20260820.json": (2, 2, 0, 0, 0),
        "refresh_opportunities_dry_run_20260818.json": (4, 1, 2, 0, 1),
    }
    after = {x.id: x for x in table.read().collect()}
    new = next(i for i in after if i.startswith("u"))
    assert set(after) == {*(f"r{i}" for i in range(6)), "n1", new}
    assert (after["r1"].review_status, after["r1"].review_sources, after["r3"].name, after["r4"].name) == ("rejected", [], "renamed", "old")
    assert not after["n1"].is_active and after[new].url == "https://two.org" and after["r0"].updated_at is None and str(after["r3"].updated_at) == "2026-08-25 10:00:00"
    # again: every file is refused, and no version is made
    assert versions.commit_snapshots(table, entries, "2026-08-26 10:00:00").count() == 0 and table.versions() == [1, 2]
    assert {x.id: x for x in table.read().collect()} == after and table.log().count() == 5
