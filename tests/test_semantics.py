"""Small hand-worked cases, one for each point where a plain reading would go wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, text, urls
from quillspark.functions.text import _recovered
from quillspark.operators import accounts, curation, runs, search, similarity, tracker

D = dt.date


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_days_until_counts_to_the_end_of_the_day(spark):
    t = F.to_date(F.lit("1998-07-01"))
    r = one(spark, today=dates.days_until(t, t), before=dates.days_until(F.date_sub(t, 1), t), after=dates.days_until(F.date_add(t, 2), t))
    assert (r.today, r.before, r.after) == (1, 0, 3)


def items(spark, rows):
    return spark.createDataFrame([(i, [dict(date=D.fromisoformat(x), label="l", type="o") for x in ds], e) for i, ds, e in rows], "id int, dates array<struct<date:date,label:string,type:string>>, was_estimated boolean").withColumn("run_status", F.when(F.col("id") == 6, "not_running").when(F.col("id") == 7, "unknown").otherwise("running"))


def test_progress_of_timelines(spark):
    rows = items(spark, [(1, ["1998-07-01"], False), (2, ["1998-06-01", "1998-06-30"], False), (3, ["1998-06-01"], True), (4, ["1998-06-01"], False), (5, [], False), (6, ["1998-08-01"], False), (7, ["1998-06-01"], True)])
    got = {r.id: r.status for r in tracker.with_status(rows, "1998-07-01").collect()}
    assert got == {1: "not_started", 2: "in_progress", 3: "not_started", 4: "completed", 5: "not_started", 6: "completed", 7: "completed"}


def test_yesterday_is_still_upcoming(spark):
    rows = items(spark, [(1, ["1998-06-30", "1998-07-05"], False), (2, ["1998-05-01", "1998-06-01"], False)])
    got = {r.id: r.next.date for r in tracker.with_next(rows, "1998-07-01").collect()}
    assert got == {1: D(1998, 6, 30), 2: D(1998, 6, 1)}


def test_items_past_before_this_month_are_in_no_window(spark):
    rows = items(spark, [(1, ["1998-06-01"], False), (2, ["1998-08-31"], False), (3, ["1999-01-01"], False)])
    assert {r.id: r.due for r in tracker.due(rows, "1998-07-01").collect()} == {2: "soon", 3: "beyond"}


def test_trial_without_an_end_never_ends_but_the_helper_says_expired(spark):
    day = dt.datetime(1998, 7, 3, 12)
    rows = [(1, "trial", None, None), (2, "beta", None, None), (3, "active", None, None), (4, None, None, None), (5, "", dt.datetime(1998, 6, 30), day), (6, "beta", None, day), (7, "canceled", day, day), (8, "trial", day, None), (9, "past_due", day, day)]
    acc = spark.createDataFrame(rows, "userid int, status string, trial_ends_at timestamp_ntz, subscription_end_at timestamp_ntz")
    got = {r.userid: (r.status, r.access, r.expired, r.days_left) for r in accounts.subscription_state(acc, "1998-07-01").collect()}
    assert got == {1: ("trial", True, False, 0), 2: ("beta", False, False, 0), 3: ("active", True, False, 0), 4: ("trial", True, False, 0), 5: ("trial", False, True, 0), 6: ("beta", True, False, 3), 7: ("canceled", True, False, 0), 8: ("trial", True, False, 3), 9: ("past_due", False, False, 0)}
    assert one(spark, x=dates.expired(F.lit(None).cast("timestamp"), F.lit("1998-07-01").cast("timestamp"))).x


def test_gate_lets_unknown_users_pass(spark):
    acc = spark.createDataFrame([(1, "past_due", None, None)], "userid int, status string, trial_ends_at timestamp_ntz, subscription_end_at timestamp_ntz")
    req = spark.createDataFrame([(1,), (2,), (None,)], "userid int")
    assert sorted((str(r.userid), r.reason, r.blocked) for r in accounts.access_gate(req, acc, "1998-07-01").collect()) == [("1", "payment_due", True), ("2", "unknown_user", False), ("None", "anonymous", False)]


def test_null_status_stays_in_the_queue(spark):
    rows = spark.createDataFrame([(1, None, "s"), (2, "approved", "s"), (3, "pending", "s")], "id int, moderation_status string, source string")
    assert [r.id for r in curation.review_queue(rows).collect()] == [3, 1]


def test_moderation_clears_and_keeps_duplicates(spark):
    rows = spark.createDataFrame([(1, None, 9, True, None), (2, None, None, True, None), (3, None, 8, True, None)], "id int, moderation_status string, duplicate_of int, is_active boolean, reviewed_by string")
    d = spark.createDataFrame([(1, "approved", None), (2, "duplicate", 1), (3, "bad", 4)], "id int, status string, duplicate_of int")
    got = {r.id: (r.moderation_status, r.duplicate_of, r.is_active) for r in curation.moderated(rows, d, "me").collect()}
    assert got == {1: ("approved", None, True), 2: ("duplicate", 1, False), 3: (None, 8, True)}


def test_commit_twice_inserts_nothing(spark):
    new = spark.createDataFrame([("https://a.org/x/", 1), ("https://A.org/x", 2), ("", 3), ("", 4)], "url string, pos int")
    none = spark.createDataFrame([], "url string")
    plan = {r.pos: r.verdict for r in curation.snapshot_plan(new, none).collect()}
    assert plan == {1: "insert", 2: "in_file", 3: "insert", 4: "insert"}
    again = {r.pos: r.verdict for r in curation.snapshot_plan(new, new).collect()}
    assert again == {1: "in_catalog", 2: "in_catalog", 3: "insert", 4: "insert"}


def test_changes_tell_leave_from_clear(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    up = spark.createDataFrame([(1, None, ["n"]), (2, "c", None)], "id int, name string, cleared array<string>")
    assert sorted(map(tuple, curation.changed(rows, up, cleared="cleared").collect())) == [(1, "a", None), (2, "c", 6)]


def test_run_status_ladder(spark):
    rows = spark.createDataFrame([(1, 1, "1998-07-01 00:00:00", None), (2, 0, "1998-07-01 00:00:00", "1998-07-01 00:01:00"), (3, 0, None, None), (4, 0, "1998-07-01 00:00:00", None), (5, 0, "1998-06-30 23:00:00", None)], "id int, errors int, s string, f string")
    rows = rows.withColumns({"started_at": F.col("s").cast("timestamp_ntz"), "finished_at": F.col("f").cast("timestamp_ntz")})
    got = {r.id: r.st for r in rows.select("id", runs.status("1998-07-01 00:30:00").alias("st")).collect()}
    assert got == {1: "failed", 2: "success", 3: "interrupted", 4: "running", 5: "interrupted"}


def test_gates_fall_back_to_the_whole_pool(spark):
    rows = spark.range(30)
    assert search.gated(rows, F.col("id") < 14, 15).count() == 30
    assert search.gated(rows, F.col("id") < 15, 15).count() == 15


@pytest.mark.parametrize(
    ("said", "grade"),
    [("I am in grade 11", 11), ("a 10th grade student", 10), ("rising junior", 11), ("in middle school now", 8), ("grade 5", None), ("I am 12", None), ("8-grade", 8), ("seniority", None), ("nothing", None), ("", None), (None, None)],
)
def test_grades(spark, said, grade):
    assert one(spark, g=text.grade(F.lit(said).cast("string"))).g == grade


@pytest.mark.parametrize(
    ("url", "key", "domain"),
    [
        ("HTTP://www.Example.co.uk/A/index.html?utm_source=x&b=2&a=1#top", "example.co.uk/a?a=1&b=2", "example.co.uk"),
        ("example.org/", "example.org", "example.org"),
        ("https://a.b.example.com/X/", "a.b.example.com/x", "example.com"),
        ("//x.org/A//b/default.ASP/", "x.org/a/b", "x.org"),
        ("https://u:p@m.school.sch.uk:443/FAQ?Q=A%20b&gclid=1&a", "m.school.sch.uk/faq?q=a+b&a=", "school.sch.uk"),
        ("x.org?source=1&UTM_source=2&utm_other=3", "x.org?source=1&utm_other=3", "x.org"),
        ("", "", ""),
    ],
)
def test_url_keys(spark, url, key, domain):
    r = one(spark, k=urls.match_key(F.lit(url)), d=urls.registrable(urls.host(F.lit(url))))
    assert (r.k, r.d) == (key, domain)


@pytest.mark.parametrize(
    ("noisy", "value"),
    [('x {"a": 1} y', '{"a": 1}'), ('[1, {"b": "c', '[1, {"b": "c"}]'), ('{"a": 1,  ', '{"a": 1}'), ('{"a": ', None), ('{"a": "\\\\"} "', '{"a": "\\\\"}'), ('{"a": "q\\"}" } z', '{"a": "q\\"}"}'), ("[[1], [2]] [3]", "[[1], [2]]"), ('{"a": [1, 2', '{"a": [1, 2]}'), ("none", None), (None, None), ('{"a": "x\ny"}', '{"a": "x\\ny"}')],
)
def test_json_recovery(noisy, value):
    assert _recovered(noisy) == value


def test_exact_duplicates_empty_the_candidates(spark):
    new = spark.createDataFrame([(1, "https://x.org/a", "", "Robotics Summer Camp"), (2, "https://x.org/a/b", "", "Other Thing"), (3, "https://q.org/", "https://x.org/a", "Unlike")], "id int, url string, apply_url string, name string")
    cat = spark.createDataFrame([(10, "https://www.x.org/a/", "Robotics Summer Camp 2024", 1), (11, "https://y.org/z", "Robotics Summer Camps", 2)], "id int, url string, name string, pos int")
    got = {r.id: (r.exact, list(r.candidates)) for r in similarity.duplicate_candidates(new, cat).collect()}
    assert got == {1: (10, []), 2: (None, ["strong:10"]), 3: (None, ["strong:10"])}


@pytest.mark.parametrize("least", [0.82, 0.85])
def test_tokens_lose_no_similar_pair(spark, least):
    import itertools
    import random

    rng = random.Random(3)
    names = {"".join(rng.choice("abcd e") for _ in range(rng.randint(4, 30))).strip() for _ in range(120)}
    names |= {n[:-1] + "x" for n in list(names)[:60]} | {n[: len(n) // 2] + "z" + n[len(n) // 2 :] for n in list(names)[:60]} | {n + " aaaa" for n in list(names)[:20]}
    names = sorted(n for n in names if len(n) >= 4)
    df = spark.createDataFrame([(n,) for n in names], "name_key string")
    got = {(r.name_key, r.k_key): r.ratio for r in similarity.alike_names(df, df.withColumnRenamed("name_key", "k_key"), least).collect()}
    want = {(a, b): similarity._ratio(a, b) for a, b in itertools.product(names, names) if similarity._ratio(a, b) >= least}
    assert got == want and len(want) > len(names) + 50


def test_greedy_acceptance_follows_the_order(spark):
    rows = spark.createDataFrame([(1, "Robotics Camp", "u1", 1, 0), (2, "Robotics Camps", "u2", 2, 0), (3, "Other", "u1", 3, 0), (4, "Chess Club Days", "u4", 4, 0)], "id int, name string, url string, pos int, batch int")
    assert {r.id: r.accepted for r in similarity.greedy(rows).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_anti_joins_stay_hash_joins(spark):
    rows = spark.range(10).select("id", (F.col("id") % 3).alias("url"))
    plan = search.without_tracked(rows, rows, ["id", "url"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
