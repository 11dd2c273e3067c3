"""Queries over tables that are larger than the bounds that once cut them."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import similarity
from quillspark.operators.numbering import numbered
from quillspark.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same_as_whole(spark, duck, name):
    """The query against its SQL."""
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    out = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in out.description]
    assert sorted(tuple(map(str, (r[c] for c in names))) for r in rows) == sorted(tuple(map(str, r)) for r in out.fetchall())
    return rows


def test_places_run_through_all_ranges(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id") % 3).alias("k"))  # one common value
    got = {r.id: r.place for r in numbered(rows, [F.col("k"), F.col("id")]).collect()}
    want = sorted(got, key=lambda i: (7 if i % 4 else i % 3, i))
    assert [got[i] for i in want] == list(range(1, 5001))


def test_tracker_order_ranks_every_item(spark, duck):
    rows = same_as_whole(spark, duck, "tracker_order")
    assert max(r.id for r in rows) > 2000


def test_result_order_places_the_whole_catalog(spark, duck):
    rows = same_as_whole(spark, duck, "result_order")
    assert max(r.id for r in rows) > 500


def test_ranking_reaches_past_the_first_thousand_places(spark, tmp_path):
    d = str(tmp_path)
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 8000)).write.parquet(f"{d}/part.parquet")
    got = registry.QUERIES["ranked_candidates"](spark, d).collect()
    ids = sorted(r.p_partkey for r in spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 5 = 0").collect())
    assert [r.id for r in got] == ids and [r.place for r in got] == [i // 5 + 1 for i in ids] and max(ids) > 5000


def test_snapshot_plan_looks_up_every_even_page(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(3, "https://late.example/a"), (4, "https://other.example/b"), (60, "https://late.example/c"), (5, "https://new.example/d"), (7, "https://new.example/e")], "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    got = {r.page_id: r.verdict for r in registry.QUERIES["snapshot_plan"](spark, d).collect()}
    assert got == {3: "in_catalog", 5: "insert", 7: "in_file"}


def test_snapshot_plan_equals_the_whole_sql(spark, duck):
    same_as_whole(spark, duck, "snapshot_plan")


def find_duplicates(new, catalog, same):
    """(exact, candidates) of one submission by a walk over all rows."""
    rows = [r for r in catalog if r.key and not (same and r.id == new.id)]
    peers = sum(bool(new.domain) and r.domain == new.domain for r in rows)
    under = lambda a, b: a != "" and b.startswith(a + "/")
    found = []
    for r in rows:
        ratio, site = similarity._ratio(new.name_key, r.name_key), bool(new.domain) and r.domain == new.domain
        if new.key and r.key == new.key:
            if new.name_key == r.name_key or ratio >= 0.82:
                return r.id, []
            found.append((0, -1.0, r.id))
        elif new.key and (new.key == r.apply_key or new.apply_key and new.apply_key == r.key):
            found.append((0, 0.0, r.id))
        elif site and (under(new.path, r.path) or under(r.path, new.path) or ratio >= 0.82):
            found.append((0, -ratio, r.id))
        elif ratio >= 0.88 or site and peers <= 3:
            found.append((1, -ratio, r.id))
    return None, [f"{('strong', 'weak')[k]}:{i}" for k, _, i in sorted(found, key=lambda x: x[:2])[:5]]


def by_walk(submissions, catalog, same):
    from quillspark.functions import urls

    rows = similarity.with_keys(catalog).withColumn("apply_key", urls.match_key(F.col("apply_url"))).orderBy("pos").collect()
    new = similarity.with_keys(submissions).withColumn("apply_key", urls.match_key(F.col("apply_url"))).collect()
    every = {n.id: find_duplicates(n, rows, same) for n in new}
    return {i: v for i, v in every.items() if v != (None, [])}


@pytest.mark.parametrize("same", [True, False])
def test_candidates_equal_a_walk_over_all_rows(spark, same):
    rng = random.Random(5)
    word = lambda: rng.choice(["robotics", "robotic", "chess", "summer", "art", "arts", "math", "club"])
    url = lambda: rng.choice(["", *[f"https://{rng.choice(['a.big.org', 'www.big.org', 'mid.org', f's{rng.randrange(25)}.net'])}{rng.choice(['', '/x', '/x/y', '/x/y/z', '/p', '/p?q=1'])}"] * 12])
    data = [(i, url(), rng.choice(["", "", url()]), f"{word()} {word()} {rng.choice(['camp', 'camps', 'days'])}" if i % 9 else "club", i) for i in range(320)]
    rows = spark.createDataFrame(data, "id long, url string, apply_url string, name string, pos long")
    new = rows if same else rows.filter("id >= 200")
    catalog = rows if same else rows.filter("id < 200")
    got = {r.id: (r.exact, list(r.candidates)) for r in similarity.duplicate_candidates(new, catalog, same=same).collect()}
    assert got == by_walk(new, catalog, same)


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_of_a_few_names_on_many_rows_equal_a_walk(spark, seed, same):
    """Each name has more rows than are kept of it, so names and rows that come too late are left out; pages and apply pages take others away."""
    rng = random.Random(seed)
    urls_ = [f"https://{h}{p}" for h in ("a.big.org", "www.big.org", "b.big.org", "mid.org", "x.mid.org", "one.net") for p in ("", "/x", "/x/y", "/p", "/q")]
    url = lambda: rng.choice(urls_[:9] if rng.random() < 0.7 else urls_)
    names = ["summer robotics camp", "summer robotics camps", "summer robotic camp", "summer robots camp", "summer robotics club", "winter robotics camp", "chess"]
    data = [(i, url(), rng.choice(["", url(), urls_[1]]), names[min(rng.randrange(7), rng.randrange(7))], rng.randrange(500) * 1000 + i) for i in range(420)]
    rows = spark.createDataFrame(data, "id long, url string, apply_url string, name string, pos long")
    new = rows if same else rows.filter("id >= 300")
    catalog = rows if same else rows.filter("id < 300")
    got = {r.id: (r.exact, list(r.candidates)) for r in similarity.duplicate_candidates(new, catalog, same=same).collect()}
    assert got == by_walk(new, catalog, same)


def test_common_characters_bound_the_ratio():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randint(4, 12))) for _ in range(2))
        least = rng.choice((0.5, 0.7, 0.82, 0.85, 0.88))
        want = similarity._ratio(a, b)
        assert similarity._like(a, b, least) == want if want >= least else similarity._like(a, b, least) < least


def test_fuzzy_candidates_seeks_duplicates_of_every_part(spark):
    got = {r.id: r.exact for r in registry.QUERIES["fuzzy_candidates"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) > 100


def test_greedy_new_equals_a_walk_over_known_and_all_new_rows(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abc de") for _ in range(rng.randint(3, 9)))
    data = [(i, name(), rng.choice(["", f"https://x.org/{rng.randrange(400)}/", f"HTTPS://x.org/{rng.randrange(400)}"]), (i * 37) % 331) for i in range(331)]
    rows = spark.createDataFrame(data, "id long, name string, url string, pos long")
    from quillspark.functions import urls

    keyed = rows.select("id", "pos", urls.weak(F.col("url")).alias("u"), urls.name_key(F.col("name")).alias("n")).orderBy("pos", "id").collect()
    seen, names, want = {r.u for r in keyed if r.id < 40}, [r.n for r in keyed if r.id < 40], {}
    for r in keyed:
        if r.id >= 40:
            want[r.id] = not (r.u and r.u in seen or any(similarity._ratio(r.n, k) >= 0.85 for k in names))
            if want[r.id]:
                seen.add(r.u)
                names.append(r.n)
    assert 50 < sum(want.values()) < len(want) - 50
    assert {r.id: r.accepted for r in similarity.greedy_new(rows.filter("id >= 40"), rows.filter("id < 40")).collect()} == want


def test_a_long_chain_of_like_names_needs_few_jobs(spark):
    """Each name is like the next one and not like the one after, so every second row is accepted; some share URLs across chains."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [letters[(7 * i) % 26] + letters[(11 * i + i // 26) % 26] for i in range(1300)]
    names = ["".join(base[i : i + 12]) for i in range(1000)]
    data = [(i, n, f"https://x.org/{i % 350}" if i % 9 == 0 else "", i) for i, n in enumerate(names)] + [(2000 + i, "opportunity", "", 2000 + i) for i in range(3)]
    rows = spark.createDataFrame(data, "id long, name string, url string, pos long")
    seen, kept, want = set(), [], {}
    for i, n, u, _ in data:
        want[i] = not (u and u in seen or any(similarity._ratio(n, k) >= 0.85 for k in kept if abs(int(len(k)) - len(n)) < 9))
        if want[i]:
            seen.add(u)
            kept.append(n)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("greedy", "greedy")
    got = {r.id: r.accepted for r in similarity.greedy_new(rows, rows.limit(0)).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and 200 < sum(want.values()) < 800
    assert len(jobs.getJobIdsForGroup("greedy")) < 400


def test_greedy_dedupe_repeats_no_url_or_name_across_the_table(spark):
    d = "/root/testdata/sf0.001"
    kept = [r.id for r in registry.QUERIES["greedy_dedupe"](spark, d).filter("accepted").collect()]
    names = {r.id: r.n for r in spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" ")))).alias("n")).collect()}
    known = [n for i, n in names.items() if i % 2 == 0]
    for k, i in enumerate(sorted(kept)):
        assert all(similarity._ratio(names[i], n) < 0.85 for n in [*known, *(names[j] for j in sorted(kept)[:k])])
