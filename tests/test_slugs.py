"""Ids made from slugs against giving them one after another, on names that end with numbers as made ids do."""

import random


import pytest
from pyspark.sql import functions as F

from quillspark.functions import extract
from quillspark.operators import editing


def one_after_another(slugs, taken):
    used, out = set(taken), []
    for s in slugs:
        s, n = s or "opportunity", 2
        new = s
        while new in used:
            new = f"{s}-{n}"
            n += 1
        used.add(new)
        out.append(new)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_those_of_the_loop(spark, seed):
    r = random.Random(seed)
    names = ["a", "a-2", "a-3", "a-4", "a-2-2", "a-2-3", "a-2-2-2", "a-02", "a-1", "a-0", "b", "b-3", "b-3-2", "opportunity-2", "", "c-2", "a-99999999999"]
    slugs = [r.choice(names[: r.choice([3, 6, 17])]) for _ in range(250)]
    taken = r.sample(names[1:14], 3 if seed else 0)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(slugs)], "pos long, s string").repartition(3)
    got = editing.unique_slugs(rows, F.col("s"), taken=spark.createDataFrame([(t,) for t in taken], "id string")).orderBy("pos").collect()
    assert [x.slug for x in got] == one_after_another(slugs, taken) and len({x.slug for x in got}) == len(got)


def test_three_ids_for_three_names(spark):
    rows = spark.createDataFrame([(0, "art-camp"), (1, "art-camp"), (2, "art-camp-2")], "pos long, s string")
    assert [x.slug for x in editing.unique_slugs(rows, F.col("s")).orderBy("pos").collect()] == ["art-camp", "art-camp-2", "art-camp-2-2"]
    assert editing.unique_slugs(rows.limit(0), F.col("s")).count() == 0


def test_hues_follow_the_units_of_the_text(spark):
    def hue(seed):
        units = [int.from_bytes(seed.encode("utf-16-be")[i : i + 2], "big") for i in range(0, 2 * len(seed.encode("utf-16-be")) // 2, 2)]
        h = 0
        for u in units:
            low = (h << 5) & 0xFFFFFFFF
            h = u + (low - (1 << 32) if low >= 1 << 31 else low) - h
        return abs(h * 137.508) % 360

    seeds = ["", "a", "Summer camp of the arts", "É😀 日本", "x" * 500]
    got = {r.s: r.h for r in spark.createDataFrame([(s,) for s in seeds], "s string").select("s", extract.hue(F.col("s")).alias("h")).collect()}
    assert got == {s: hue(s) for s in seeds}
