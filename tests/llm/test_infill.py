"""Fill-in-middle against a plain walk over each text's units, on hard rows."""

import hashlib
import random
import re

from quillspark.llm import infill

SCHEMA = "doc_id long, text string, form string, key string, n string, lengths string, lang string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "f", "k", "n", "l", "en") for i, t in rows], SCHEMA)


def walk(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(infill.UNIT, text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return text, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return f"<S>{suf}<P>{pre}<M>{mid}", "spm", n, len(pre), len(mid)
    return f"<P>{pre}<S>{suf}<M>{mid}", "psm", n, len(pre), len(mid)


r = random.Random(7)
BITS = ["a", "word", "É", "日本語", "😀", " ", "  ", "\n", "\t ", "\x0b", " ", "<", "P>", "<S", ">", "<M", "x" * 50, ""]
ROWS = [(i, "".join(r.choice(BITS) + r.choice(["", " "]) for _ in range(r.randint(0, 40)))) for i in range(400)]
ROWS += [(None, "no id here"), (None, None), (500, None), (501, ""), (502, "   \n"), (503, "a <P> b"), (504, " lead and trail  "), (505, "long " * 40_000)]
ROWS += [(506, "same"), (506, "same"), (506, "other text here")] + [(507, "hot row of many copies")] * 800
ROWS += [(i, "<<S<P<M< >" * 3) for i in range(600, 640)]


def test_outputs_are_those_of_a_walk_over_units(spark):
    out = infill.infilled(table(spark, ROWS))
    out = out.withColumn("back", infill.restored(out["output"], out["form"]))
    key = lambda x: (str(x[0]), *map(str, x[1:]))
    got = sorted(((x.doc_id, x.text, x.output, x.form, x.n, x.prefix_chars, x.middle_chars) for x in out.collect()), key=key)
    want = sorted(((i, t or "", *walk(i, t)) for i, t in ROWS), key=key)
    assert got == want
    assert out.filter("back <> text").count() == 0
    assert {x[3] for x in got} == {"plain", "psm", "spm"} and sum(x[3] != "plain" for x in got) > 100


def test_query_digests(spark, tmp_path):
    table(spark, ROWS).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in ROWS:
        output, form, n, a, b = walk(i, t)
        want.append((i, n, form, a, b, sha(output), sha(t or "")))
    got = [tuple(x) for x in infill.op13_infill(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ends_are_running_sums(spark):
    rows = spark.createDataFrame([("k", [3, 1, 4]), ("m", [5])], "key string, lengths array<int>")
    assert sorted(map(tuple, infill.units(rows).collect())) == [("k", 1, 3), ("k", 2, 4), ("k", 3, 8), ("m", 1, 5)]


def test_an_empty_table(spark):
    assert infill.infilled(table(spark, ROWS[:1]).limit(0)).count() == 0
