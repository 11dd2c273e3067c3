"""Each corpus operator against brute force or an exact round trip, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, common, components, decontaminate, jaccard, licenses, media, mixing, quality, substring_dedup, token_files, urls

rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("aeioukst") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["É́t", "Straße", "日本", "x_y", "don't"]


def prose(n, r=rng):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, start long, n long, key string, component_id long, epoch string, w string"


def table(spark, rows):
    """rows: (doc_id, text); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], f"src{k % 5}" if k % 7 else None, len(t) if t else None, "h", 1, 2, "k", 3, "e", "w") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    base, passage = [prose(r.randint(30, 200), r) for _ in range(40)], prose(60, r)
    rows = list(enumerate(base))
    add = lambda t: rows.append((len(rows), t))
    for t in base[:10]:
        add(t)
    for t in base[:12]:
        for _ in range(3):
            w = t.split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            add(" ".join(w))
    for _ in range(8):
        add(f"{prose(r.randint(0, 50), r)}\n{passage}\t {prose(r.randint(0, 50), r)}")
    for t in ["", None, "one", "One two", "a a a a a", "the end " * 60, "  lead and trail \n", prose(6000, r), "x", "x"]:
        add(t)
    return rows


def ids_of(rows):
    return {i: t for i, t in rows}


# 1 substring dedup


def test_substring_dedup(spark, corpus):
    out = substring_dedup.substring_dedup(table(spark, corpus))
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()}
    want = substring_dedup.brute_force(corpus)
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_substring_dedup_edges(spark):
    t = prose(25)
    rows = [(None, t), (5, t), (2, t), (2, t), (7, None), (8, "")]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.substring_dedup(table(spark, rows)).collect())
    assert got == [("2", 0), ("2", 0), ("5", 25), ("7", 0), ("8", 0), ("None", 0)]
    assert substring_dedup.substring_dedup(table(spark, [(1, "x")]).limit(0)).count() == 0


def test_factors_name_true_sources(spark, corpus):
    words = {i: (t or "").split() for i, t in corpus}
    for r in substring_dedup.substring_dedup(table(spark, corpus)).collect():
        for f in r.factors:
            assert words[r.doc_id][f.start : f.start + f.words] == words[f.source_doc][f.source_start : f.source_start + f.words]
            assert (f.source_doc, f.source_start) < (r.doc_id, f.start) and f.words >= substring_dedup.WINDOW


def test_texts_that_share_an_id(spark):
    a, b = prose(30), prose(40)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(table(spark, [(1, a), (1, b), (2, a + " " + b), (1, f"{b} {b}")])).collect())
    assert sum(x[2] for x in got) == 80 + 70 and (1, 30, 0) in got and got[-1] == (2, 70, 70)


def test_parse_takes_the_farthest_factor():
    g = np.random.default_rng(3)
    for _ in range(300):
        n = int(g.integers(1, 40))
        hit = np.flatnonzero(g.random(n) < 0.7)
        docs = np.repeat(g.integers(0, 3, n), g.integers(1, 6, n))[:n][hit]
        source = hit + g.integers(0, 2) * 100
        found = substring_dedup.parse(hit, np.ones(len(hit), np.int64), docs, source, window=4)
        covered = {x for h in hit.tolist() for x in range(h, h + 4)}
        assert {x for s, w, _, _ in found for x in range(s, s + w)} == covered
        starts = [s for s, *_ in found]
        assert starts == sorted(starts) and all(w >= 4 for _, w, _, _ in found)
        # no factor is needless: each reaches beyond the one before, and those two apart do not meet
        ends = [s + w for s, w, _, _ in found]
        assert all(a < b for a, b in zip(ends, ends[1:])) and all(found[i + 2][0] > ends[i] for i in range(len(found) - 2))


# 2 quality


def junk(n, r):
    w = r.choice(VOCABULARY)
    return " ".join(x + "!!" for x in prose(n, r).upper().split()) if r.random() < 0.5 else " ".join([w] * n)


def test_quality_learns_and_keeps_out_labels(spark):
    r = random.Random(3)
    rows = [(i, junk(60, r) if i % 4 == 0 else prose(60, r)) for i in range(600)] + [(9000, None), (9001, ""), (None, "abc"), (9002, prose(5000, r))]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, model, ["doc_id"]).select("doc_id", "quality_score", quality.held_out(F.col("doc_id")).alias("held")).collect()
    assert len(got) == len(rows) and all(0 <= x.quality_score <= 1 for x in got)
    held = [x for x in got if x.held and x.doc_id is not None and x.doc_id < 600]
    assert len(held) > 100 and all(zlib.crc32(str(x.doc_id).encode()) % 3 == 1 for x in held)
    assert sum((x.quality_score >= 0.5) == (x.doc_id % 4 != 0) for x in held) / len(held) > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert np.array_equal(model.linear, again.linear) and np.array_equal(model.factors, again.factors)
    none = quality.train(docs, labels.limit(0))
    assert {x.quality_score for x in quality.score_quality(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score_quality(docs, model).columns == [*docs.columns, "quality_score"]
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_features_against_plain_counts():
    import math

    texts = ["", "Aa, b! b! 42\n\nÉ x", None, "one one one ONE.", prose(300), " \t ", "a" * 2000]
    chars = np.array([0, 20, np.nan, 5, 1500, 3, 2000.0])
    off, ids, x = quality.features(pa.array(texts), chars)
    cap = quality.STAT_BINS - 1
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        ws = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        bins = Counter(int(quality.words(pa.array([w.decode()])).hash[0] >> np.uint64(48)) & (quality.WORD_BINS - 1) for w in ws)
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in bins.values())) or 1
        n, size = max(len(ws), 1), max(len(raw), 1)
        letters, digits = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"0123456789")
        marks = {c for c in range(0x21, 0x7F)} - letters - digits
        share = lambda group: sum(c in group for c in raw) / size
        stats = [
            math.sqrt(share(set(range(0x41, 0x5B)))) * quality.STAT_BINS, math.sqrt(share(marks)) * quality.STAT_BINS, math.sqrt(share(digits)) * quality.STAT_BINS, math.sqrt(share({10})) * 2 * quality.STAT_BINS,
            share(set(range(128, 256))) * quality.STAT_BINS, sum(map(len, ws)) / n, len(bins) / n * cap, math.sqrt(sum(a == b for a, b in zip(ws, ws[1:])) / n) * quality.STAT_BINS,
            sum(w[-1] in marks for w in ws) / n * cap, math.log2(n), cap if math.isnan(chars[i]) else min(math.log2(chars[i] + 1), cap - 1), math.sqrt(max(bins.values(), default=0) / n) * quality.STAT_BINS,
        ]
        want = {b: math.log1p(c) / norm for b, c in bins.items()} | {quality.WORD_BINS + k * quality.STAT_BINS + min(max(int(v), 0), cap): 0.5 for k, v in enumerate(stats)}
        got = dict(zip(ids[off[i] : off[i + 1]].tolist(), x[off[i] : off[i + 1]].tolist()))
        assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-5) for k in want), t


def test_documents_without_a_length_column(spark):
    docs = table(spark, [(i, junk(40, random.Random(i)) if i % 2 else prose(40, random.Random(i))) for i in range(60)])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.train(docs.drop("n_chars"), labels)
    assert quality.score_quality(docs.drop("n_chars"), model, ["doc_id"]).count() == 60


def test_sum_of_squares_identity():
    g = np.random.default_rng(1)
    m = quality.Model(0.3, g.normal(size=quality.WIDTH).astype(np.float32), g.normal(size=(quality.WIDTH, quality.RANK)).astype(np.float32))
    ids, x = g.integers(0, quality.WIDTH, 12), g.normal(size=12).astype(np.float32)
    pairs = sum(float(m.factors[ids[i]] @ m.factors[ids[j]]) * x[i] * x[j] for i in range(12) for j in range(i))
    assert np.isclose(m.logits(np.array([0, 12]), ids, x)[0], 0.3 + float(m.linear[ids] @ x) + pairs, rtol=1e-3)


# 3 decontamination


def own_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination(spark, corpus, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    r = random.Random(9)
    texts = ids_of(corpus)
    items = [(k, " ".join((texts[k] or "").split()[3:20]).upper().replace("É", "É")) for k in range(6)] + [(100, "One, two!"), (101, ""), (102, None), (103, prose(30, r)), (3, texts[3]), (104, "..."), (None, texts[7])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = table(spark, [*corpus, (500, "!!! one TWO. one-two"), (501, "?"), (None, texts[3])])
    hits = {x.doc_id: (x.n_hit, x.item_ids) for x in decontaminate.contamination(docs, bench).collect()}
    counts = {x.doc_id: x.n for x in docs.select("doc_id", decontaminate.count_words(F.col("text")).alias("n")).collect()}
    windows = [(str(i), own_words(t)[s : s + 10]) for i, t in items if i is not None for s in range(max(1, len(own_words(t)) - 9)) if own_words(t)]
    want = {}
    for i, t in [*corpus, (500, "!!! one TWO. one-two"), (501, "?")]:
        w, hit, found = own_words(t), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
        assert (counts[i] or 0) == len(w), t
        if hit:
            want[i] = (len(hit), sorted(found))
    assert hits == want and len(want) > 10
    both = table(spark, [(1, "one two"), (1, "three"), (1, "one two")])
    assert [(x.doc_id, x.n_hit) for x in decontaminate.contamination(both, bench).collect()] == [(1, 2)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_stays_native(spark, corpus):
    plan = decontaminate.contamination(table(spark, corpus), spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# 4 media


def test_media_round_trip(spark, corpus):
    got = {r.doc_id: r for r in media.read_media(media.stored_media(table(spark, corpus))).collect()}
    for i, t in corpus:
        raw = (t or "").encode()
        padded = raw + bytes(64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.sound(padded)), hashlib.sha256(media.sound(padded)).hexdigest())


def png():
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"


@pytest.mark.parametrize(("value", "kind"), [(png(), "image/png"), (GIF, "image/gif"), (media.sound(b"\x80" * 10), "audio/wav"), (__import__("gzip").compress(b"abc"), "application/gzip")])
def test_sniffing_confirms_and_carves(value, kind):
    assert media.sniff(value) == [(kind, 0, len(value))]
    assert media.sniff(b"junk" + value + b"more") == [(kind, 4, len(value))] or kind == "application/gzip"
    assert (kind, 0, len(value)) not in media.sniff(value[:-1])


def test_false_magic_fails_its_validator():
    for magic in media.MAGIC.values():
        assert media.sniff(b"text " + magic + b" text that goes on for a while and holds nothing else at all") == []


def test_many_false_starts_are_looked_through_once():
    import time

    value = b"%PDF-1" * 20_000 + b"PK\x03\x04" * 20_000 + b"\xff\xd8\xff\xda" * 20_000
    began = time.process_time()
    assert media.sniff(value) == [] and time.process_time() - began < 10
    packed = __import__("gzip").compress(bytes(8 << 20))
    assert media.sniff(packed) == [("application/gzip", 0, len(packed))]


def test_stored_media_are_corrected_and_carved(spark):
    got = {r.doc_id: r for r in media.read_media(media.stored_media(table(spark, [(1, "GIF89a no"), (2, "%PDF-1.4 x %%EOF"), (3, None)]))).collect()}
    assert all(r.type == "audio/wav" and r.corrected for r in got.values())
    assert [got[i].n_embedded for i in (1, 2, 3)] == [0, 1, 0] and all(r.feature.startswith("type=audio/wav;mean=") for r in got.values())


def test_features_are_those_of_the_samples(spark, corpus):
    got = {r.doc_id: r.feature for r in media.read_media(media.stored_media(table(spark, corpus[:40]))).collect()}
    for i, t in corpus[:40]:
        raw = (t or "").encode()
        x = [*raw, *bytes(64 if not raw else -len(raw) % 64)]
        mean = sum(x) / len(x)
        std = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))
        entropy = -sum(c / len(x) * np.log2(c / len(x)) for c in Counter(x).values())
        want = f"type=audio/wav;mean={mean:.4f};std={std:.4f};min={min(x)};max={max(x)};zero_crossings={crossings};entropy={entropy:.4f};seconds={len(x) / media.RATE:.4f}"
        assert [p.split("=")[0] for p in got[i].split(";")] == [p.split("=")[0] for p in want.split(";")]
        assert all(a == b or abs(float(a.split("=")[1]) - float(b.split("=")[1])) < 2e-4 for a, b in zip(got[i].split(";"), want.split(";")))


def test_declared_types_are_corrected(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "image/jpeg"), (2, bytearray(b"plain"), "text/plain"), (3, None, None), (4, bytearray(b"aa" + GIF), "text/plain")], "id int, value binary, kind string")
    got = {r.id: r.media for r in media.sniff_column(df, "value", "kind").collect()}
    assert (got[1].type, got[1].corrected) == ("image/png", True) and not got[2].corrected and got[3].type is None
    assert [(e.type, e.start) for e in got[4].embedded] == [("image/gif", 2)] and got[4].type == "text/plain"


def test_attachments_are_sniffed_corrected_and_carved(spark, corpus):
    rows = [*corpus, (800, "GIF89a no"), (801, "%PDF-1.4 x %%EOF BM")]
    plain = {r.doc_id: r for r in media.read_media(media.stored_media(table(spark, rows))).collect()}
    got = {r.doc_id: r for r in media.described(table(spark, rows)).collect()}
    kinds, wrong, inside = Counter(), 0, 0
    for i, t in rows:
        r, samples = got[i], media.payload(t)
        declared, value = media.attachment(samples)
        bare = not value.startswith(b"Attached")
        kind = media.FORMS[zlib.crc32(samples) % 5]
        assert tuple(r)[: len(plain[i])] == tuple(plain[i])
        assert (r.carved_sha256, r.carved_type, r.attachment_declared) == (hashlib.sha256(samples).hexdigest(), kind, declared) and r.carved_sha256 == r.payload_sha256
        assert value[r.carved_start : r.carved_start + r.carved_length] == media.encoded(samples, kind) and (r.carved_start == 0) == bare
        assert r.attachment_type == (kind if bare else declared) and r.attachment_corrected == (bare and kind != declared)
        kinds[kind] += 1
        wrong += r.attachment_corrected
        inside += not bare
    assert set(kinds) == set(media.FORMS) and wrong > 20 and inside > 10


# 5 chat


def test_chat_round_trip(spark):
    ugly = [chat.EXTRA, "### user:\n", "</turn>\n", "\\", "\\\\#", "", None, "a:b\n\n", "日本 <b>", "\\<"]
    rows = [(i % 4 if i % 9 else None, i // 4, ["user", "assistant", "sys:\ntem", None][i % 4 if i % 5 else 1], ugly[i % len(ugly)]) for i in range(80)] + [(1, 3, "user", "tie"), (1, 3, "user", "tie"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, chat.CANONICAL).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(chat.canonical_rows(df))).collect()}
    convs = defaultdict(list)
    for c, n, role, t in rows:
        convs[c].append(((n is not None, n or 0), (role is not None, role or ""), (t is not None, t or "")))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.format_turn(a, b)[0]) for a, b in turns)
        assert chat.read_turns("".join(chat.format_turn(a, b)[0] for a, b in turns)) == turns


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant", "weight": 1}], "n": 3}, [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
        ({"output": "a", "instruction": "q"}, [("user", "q"), ("assistant", "a")]),
        ({"output": "a", "instruction": "s", "input": "q"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": {"x": 1}}, None),
        ({"other": 1}, None),
        ([1], None),
    ],
)
def test_layouts(spark, record, turns):
    assert chat.record_turns(record) == turns
    df = spark.createDataFrame([(4, json.dumps(record)), (5, "not json"), (6, None)], "id long, record string")
    assert [(r.role, r.text) for r in chat.canonical_json(df, "id", "record").orderBy("turn").collect()] == (turns or [])
    assert chat.unmatched(df, "record").count() == (2 if turns else 3)


def test_schema_layouts(spark):
    df = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(r) for r in chat.canonical_rows(df).orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_rows(spark.range(1))


# 6 urls


def test_url_rules(spark):
    cases = ["https://a.example.com/en/7x", "https://Example.COM/en/8", "http://x.example.net/de/8?q", "http://x.net/de/1", "http://fr.org/es/", "http://notcom/en/", None, "no scheme", "", "x://", "http://com/en/#y", "http://a.example.net:80/de/8"]
    pages = spark.createDataFrame([(i, u, "<p>cheap pills red house</p><script>x</script>" if i % 2 else None, 1) for i, u in enumerate([*cases, "http://cheappills.example.net/x", "http://redhouse.example.net/x"])], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert [got[i].rule for i in range(12)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", "org/es/", None, None, None, None, None, "com/en/", None]
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "block", "allow", "block"]
    assert (got[2].host, got[2].path) == ("x.example.net", "/de/8") and (got[6].host, got[6].path) == ("", "") and got[6].verdict == "allow"
    assert got[12].verdict == "block" and "pills" in got[12].words.split() and got[13].verdict == "allow" and {"red", "house"} <= set(got[13].words.split())
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_viterbi_takes_the_cheapest_split():
    pieces = [(0, 5, 3.0), (5, 5, 3.0), (0, 10, 7.0), (2, 3, 1.0)]
    assert urls.viterbi("cheappills", pieces, 9.0).words == ("cheap", "pills")
    assert urls.viterbi("zzz", [], 9.0).words == ("zzz",)
    assert urls.viterbi("", [], 9.0).words == ()


def test_naive_bayes_against_brute_force(spark):
    import math

    r = random.Random(12)
    vocabulary = ["red", "house", "cheap", "pills", "garden", "win", "news", "a", "sun"]
    hosts = ["".join(r.choice(vocabulary) for _ in range(r.randint(1, 3))) for _ in range(12)] + ["casino", "q" * 150]
    rows = []
    for i in range(120):
        h = r.choice(hosts)
        path = "/".join(r.choice([h, r.choice(vocabulary), "x9y", "news"]) for _ in range(r.randint(0, 4)))
        rows.append((i, f"http://{h}.example/{path}?cheap", f"<b>{' '.join(r.choice(vocabulary) for _ in range(20))}</b><style>win</style> example"))
    rows += [(500, None, None), (501, "no scheme", "red red"), (502, "http://", None)]
    got = {x.page_id: x for x in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    counts = Counter(w for _, _, t in rows for w in re.findall(r"[^\W\d_]+", re.sub(r"(?is)<style.*?</style>|<[^>]*>", " ", t or "").lower()))
    total = sum(counts.values())

    def split(name):
        pieces = [(s, k, math.log(total) - math.log(counts[name[s : s + k]])) for s in range(len(name)) for k in range(1, len(name) - s + 1) if name[s : s + k] in counts]
        return urls.viterbi(name, pieces, math.log(total)).words

    names = {i: re.findall(r"[^\W\d_]+", f"{got[i].host}/{got[i].path}".lower()) for i, _, _ in rows}
    words = {i: [w for n in ns for w in split(n)] for i, ns in names.items()}
    block = {i: any(w in urls.SEEDS for w in ws) for i, ws in words.items()}
    bad, good = Counter(), Counter()
    for i, ws in words.items():
        (bad if block[i] else good).update(ws)
    v = len(set(bad) | set(good))
    start = math.log((sum(block.values()) + 1) / (len(block) - sum(block.values()) + 1))
    for i, ws in words.items():
        want = start + sum(math.log((bad[w] + 1) / (sum(bad.values()) + v)) - math.log((good[w] + 1) / (sum(good.values()) + v)) for w in ws)
        assert math.isclose(got[i].score, want, abs_tol=1e-9), rows[i]
        if got[i].rule is None:
            assert got[i].verdict == ("block" if want > 0 and got[i].host else "allow")
    assert len({x.verdict for x in got.values()}) == 2 and any(len(ns) != len(set(ns)) for ns in names.values())


# 7 licenses


def test_license_scan(spark, corpus):
    r = random.Random(2)
    lead = prose(500, r)
    extra = ["The MIT License. mit-license", "GNU  General\nPublic license cc by", "gnu genaral public license", "Apache Licence", "emit license", "CC BY-NC 4.0", "cc byes", "all rights reserved", " ".join([lead, "mozila public license", prose(20, r)])]
    rows = [*corpus, *((1000 + i, t) for i, t in enumerate(extra))]
    got = {x.doc_id: x for x in licenses.scan_licenses(table(spark, rows)).collect()}
    for i, t in rows:
        w = own_words(t)
        places = [(s, lab) for p, lab in licenses.BASE.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        x = got[i]
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(places), ",".join(sorted({lab for _, lab in places})))
        assert (x.first_word, x.last_word) == (min((s for s, _ in places), default=None), max((s for s, _ in places), default=None))
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
    assert [got[1000 + i].labels for i in range(9)] == ["mit", "cc-by,gpl", "gpl", "apache", "mit", "cc-by,cc-by-nc", "", "proprietary", "mpl"]
    assert [(s.first_word, s.n_words, s.errors) for s in got[1008].spans] == [(len(own_words(lead)), 3, 1)]


def test_fuzzy_search_finds_all_that_a_plain_fuzzy_search_finds():
    import regex

    r = random.Random(8)
    for _ in range(300):
        phrase, label, k = r.choice([n for n in licenses.NOTICES if n[2]])
        p = list(phrase)
        for _ in range(r.randint(0, k)):
            j = r.randrange(1, len(p) - 1)
            r.choice([lambda: p.pop(j), lambda: p.insert(j, "q"), lambda: p.__setitem__(j, "q")])()
        text = f" {prose(5, r).lower()} {''.join(p)} {prose(5, r).lower()} "
        if regex.search(f"(?<= )(?:{phrase}){{e<={k}}}(?= )", text):
            assert label in {x[2] for x in licenses.fuzzy_places(text)}, text


# 8 mixing


def test_budgets_flow_as_water(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 10), ("d0", "de", "a", 50), ("d1", "en", "c", 5), ("d1", "fr", "c", 500)]
    weights = {"domain": {"d0": 3, "d1": 1}, "lang": {"en": 2}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, n_tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, weights, 1, (1, 2)).collect()}

    def fill(budget, kids):  # kids: name -> (supply, weight)
        out, left = {}, dict(kids)
        while left:
            total = sum(w for _, w in left.values())
            short = {k: s for k, (s, w) in left.items() if s * total <= budget * w}
            if not short:
                return out | {k: budget * w // total for k, (_, w) in left.items()}
            out |= short
            budget -= sum(short.values())
            left = {k: v for k, v in left.items() if k not in short}
        return out

    want = {}
    supply = lambda *p: sum(n for *q, n in leaves if tuple(q[: len(p)]) == p)
    kids = lambda *p: {q[len(p)] for *q, _ in leaves if tuple(q[: len(p)]) == p}
    weight = lambda level, k: weights.get(level, {}).get(k, 1)
    for d, b in fill(665 // 2, {k: (supply(k), weight("domain", k)) for k in kids()}).items():
        for lang, c in fill(b, {k: (supply(d, k), weight("lang", k)) for k in kids(d)}).items():
            for s, e in fill(c, {k: (supply(d, lang, k), 1) for k in kids(d, lang)}).items():
                want[d, lang, s] = e
    assert got == want


def test_weight_zero_switches_off(spark, corpus):
    docs = table(spark, corpus)
    weights = {**mixing.WEIGHTS, "source": {"src0": 0}, "lang": {"en": 0}, "domain": {"d1": 0}}
    out = mixing.mix(docs, weights=weights).collect()
    left = {(x.doc_id, x.n_tokens, x.checksum, x.lang, x.source) for x in mixing.mix(docs, share=(2, 1)).collect() if x.source != "src0" and x.lang != "en" and x.domain != "d1"}
    assert out and all(x.source != "src0" and x.lang != "en" and x.domain != "d1" for x in out)
    total = sum(x.n_tokens for x in mixing.mix(docs, share=(2, 1)).filter("epoch = 0").collect())
    assert sum(x.taken for x in out) == min(total * 7 // 10, 2 * sum(x[1] for x in left))
    assert mixing.mix(docs, weights={"domain": {f"d{i}": 0 for i in range(4)}}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={"lang": {"en": -1}})


def test_mix_takes_each_leafs_budget(spark, corpus):
    docs = table(spark, [*corpus, (3, corpus[3][1]), (None, "null id here")])
    out = mixing.mix(docs, ranges=8).collect()
    leaves = defaultdict(int)
    for r in {(x.doc_id, x.n_tokens, x.domain, x.lang, x.source, x.checksum) for x in mixing.mix(docs, share=(2, 1), ranges=4).filter("epoch = 0").collect()}:
        leaves[r[2:5]] += r[1]
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, n_tokens long")
    budget = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, mixing.WEIGHTS, mixing.EPOCHS, mixing.SHARE).collect()}
    taken = Counter()
    for r in out:
        taken[r.domain, r.lang, r.source] += r.taken
        assert 0 < r.taken <= r.n_tokens
    assert dict(taken) == {k: v for k, v in budget.items() if v}
    assert max(Counter((r.doc_id, r.checksum, r.epoch, r.source, r.lang) for r in out).values()) == 1
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs, ranges=8).collect()))
    assert sorted((str(r.doc_id), r.epoch, r.taken) for r in out) == sorted((str(r.doc_id), r.epoch, r.taken) for r in mixing.mix(docs, ranges=64).collect())
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() >= len(out)
    assert mixing.mix(docs.limit(0)).count() == 0


# 9 jaccard


def shingles(t, k=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def grouped(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("tile", [jaccard.TILE, 3])
def test_jaccard_groups(spark, corpus, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = [*corpus, (900, "A a A a a"), (901, "one TWO"), (902, "X")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table(spark, rows)).collect()}
    want = grouped(rows)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 20


def test_jaccard_edges(spark):
    t = prose(30)
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.similar_groups(table(spark, [(None, t), (4, t), (4, t), (9, t), (5, None), (6, "")])).collect())
    assert got == [("4", 4), ("4", 4), ("5", 5), ("6", 6), ("9", 4), ("None", None)]
    assert jaccard.similar_groups(table(spark, [(1, "x")]).limit(0)).count() == 0


def test_tree_join_loses_no_pair():
    g = np.random.default_rng(2)
    base = g.integers(0, 9, (30, jaccard.GROUPS))
    points = np.abs(np.repeat(base, 10, axis=0) + (g.random((300, jaccard.GROUPS)) < 0.05))
    order = np.argsort(points.sum(axis=1), kind="stable")
    points, sizes, parts = points[order], points[order].sum(axis=1), g.integers(0, 4, 300)
    found = {(int(i), int(j)) for a, b in jaccard.tree_join(points, sizes, parts) for i, j in zip(a, b)}
    both = lambda i, j: int(np.minimum(points[i], points[j]).sum())
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if parts[i] != parts[j] and 180 * both(i, j) >= 80 * (sizes[i] + sizes[j]) and 100 * sizes[i] >= 80 * sizes[j]}
    assert found == want and len(want) > 100


def test_cells_of_every_size_lose_no_pair():
    g = np.random.default_rng(4)
    rows = []
    for cell in range(60):
        for _ in range(int(g.choice([2, 3, 31, 32, 33, 150]))):
            rows.append((cell * 7, len(rows), g.integers(0, 5, jaccard.GROUPS), int(g.integers(0, 3))))
    base = g.integers(0, 5, jaccard.GROUPS)
    rows = sorted(((c, i, np.abs(base + (p == 4)), part) for c, i, p, part in rows), key=lambda r: (r[0], int(r[2].sum())))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([int(r[2].sum()) for r in rows]), pa.array([r[3] for r in rows]), pa.array([-1] * len(rows)), pa.array([0] * len(rows)), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int32()))],
        ["cell", "doc_id", "n", "part", "half", "place", "point"],
    )
    want = set()
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            (c, i, p, a), (d, j, q, b) = rows[x], rows[y]
            if c == d and a != b and 180 * int(np.minimum(p, q).sum()) >= 80 * int(p.sum() + q.sum()):
                want.add((min(i, j), max(i, j)))
    for step in (7, 40, 5000):
        parts = [batch.slice(k, step) for k in range(0, batch.num_rows, step)]
        got = {(i, j) for b in jaccard._cells(iter(parts)) for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        assert got == want and len(want) > 100


def test_counts_of_buckets_are_exact(spark, corpus):
    texts = table(spark, corpus + [(990 + i, t) for i, (_, t) in enumerate(corpus[:1] * 9)]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))  # nine more of one text
    want = np.zeros(1 << jaccard.BUCKETS, np.int32)
    for b in texts.toArrow().to_batches():
        np.add.at(want, jaccard._bucket(jaccard._sets(b, 1, 5)[0]), 1)
    assert np.array_equal(jaccard.shingle_counts(texts.repartition(5), 5), want) and want.max() > 8
    assert not jaccard.shingle_counts(texts.limit(0), 5).any()


def test_keys_and_their_places_lose_no_pair():
    """Similar sets share the keys that they must, whatever the counts, and each meeting passes the bound of places."""
    g = np.random.default_rng(6)
    counts = g.integers(0, 9, 1 << jaccard.BUCKETS).astype(np.int32)
    for _ in range(300):
        n = int(g.integers(1, 300))
        a = g.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[g.random(n) < 0.93], g.integers(0, 2**63, int(g.integers(0, 1 + n // 9)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        sizes = np.array([len(a), len(b)])
        keys, n_keys = jaccard._prefix(np.concatenate([a, b]), sizes, counts)
        p, q = keys[: n_keys[0]].tolist(), keys[n_keys[0] :].tolist()
        met = [(p.index(x), q.index(x)) for x in set(p) & set(q)]
        overlap = -(-80 * (len(a) + len(b)) // 180)
        assert len(met) >= max(1, overlap + 1 - -(-80 * max(len(a), len(b)) // 100))
        for x, y in met:
            assert jaccard._placed(sizes, np.array([x, y]), np.array([0]), np.array([1]))[0]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 200}


# 10 token files


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY)), public_tokenizers.path(token_files.VOCABULARY)


def test_token_files(spark, corpus, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 700)
    monkeypatch.setattr(token_files, "FILE_IDS", 4000)
    tk, path = tokenizer
    rows = [*corpus, (corpus[5][0], "repeat"), (None, "no id"), (-(2**63), "least id"), (77777, "a<|endoftext|>  b\n\n<|endoftext|> c"), (77778, "\x1c odd\x1f  white\u00a0space ²³ ")]
    r = random.Random(4)
    r.shuffle(rows)
    got = sorted(((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in token_files.tokens_of(table(spark, rows)).collect()))
    at, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.tokens_of(table(spark, [(1, "x")]).limit(0)).count() == 0


def test_encoder_memory_can_be_cleared(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBER", 1 << 19)
    tk, path = tokenizer
    texts = [prose(50) for _ in range(5)]
    encode = token_files.Encoder(path)
    for _ in range(3):
        assert [x.tolist() for x in encode(pa.array(texts))] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


ODD = ["", " ", "  a  b\n\n c\t d ²³ x² <|endoftext|> q", "a\n\n<|endoftext|>  z", "don't I'LL we've 12ab _x_ __ ñandú ÷×\u00ad\u00a0 x", "日本 語  x \x1c y", "a\r\n b \r c   ", "ab\u0301c è ١٢ x", "’s 's\u2009x", "\x85 a\x0b\x0cb", "a \n", "\n\n", "🙂 🙂🙂 x\u3000y", "it's 'tis x's9"]


def test_encoder_on_odd_texts(tokenizer):
    tk, path = tokenizer
    r = random.Random(6)
    texts = ODD + ["".join(r.choice(["a", " ", "\n", "'s", "'", "9", "é", "_", ",", "(", "¿", "\t", "\u00a0", "²", "語", "B"]) for _ in range(40)) for _ in range(400)]
    assert [x.tolist() for x in token_files.Encoder(path)(pa.array(texts))] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_that_hash_alike_are_told_apart(tokenizer, monkeypatch):
    tk, path = tokenizer
    encode = token_files.Encoder(path)
    monkeypatch.setattr(token_files, "digests", lambda buf, start, end: (end - start).astype(np.uint64))
    for t in ("abc", "xyz", "abc", "red", "abc xyz red fox abcd"):
        assert [x.tolist() for x in encode(pa.array([t]))] == [tk.encode(t, add_special_tokens=False).ids]


def opposed(n):
    """Two words of n letters whose sums of powers agree modulo 2**64 in any odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_a_sum_of_powers_takes_for_equal(spark, tokenizer, n):
    a, b = opposed(n)
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{lead} {a}"), (2, f"{lead} {b}"), (3, a), (4, b), (5, f"{b} {a}"), (6, f"{b} {a}")]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert got == substring_dedup.brute_force(rows) and got[2][1] == 0
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(table(spark, rows)).collect()} == grouped(rows)
    tk, path = tokenizer
    texts = [t for _, t in rows]
    assert [x.tolist() for x in token_files.Encoder(path)(pa.array(texts))] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_distinct_spans_are_compared_by_bytes(monkeypatch):
    g = random.Random(8)
    for alike in (False, True):
        if alike:
            monkeypatch.setattr(common, "quick", lambda buf, start, end: (end - start).astype(np.uint64))
        words = ["".join(g.choice("ab\0é") for _ in range(g.choice([0, 1, 3, 7, 8, 9, 17, 63, 64, 65, 200]))).encode() for _ in range(400)] * 2
        ends = np.cumsum([len(w) for w in words])
        starts = ends - np.array([len(w) for w in words])
        number, first = common.distinct(np.frombuffer(b"".join(words), np.uint8), starts, ends)
        assert len(first) == len(set(words)) and [words[first[i]] for i in number] == words
        assert (first == [words.index(words[i]) for i in first]).all()


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 20_000])
def test_blocks_are_exact_and_guarded(n):
    g = np.random.default_rng(n)
    ids = (g.zipf(1.3, n) % 50_257).astype(np.uint16)
    freq = token_files.normalised(np.bincount(ids, minlength=1 << 16))
    assert n == 0 or freq.sum() == 1 << token_files.SCALE and (freq[ids] > 0).all()
    assert np.array_equal(token_files.unpack_table(token_files.pack_table(freq)), freq)
    coder = token_files.Coder(freq)
    block = token_files.pack_block(np.array([5]), np.array([n]), ids, coder)
    assert np.array_equal(token_files.unpack_block(block, coder)[2], ids)
    if n > 600:
        broken = bytearray(block)
        broken[-3] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack_block(bytes(broken), coder)
        assert len(block) < 2 * n


# the pipeline, and the queries as registered


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    kept = corpus_pipeline.keep_quality(spark, docs, sf)
    assert kept.columns == docs.columns and 0.5 < kept.count() / docs.count() < 1
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, (_, c) in grouped(rows).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()} == want
    clean = corpus_pipeline.drop_leaks(spark, docs, sf)
    hits = decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert clean.columns == docs.columns and clean.count() + hits.count() == docs.count()
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 20


@pytest.fixture(scope="module")
def small_tables(spark, corpus, tmp_path_factory):
    """Two folders of tables: one with rows that are hard on operators, one with none."""
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    docs = table(spark, [*corpus, (corpus[2][0], corpus[2][1])])
    tables = {
        "documents": docs.select("doc_id", "text", "lang", "source", "n_chars"),
        "labels": spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(31, None, None)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, None, None), (2, "http://" + "z" * 5000 + ".x/" + "y" * 5000, "<b>z</b>"), (3, "https://a.example.com/en/7", "")], "page_id long, url string, html string"),
        "benchmark": spark.createDataFrame([(1, corpus[0][1]), (2, None), (3, "")], "item_id long, text string"),
        "conversations": spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x" * 300_000), (None, None, None, None)], "conv_id long, turn long, role string, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


@pytest.mark.parametrize("name", sorted(__import__("quillspark.llm.registry", fromlist=["QUERIES"]).QUERIES))
def test_registered_queries(spark, small_tables, name):
    from quillspark.llm import registry

    full, empty = small_tables
    key = {"op5_chat_format": "conv_id", "op6_url_filter": "page_id"}.get(name, "doc_id")
    rows, none = registry.QUERIES[name](spark, full), registry.QUERIES[name](spark, empty)
    assert rows.columns[0] == key and none.columns == rows.columns
    got = [r[0] for r in rows.collect()]
    source = {"conv_id": "conversations", "page_id": "pages"}.get(key, "documents")
    ids = [r[0] for r in spark.read.parquet(f"{full}/{source}.parquet").select(key).collect()]
    if name == "op5_chat_format":
        assert sorted(map(str, got)) == sorted(map(str, {*ids, -7}))
    elif name == "op8_source_mixing":
        assert set(got) <= set(ids) and got
    else:
        assert sorted(map(str, got)) == sorted(map(str, ids))
    assert none.count() == (1 if name == "op5_chat_format" else 0)


def test_pipeline_of_an_empty_table(spark, small_tables):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, small_tables[1]).count() == 0
    assert corpus_pipeline.run(spark, small_tables[0]).count() > 5


def test_sql_of_decontamination(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = decontaminate.op3_decontamination(spark, sf)
    out = con.execute(decontaminate.ORACLE_SQL)
    assert [c[0] for c in out.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(out.fetchall())


def test_trees_of_several_levels_leave_pairs_out():
    """Nodes above the leaves decide most pairs, and none that counts is lost."""
    g = np.random.default_rng(12)
    kinds = g.integers(0, 2, (25, jaccard.GROUPS)) * g.integers(1, 12, (25, 1))
    points = np.repeat(kinds, 20, axis=0) + (g.random((500, jaccard.GROUPS)) < 0.02)
    cell = np.repeat(np.arange(5), 100)
    order = np.lexsort((points.sum(axis=1), cell))
    points, cell = points[order], cell[order]
    sizes, parts = points.sum(axis=1), np.arange(500)
    levels = jaccard.forest(points, sizes, cell)
    assert len(levels) == 3 and len(levels[-1].n) == 5 and levels[0].n.sum() == 500
    before = list(jaccard.SEEN)
    found = {(int(i), int(j)) for a, b in jaccard.tree_join(points, sizes, parts, cell=cell) for i, j in zip(a, b)}
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if cell[i] == cell[j] and 180 * int(np.minimum(points[i], points[j]).sum()) >= 80 * int(sizes[i] + sizes[j])}
    assert found == want and len(want) > 100
    leaves, above, single = (x - y for x, y in zip(jaccard.SEEN, before, strict=True))
    assert above > 0 and 16 * leaves + 16 * jaccard.FAN**2 * above > 10 * single


def test_the_sample_has_one_row_an_id_and_a_bound_of_features(spark):
    docs = table(spark, [(i, f"good text {i} " * 3) for i in range(60)] + [(3, f"one of many rows {k}") for k in range(400)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    taken = []
    fit = quality.fit

    def spy(off, ids, x, y, **more):
        taken.append((len(y), len(ids)))
        return fit(off, ids, x, y, **more)

    quality.fit = spy
    try:
        quality.train(docs, labels)
        quality.train(docs, labels, most_features=100)
    finally:
        quality.fit = fit
    n = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60))
    assert taken[0][0] == n and 0 < taken[1][0] < n and taken[1][1] <= 100


def test_seeds_go_to_every_task_by_the_bytes_of_their_windows(spark, monkeypatch):
    long = " ".join(["common"] * 10 + [f"w{i}" for i in range(300)])
    docs, bench = table(spark, [(1, long), (2, "common " * 12)]), spark.createDataFrame([(1, long), (2, "common " * 10)], "item_id long, text string")
    got = []
    for most in (64 << 20, 100):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        got.append(sorted(map(tuple, decontaminate.contamination(docs, bench).collect())))
    assert got[0] == got[1] and len(got[0]) == 2


def test_long_names_are_split_whole(spark):
    counts = spark.createDataFrame([("summer", 50), ("school", 40), ("x" * 90, 3), ("a", 1)], "word string, n long")
    names = ["summerschool" * 12, "x" * 90 + "summer", "a" * 70]
    got = {r.name: r.words for r in urls.segment_names(spark.createDataFrame([(n,) for n in names], "name string"), counts).collect()}
    assert got[names[0]] == ["summer", "school"] * 12 and got[names[1]] == ["x" * 90, "summer"] and "".join(got[names[2]]) == names[2]
