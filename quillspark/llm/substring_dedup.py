"""Operator 1: exact substring deduplication by relative Lempel-Ziv factors over an indexed corpus.

The corpus is its own reference. Every document is cut into blocks at content-defined anchors (the smallest
hash of six neighbouring words within each window), so that equal windows share an anchor and lie at the same
place of its block. The index of reference blocks is an ordinary aggregate that keeps the earliest place of each;
a block that stands earlier matches at once. Where one anchor stands in different blocks, a factor may start
or end inside them: the first occurrences of such blocks are checked window by window against an index of windows,
which settles the factor boundaries. Matches that go on in one source are carried on as far as the source goes, and
the parse then goes over a document from left to right: where no factor reaches, the next one starts; of those that
reach a place, the one that goes farthest is taken. A factor has at least a window's words; words under one go.

Defined results: a null text has no words; a text shorter than a window keeps all; rows with a null doc_id
are kept whole and are no source; rows that repeat a doc_id and its text count as one document; of different texts
with one doc_id, the one with the lesser checksum counts as the earlier. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, drop, grams, lists, mix, powers, table, words, written

WINDOW = 20
SEED_WORDS = 6


def _anchors(h: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the place of each one's anchor, and the hash at every place."""
    k = min(SEED_WORDS, window)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, k)
    span = window - k + 1
    best, width = np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(g[right] < g[left], right, left)
        width += step
    start = np.flatnonzero(row[:n] == row[window - 1 :])
    return start, best[start], g


def _blocks(w, window: int) -> tuple[np.ndarray, ...]:
    """Of each block of a chunk: text number, first window, number of windows, anchor hash, block hash."""
    start, at, g = _anchors(w.hash, w.row, window)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    new = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(w.row[start], prepend=-1))
    n = np.diff(np.append(new, len(start)))
    first = start[new]
    up, down = powers(len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * up[:-1], out=total[1:])
    shape = (n * window + at[new] - first).astype(np.uint64)
    block = mix((total[first + n + window - 1] - total[first]) * down[first] + shape * np.uint64(0x94D049BB133111EB))
    return w.row[first], first, n, g[at[new]].view(np.int64), block.view(np.int64)


def _block_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words(b.column(1))
            row, first, n, anchor, block = _blocks(w, window)
            sizes = np.bincount(row, minlength=b.num_rows)
            cols = [lists((first - w.first[row]).astype(np.int32), sizes, pa.int32()), lists(n.astype(np.int32), sizes, pa.int32()), lists(anchor, sizes, pa.int64()), lists(block, sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["doc_id", "text_key", "start", "n", "anchor", "block"])

    return run


def _window_rows(window: int):
    """Rows of doc_id, text, text_key and the starts of blocks to look into; out come those blocks' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = words(b.column(1))
            row, first, n, anchor, _ = _blocks(w, window)
            asked = b.column(3)
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(asked.offsets)))
            keep = np.isin(first, w.first[owner] + np.asarray(asked.flatten(), dtype=np.int64))
            first, n, anchor = first[keep], n[keep], anchor[keep]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = w.row[at]
            sizes = np.bincount(row, minlength=b.num_rows)
            cols = [lists((at - w.first[row]).astype(np.int32), sizes, pa.int32()), lists(np.repeat(anchor, n), sizes, pa.int64()), lists(grams(w.hash, window)[at].view(np.int64), sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["doc_id", "text_key", "start", "anchor", "window"])

    return run


DOC = ("doc_id", "text_key")


def _not_first(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows whose keys also stand earlier, with the earliest place of each.

    The index is a table of its own: joined straight after its aggregate, the rows of a common key could not be split."""
    place = F.struct(*DOC, "start")
    index = written(rows.groupBy(*keys).agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("n_all")).filter("n_all > 1").drop("n_all"), name)
    return rows.join(index, keys).filter(F.col("source") < place)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, hits): per document its runs of windows that also start earlier, with the earliest place of each run."""
    texts = _texts(docs).filter("doc_id is not null")
    blocks = written(texts.mapInArrow(_block_rows(window), "doc_id long, text_key long, start array<int>, n array<int>, anchor array<long>, block array<long>"), "blocks")
    each = blocks.select(*DOC, F.explode(F.arrays_zip("start", "n", "anchor", "block")).alias("b")).select(*DOC, "b.*")
    hit = F.struct("start", "n", F.col("source.doc_id").alias("source_doc"), F.col("source.start").alias("source_start"), F.col("source.text_key").alias("source_key")).alias("hit")
    copied = written(_not_first(each, ["anchor", "block"], "block_index").select(*DOC, hit), "copied")

    varied = written(each.groupBy("anchor").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("anchor"), "varied")
    inside = each.select(*DOC, "start", "anchor").join(varied, "anchor", "left_semi").select(*DOC, "start")
    known = copied.select(*DOC, F.col("hit.start").alias("start"))
    asked = inside.groupBy(*DOC).agg(F.collect_set("start").alias("inside")).join(known.groupBy(*DOC).agg(F.collect_set("start").alias("known")), list(DOC), "left")
    asked = asked.select(*DOC, F.when(F.col("known").isNull(), F.col("inside")).otherwise(F.array_except("inside", "known")).alias("asked")).filter("size(asked) > 0")
    windows = texts.join(asked, list(DOC)).select("doc_id", "text", "text_key", "asked")
    windows = written(windows.mapInArrow(_window_rows(window), "doc_id long, text_key long, start array<int>, anchor array<long>, window array<long>"), "windows")
    drop(blocks, varied)
    each = windows.select(*DOC, F.explode(F.arrays_zip("start", "anchor", "window")).alias("w")).select(*DOC, "w.*", F.lit(1).alias("n"))
    straddling = _not_first(each, ["anchor", "window"], "window_index").select(*DOC, hit)
    return copied.unionByName(straddling).groupBy(*DOC).agg(F.collect_set("hit").alias("hits"))


def parse(start: np.ndarray, n: np.ndarray, source_doc: np.ndarray, source_start: np.ndarray, source_key: np.ndarray | None = None, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, source_doc, source_start) from one document's matches.

    Matches are first carried on while their source goes on. At the first place without a factor the next one starts; while
    some reach the place where the last one ends, the one that goes farthest follows."""
    if not len(start):
        return []
    key = np.zeros(len(start), np.int64) if source_key is None else source_key
    order = np.argsort(start, kind="stable")
    start, n, source_doc, source_start, key = start[order], n[order], source_doc[order], source_start[order], key[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + n[:-1]) | (source_doc[1:] != source_doc[:-1]) | (key[1:] != key[:-1]) | (source_start[1:] - source_start[:-1] != n[:-1])
    at = np.flatnonzero(new)
    first, end = start[at], start[at] + np.add.reduceat(n, at) + window - 1
    out, i, reached = [], 0, -1
    while i < len(at):
        if first[i] > reached:  # nothing goes on here: the longest that starts first
            best = i
        else:
            best = -1
        j = i
        while j < len(at) and first[j] <= max(reached, first[i]):
            if end[j] > reached and (best < 0 or end[j] > end[best]):
                best = j
            j += 1
        if best >= 0 and end[best] > reached:
            out.append((int(first[best]), int(end[best] - first[best]), int(source_doc[at[best]]), int(source_start[at[best]])))
            reached = int(end[best])
        i = max(j, i + 1)
    return out


FACTORS = "array<struct<start:long,words:long,source_doc:long,source_start:long>>"


def _cut(window: int):
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "words", "source_doc", "source_start")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            out: list[tuple] = []
            for text, hits in zip(b.column(1), b.column(2), strict=True):
                own = (text.as_py() or "").encode().split()
                factors = []
                kept = own
                if hits.is_valid:
                    h = hits.values
                    factors = parse(*(np.asarray(h.field(i), dtype=np.int64) for i in range(5)), window)
                    keep = bytearray(b"\1") * len(own)
                    for s, n, _, _ in factors:
                        keep[s : s + n] = bytes(n)
                    kept = list(compress(own, keep))
                out.append((len(own), len(own) - len(kept), b" ".join(kept).decode(), [dict(zip(("start", "words", "source_doc", "source_start"), f, strict=True)) for f in factors]))
            n, gone, kept, factors = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, kind)], ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and the factors that were cut."""
    hits = repeated_windows(docs, window)
    return _texts(docs).join(hits, list(DOC), "left").select("doc_id", "text", "hits").mapInArrow(_cut(window), f"doc_id long, n_words long, n_removed long, kept string, factors {FACTORS}")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same digest by a dictionary of all windows, for tests."""
    seen: dict[tuple, tuple] = {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(split):
        for s in range(len(split[d]) - window + 1):
            seen.setdefault(tuple(split[d][s : s + window]), (d, s))
    out = {}
    for d, own in split.items():
        gone = set()
        for s in range(len(own) - window + 1):
            if seen[tuple(own[s : s + window])] < (d, s):
                gone.update(range(s, s + window))
        kept = [x for i, x in enumerate(own) if i not in gone]
        out[d] = (len(own), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(list_slice(w, s + 1, s + 20), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM dup) GROUP BY 1),
k AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM k) a
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(ps) AS p FROM gone) g WHERE g.doc_id = a.doc_id AND g.p = a.p) GROUP BY 1)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM k LEFT JOIN kept ON k.doc_id = kept.doc_id
"""
