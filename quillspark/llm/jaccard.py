"""Operator 9: exact n-gram Jaccard join by count vectors in R-trees.

A document's set holds the hashes of its word shingles. Equal sets are one class first. Shingles hash into GROUPS groups;
a set's counts per group are a point, and the sum of coordinate minima bounds the overlap of two sets (of two tree
nodes, with each node's largest counts). Points are only worth comparing when two sets can share a shingle among the
first n - ceil(0.8 n) + 1 of a common order, so these keys deal points into cells, each the root of an R-tree of its own.

The order puts rare shingles first. Their counts over all documents are kept in a table of 2**BUCKETS buckets, whose
size does not depend on the corpus: a shingle counts as its bucket does, ties go by hash. Any order gives all pairs;
this one keeps what many documents share (lines, passages) out of the cells, as soon as it stands out from the buckets'
mean, so cells stay small while documents and their sharing grow together.

Inside cells: first every set is compared with its cell's least id, which links each large group of near copies in
linear time; the components so found are then compared with each other only. Cells that still hold several components
are joined by their R-trees, whatever their size, node against node from the root down, under three bounds: sizes, summed
minima, and the places of the key in both orders. Similar sets share several keys, so sketches of the keys that sets have in
open cells bound how many a pair shares: pairs with too few are done, the others are handed on only where their first shared
key can be, and verified on whole sets. Large cells are split into tiles, so no task holds an unbounded one. No pair that
can be similar, no row and no cell is dropped.

Defined results: null and empty texts have no shingles and stand alone; texts of fewer words have one; a null doc_id has
a null component; rows that repeat a doc_id are one node and keep their own counts; ties take the least id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, chunks, drop, grams, lists, mix, table, words, written
from .components import components

SHINGLE = 5
GROUPS = 64
#: Similarity as a fraction: linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Log 2 of the number of buckets in which shingles are counted: 16 MB at any size of the corpus.
BUCKETS = 22
#: Parts in which tasks hand on their counts.
SLICES = 256
#: Points of a leaf and children of a node.
LEAF, FAN = 4, 8
#: Pairs of nodes that are looked at in one go.
STEP = 1 << 12
#: Bits of the sketch of a set's keys.
SKETCH = 1024
#: Most rows of a cell, or of a half of a tile, that one task joins at once.
TILE = 20_000


def _sets(b: pa.RecordBatch, column: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingle hashes of each text, in ascending order."""
    w = words(b.column(column), LOWER)
    g = grams(w.hash, k)
    n_words = np.diff(w.first)
    inside = w.row[: len(g)] == w.row[k - 1 :]
    g, row = g[inside], w.row[: len(inside)][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        whole = n_words[short].astype(np.uint64) * np.uint64(0x51ED2701)
        for j in range(k - 1):
            longer = np.flatnonzero(n_words[short] > j)
            whole[longer] = whole[longer] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[w.first[short[longer]] + j]
        whole = mix(whole)
        g, row = np.concatenate([g, whole]), np.concatenate([row, short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.bincount(row[new], minlength=b.num_rows)


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - BUCKETS)).astype(np.int64)


def _prefix(g: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each set and how many: the first n - ceil(n * PERCENT / 100) + 1 in the common order."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    g = g[np.argsort((row << 32) | counts[_bucket(g)], kind="stable")]  # hashes ascend already
    keys = np.where(sizes > 0, sizes - -(-sizes * PERCENT // 100) + 1, 0)
    first = np.cumsum(sizes) - sizes
    return g[np.arange(len(g)) - first[row] < keys[row]], keys


def _count(k: int):
    """Each task's counts of buckets, in compressed slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKETS, np.int32)
        for b in chunks(batches):
            g, _ = _sets(b, 1, k)
            np.add.at(counts, _bucket(g), 1)
        own = [(i, c) for i, c in enumerate(counts.reshape(SLICES, -1)) if c.any()]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for _, c in own], pa.binary())], ["slice", "counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that a task got; it holds SLICES of them at most."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held.setdefault(i, np.zeros((1 << BUCKETS) // SLICES, np.int64))
            held[i] += np.frombuffer(zlib.decompress(c.as_buffer()), np.int32)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.minimum(c, 2**31 - 1).astype(np.int32).tobytes() for c in held.values()], pa.binary())], ["slice", "counts"])


def shingle_counts(texts: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each bucket stand in the documents' sets; its size is fixed."""
    sums = texts.mapInArrow(_count(k), "slice int, counts binary").repartition("slice").mapInArrow(_add_up, "slice int, counts binary").toArrow()
    counts = np.zeros((SLICES, (1 << BUCKETS) // SLICES), np.int32)
    for i, c in zip(sums.column(0).to_pylist(), sums.column(1), strict=True):
        counts[i] = np.frombuffer(c.as_buffer(), np.int32)
    return counts.ravel()


def _points(k: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = common.value
        for b in chunks(batches):
            g, sizes = _sets(b, 1, k)
            row = np.repeat(np.arange(len(sizes)), sizes)
            keys, n_keys = _prefix(g, sizes, often)
            counts = np.bincount(row * GROUPS + (g % np.uint64(GROUPS)).astype(np.int64), minlength=len(sizes) * GROUPS)
            low, high = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            np.add.at(low, row, mix(g, 0x9FB21C651E98DF25))
            np.add.at(high, row, mix(g, 0xA24BAED4963EE407))
            cols = [pa.array(sizes, pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), lists(keys.view(np.int64), n_keys, pa.int64()), lists(counts.astype(np.int32), np.full(len(sizes), GROUPS), pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n", "low", "high", "keys", "point"])

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            g, sizes = _sets(b, 1, k)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary())], ["doc_id", "shingles"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])


@dataclass
class Level:
    """Nodes of one height in the trees of all cells: largest counts, least and greatest size, and the children first:first + n below."""

    top: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    n: np.ndarray


def _packed(cell: np.ndarray, fan: int) -> np.ndarray:
    """Where nodes start that hold up to `fan` neighbours of one cell each; equal cells stand together."""
    new = np.append(True, cell[1:] != cell[:-1])
    start = np.flatnonzero(new)
    within = np.arange(len(cell)) - np.repeat(start, np.diff(np.append(start, len(cell))))
    return np.flatnonzero(within % fan == 0)


def forest(points: np.ndarray, sizes: np.ndarray, cell: np.ndarray) -> list[Level]:
    """R-trees of all cells, bulk-loaded in the order of the rows, leaves first; the last level has one root for each cell."""
    levels: list[Level] = []
    top, low, high, fan = points, sizes, sizes, LEAF
    while True:
        at = _packed(cell, fan)
        n = np.diff(np.append(at, len(cell)))
        top, low, high, cell = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), cell[at]
        levels.append(Level(top, low, high, at, n))
        if (cell[1:] != cell[:-1]).all():
            return levels
        fan = FAN


def _may(top_a, low_a, high_a, top_b, low_b, high_b) -> np.ndarray:
    """Whether pairs (row by row) can reach the similarity: by sizes, then by the summed coordinate minima."""
    fits = (100 * high_a >= PERCENT * low_b) & (100 * high_b >= PERCENT * low_a)
    i = np.flatnonzero(fits)
    bound = np.minimum(top_a[i], top_b[i]).sum(axis=1)
    fits[i] = (100 + PERCENT) * bound >= PERCENT * (low_a[i] + low_b[i])
    return fits


def _placed(sizes: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs can reach the similarity with their cell's key at these places of their orders: they share at most the
    lesser number of what stands before it, the key, and the lesser number of what stands after it."""
    most = np.minimum(place[i], place[j]) + np.minimum(sizes[i] - place[i], sizes[j] - place[j])
    return (100 + PERCENT) * most >= PERCENT * (sizes[i] + sizes[j])


def tree_join(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, side: np.ndarray | None = None, cell: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of points of one cell and of different parts that the bounds let through; where sides are 0 or more, only
    pairs across them. Trees are walked level by level, node against node, all cells at once."""
    cell = np.zeros(len(sizes), np.int64) if cell is None else cell
    if not len(sizes):
        return
    levels = forest(points, sizes, cell)
    roots = np.arange(len(levels[-1].n))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        height, a, b = stack.pop()
        own = levels[height]
        for s in range(0, len(a), STEP):
            p, q = a[s : s + STEP], b[s : s + STEP]
            keep = _may(own.top[p], own.low[p], own.high[p], own.top[q], own.low[q], own.high[q])
            SEEN[height > 0] += len(p) - int(keep.sum())
            p, q = p[keep], q[keep]
            if not len(p):
                continue
            # every child of p against every child of q; a node against itself gives each pair once
            n = own.n[p] * own.n[q]
            pair = np.repeat(np.arange(len(p)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = own.first[p][pair] + k // own.n[q][pair], own.first[q][pair] + k % own.n[q][pair]
            once = (p != q)[pair] | ((i <= j) if height else (i < j))
            i, j = i[once], j[once]
            if height:
                stack.append((height - 1, i, j))
                continue
            other = parts[i] != parts[j]
            if side is not None:
                other &= (side[i] != side[j]) | (side[i] < 0)
            i, j = i[other], j[other]
            ok = _may(points[i], sizes[i], sizes[i], points[j], sizes[j], sizes[j])
            SEEN[2] += len(ok) - int(ok.sum())
            yield i[ok], j[ok]


#: Pairs of leaves, of nodes above them, and of points that the trees of this process have left out, for tests.
SEEN = [0, 0, 0]

#: For each bit of a sketch, the words of a mask of the bits below it.
_BELOW = np.packbits(np.tri(SKETCH, k=-1, dtype=bool), axis=1, bitorder="little").view("<u8")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of doc_id, keys: the bits of the keys, and how many keys there are beyond these bits."""
    for b in batches:
        keys = b.column(1)
        size = np.asarray(keys.value_lengths(), np.int64)
        bits = np.zeros((b.num_rows, SKETCH), bool)
        bits[np.repeat(np.arange(b.num_rows), size), np.asarray(keys.flatten()) & (SKETCH - 1)] = True
        packed = np.packbits(bits, axis=1, bitorder="little").view("<i8")
        sketch = lists(packed.ravel(), np.full(b.num_rows, packed.shape[1]), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), sketch, pa.array(size - bits.sum(axis=1), pa.int64())], ["doc_id", "sketch", "spare"])


def _first_shared(sizes: np.ndarray, sketch: np.ndarray, spare: np.ndarray, bit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the key of a pair's cell, at this bit, can be the first that the pair shares, if it shares as many as the similarity
    forces. What they share fills that many bits at least, less the keys that a set has beyond its bits. Other bits
    are common by chance, and below the first shared key's all are."""
    a, b = sizes[i], sizes[j]
    least = -(-PERCENT * (a + b) // (100 + PERCENT)) - -(-PERCENT * np.maximum(a, b) // 100) + 1
    common = sketch[i] & sketch[j]
    chance = np.bitwise_count(common).sum(axis=1, dtype=np.int64) + np.minimum(spare[i], spare[j]) - least
    return np.bitwise_count(common & _BELOW[bit[i]]).sum(axis=1, dtype=np.int64) <= chance


_PAIRS = "a long, b long"
_MET = "a long, b long, n_a long, n_b long"
#: The fewest keys that similar sets share. They have at least o = ceil(PERCENT (n_a + n_b) / (100 + PERCENT)) shingles in
#: common, so n - o of a set are not in the other one; the set whose keys end earlier in the order has k = n - ceil(n PERCENT
#: / 100) + 1 of them, and k - (n - o) of these are keys of both. The larger set gives the smaller number.
_LEAST_SHARED = f"({PERCENT} * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT} - ({PERCENT} * greatest(n_a, n_b) + 99) div 100 + 1"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and size: cell, doc_id, n, part, half, place, point; where the keys are known also sketch, spare and the
    bit of the cell's key. half is -1 in a cell that is one tile."""

    def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        cell, ids, n, part, half, place = (np.asarray(t.column(c)) for c in ("cell", "doc_id", "n", "part", "half", "place"))
        flat = lambda c: np.asarray((c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).flatten())
        points = flat(t.column("point")).reshape(len(ids), GROUPS)
        if sketched := "sketch" in t.column_names:
            sketch, spare, bit = flat(t.column("sketch")).view(np.uint64).reshape(len(ids), -1), np.asarray(t.column("spare")), np.asarray(t.column("bit"))
        for i, j in tree_join(points, n, part, half, cell):
            ok = _placed(n, place, i, j)
            i, j = i[ok], j[ok]
            if sketched:
                ok = _first_shared(n, sketch, spare, bit, i, j)
                i, j = i[ok], j[ok]
            if len(i):
                i, j = np.where(ids[i] <= ids[j], i, j), np.where(ids[i] <= ids[j], j, i)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[i], ids[j], n[i], n[j])], ["a", "b", "n_a", "n_b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cell = np.asarray(b.column(0))
        others = np.flatnonzero(cell != cell[-1])
        last = int(others[-1]) + 1 if len(others) else 0  # where the last cell, which may go on, begins
        if held and last == 0 and held[-1].column(0)[-1].as_py() == cell[-1]:
            held.append(b)  # one cell goes on through the whole batch
            continue
        held.append(b.slice(0, last))
        yield from joined(pa.Table.from_batches(held)) if sum(x.num_rows for x in held) else ()
        held = [b.slice(last)]
    if held:
        yield from joined(pa.Table.from_batches(held))


def _linked(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs whose whole sets are similar enough. Sets are made for the documents of these pairs only."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(texts.join(ids, "doc_id", "left_semi").mapInArrow(_set_rows(k), "doc_id long, shingles binary"), "sets")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, _PAIRS), "links")
    drop(pairs, sets)
    return links


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b, shared) that sizes and summed coordinate minima let through, if the hub leads half of the keys they must share."""
    p, q = (points.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("point").alias(f"p_{k}")) for k in ("a", "b"))
    bound = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return pairs.join(p, "a").join(q, "b").filter(100 * small >= PERCENT * large).filter((100 + PERCENT) * bound >= PERCENT * (F.col("n_a") + F.col("n_b"))).filter(f"2 * shared >= {_LEAST_SHARED}").select("a", "b").distinct()


def similar_groups(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    common = spark.sparkContext.broadcast(shingle_counts(texts, k))
    rows = written(texts.mapInArrow(_points(k, common), "doc_id long, n long, low long, high long, keys array<long>, point array<int>"), "points")

    marks = written(rows.select("doc_id", "n", "low", "high"), "marks")
    some = marks.filter("n > 0 and doc_id is not null")
    classes = written(some.groupBy("n", "low", "high").agg(F.min("doc_id").alias("first")), "classes")
    firsts = classes.select(F.col("first").alias("doc_id"))
    apart = rows.join(firsts, "doc_id", "left_semi").filter("n > 0")
    # the keys that several rows have go first, so only these rows' keys are shuffled again
    keyed = rows.select("doc_id", F.posexplode("keys").alias("place", "key"))
    # tables of their own: joined straight after its aggregate, the rows of a common key could not be split between tasks
    several = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "several")
    keyed = written(keyed.join(several, "key").join(firsts, "doc_id", "left_semi"), "keyed")
    met = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("hub")).filter("m > 1"), "met")
    cells = written(keyed.join(met, "key"), "cells")
    points = written(apart.select("doc_id", "n", "point").join(cells.select("doc_id").distinct(), "doc_id", "left_semi"), "cell_points")
    drop(rows, several, keyed, met)

    # a first pass that may leave links to the second: it only has to find most of each large group
    to_hub = cells.filter("hub <> doc_id").groupBy(F.col("hub").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    first = _linked(_bounded(to_hub, points), texts, k)
    part = components(first)

    placed = cells.join(part, cells["doc_id"] == part["id"], "left").select("key", "doc_id", "place", "m", F.coalesce("component", "doc_id").alias("part"))
    open_ = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("key")
    placed = written(placed.join(open_, "key", "left_semi"), "open_cells")
    sketches = placed.groupBy("doc_id").agg(F.collect_list("key").alias("keys")).mapInArrow(_sketches, "doc_id long, sketch array<long>, spare long")
    # a cell of more than TILE rows is cut into tiles; each pair of tiles is a cell of its own
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), tiles.cast("long")).cast("int")
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    half = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))  # halves of a pair of tiles; a tile alone has none
    half = F.when(tiles == 1, -1).otherwise(half)
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "doc_id", "place", "part", half.alias("half"), F.col("key").bitwiseAND(SKETCH - 1).alias("bit"))
    with_points = dealt.join(points, "doc_id").join(sketches, "doc_id")
    sorted_ = with_points.repartition("cell").sortWithinPartitions("cell", "n").select("cell", "doc_id", "n", "part", "half", "place", "point", "sketch", "spare", "bit")
    second = _linked(sorted_.mapInArrow(_cells, _MET).select("a", "b").distinct(), texts, k)
    whole = components(first.unionByName(second))
    drop(cells, points, placed, first, second)

    named = marks.join(classes, ["n", "low", "high"], "left")
    named = named.join(whole.withColumnRenamed("id", "first"), "first", "left")
    alone = F.col("first").isNull() | F.col("doc_id").isNull()
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "first")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT DISTINCT x AS v, x AS c FROM u UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) m ON m.v = d.doc_id
"""
