"""Operator 12: importance resampling towards a target, over an integer word dictionary.

Each task keeps a vocabulary of its own as it reads, and starts a new one (a new scope) beyond SCOPE_WORDS words or n-grams: texts are lists of
local numbers with counts. The dictionary gives each distinct word of all scopes, of documents and target alike, one integer id, so a scope's
n-grams become tuples of ids. Tuples are counted over all scopes; the bytes of each distinct tuple are put together from the
dictionary once, hashed once, and its bucket's gain goes back to every scope that has the tuple. So what is shuffled is a row for each
scope and distinct n-gram, not for each word of the corpus, and no text. Only the table of at most BUCKETS gains is broadcast.

Lists are cut into rows of at most PIECE values, so no row grows with a scope, a text or a task's input. Where a scope's rows need a value for each of
its numbers, the values go to its task packed in such lists and stand first there, and the rows stream past them: a task holds one scope's
values and one batch.

The gain of a bucket is the scaled log ratio of its smoothed shares in target and source; a document's weight sums the
gains over its n-grams. A Gumbel draw from seed and doc_id is added, and the highest scores are drawn without
replacement; ranks come from sorted ranges, so no task sees all rows.

Defined results: null texts and texts without words have no features and weight 0; rows that repeat a doc_id are scored and
ranked each, rows equal in score and id in any order, as they differ in nothing; a null doc_id draws as an empty one and comes
after all ids among equal scores; an empty target gives all buckets the share of a bucket without words; an empty table gives
an empty result; long texts are coded whole. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered

from .common import LOWER, MARKS, chunks, drop, lists, ranges, table, words, written
from .sharding import CRC_SQL, crc_sql

SEED = 2024
#: n-grams of LEAST to MOST words.
LEAST, MOST = 1, 1
BUCKETS = 10_000
SCALE = 1000
#: Documents of at least so many words are drawn from; so many of a hundred of them are drawn.
MIN_WORDS, PERCENT = 20, 10
#: Text that is coded at once; a longer document is one alone.
CHUNK_BYTES = 2 << 20
#: Words, or n-grams, of a scope, and bytes of its words; the text that is being coded may add to them.
SCOPE_WORDS, SCOPE_BYTES = 400_000, 32 << 20

#: Most values of a list in one row; Spark's reader holds some thousands of rows at once.
PIECE = 1 << 10

#: Rows of texts, in order of `at` and each text's last one marked; of words, and of n-grams with how often they occur, from number `at` on. Where
#: n-grams are single words, one row has both.
_CODED = "scope long, at long, words array<string>, grams array<array<int>>, totals array<long>, doc_id long, text_key long, n_words long, n_features long, gram array<int>, count array<int>, last boolean"
#: Values that a task holds before it sends them on, each scope's together.
HELD = 1 << 19
_TEXT = ["doc_id", "text_key", "n_words", "n_features"]


def _grams(number: np.ndarray, row: np.ndarray, least: int, most: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(tuples, gram, text): the distinct runs of least to most neighbouring numbers of one text; of each run, its tuple's place and its text."""
    tuples: list[tuple] = []
    grams, rows = [], []
    code, n = number.astype(np.int64), int(number.max(initial=-1)) + 1
    for k in range(1, most + 1):
        if k > 1:  # a run of k is a run of k - 1 and a number more
            code = pd.factorize(code[: max(0, len(number) - k + 1)] * n + number[k - 1 :])[0]
        at = np.flatnonzero(row[: len(code)] == row[k - 1 :]) if len(code) else np.zeros(0, np.int64)
        if k >= least and len(at):
            own, names = pd.factorize(code[at])
            first = np.zeros(len(names), np.int64)
            first[own[::-1]] = at[::-1]
            grams.append(own + len(tuples))
            rows.append(row[at])
            tuples += map(tuple, number[first[:, None] + np.arange(k)].tolist())
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return tuples, join(grams), join(rows)


class Scope:
    """Numbers of words and n-grams, in the order they were met, and how often each n-gram was."""

    def __init__(self, name: int):
        self.name, self.n_bytes, self.n_rows = name, 0, 0
        self.words: dict[bytes, int] = {}
        self.grams: dict[tuple, int] = {}
        self.totals = np.zeros(1 << 12, np.int64)

    def full(self, most: int, most_bytes: int) -> bool:
        return max(len(self.words), len(self.grams)) > most or self.n_bytes > most_bytes

    def add(self, tuples: list[tuple], totals: np.ndarray) -> np.ndarray:
        """The n-grams' numbers; their counts are added."""
        at = np.fromiter((self.grams.setdefault(t, len(self.grams)) for t in tuples), np.int64, len(tuples))
        if len(self.grams) > len(self.totals):
            self.totals = np.concatenate([self.totals, np.zeros(len(self.grams), np.int64)])
        self.totals[at] += totals
        return at

    def rows(self, single: bool, piece: int) -> Iterator[pa.RecordBatch]:
        """What the numbers stand for. single: n-grams are single words."""
        said = [w.decode() for w in self.words]
        totals = self.totals[: len(self.grams)]
        if single:
            yield self._rows(piece, words=pa.array([said[i] for (i,) in self.grams], pa.string()), totals=pa.array(totals))
        else:
            sizes = np.array([len(t) for t in self.grams], np.int64)
            yield self._rows(piece, words=pa.array(said, pa.string()))
            yield self._rows(piece, grams=lists(np.array([i for t in self.grams for i in t], np.int64), sizes, pa.int32()), totals=pa.array(totals))

    def _rows(self, piece: int, **cols: pa.Array) -> pa.RecordBatch:
        size, _ = _pieces(np.array([len(next(iter(cols.values())))]), piece)
        off = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return _coded_rows(len(size), scope=pa.array(np.full(len(size), self.name)), at=pa.array(np.arange(len(size)) * piece), **{k: pa.ListArray.from_arrays(off, v) for k, v in cols.items()})


def _pieces(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, last): lists of these sizes as pieces of at most so many values, an empty list as one: each piece's size, each list's last piece."""
    n = np.maximum(1, -(-sizes // most))
    last = np.cumsum(n) - 1
    size = np.full(int(n.sum()), most)
    size[last] = sizes - (n - 1) * most
    return size, last


_KINDS = {"words": pa.list_(pa.string()), "grams": pa.list_(pa.list_(pa.int32())), "totals": pa.list_(pa.int64()), "gram": pa.list_(pa.int32()), "count": pa.list_(pa.int32()), "last": pa.bool_()}


def _coded_rows(n: int, **cols: pa.Array) -> pa.RecordBatch:
    names = [c.split()[0] for c in _CODED.split(", ")]
    return pa.RecordBatch.from_arrays([cols[x] if x in cols else pa.nulls(n, _KINDS.get(x, pa.int64())) for x in names], names)


def _coded(least: int, most: int):
    chunk_bytes, limits, piece = CHUNK_BYTES, (SCOPE_WORDS, SCOPE_BYTES), PIECE  # as they are where the plan is made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = Scope(TaskContext.get().partitionId() << 33)
        for b in chunks(batches, most=chunk_bytes):
            w = words(b.column(1), LOWER, MARKS)
            raw, known = LOWER[w.buf].tobytes(), len(scope.words)
            own = [raw[x:y] for x, y in zip(w.start[w.unique].tolist(), w.end[w.unique].tolist(), strict=True)]
            local = np.fromiter((scope.words.setdefault(x, len(scope.words)) for x in own), np.int64, len(own))
            scope.n_bytes += int((w.end - w.start)[w.unique][local >= known].sum())
            tuples, gram, row = _grams(local[w.number] if len(own) else w.number, w.row, least, most)
            pair, count = np.unique(row * max(1, len(tuples)) + gram, return_counts=True)
            row, gram = np.divmod(pair, max(1, len(tuples)))
            gram = scope.add(tuples, np.bincount(gram, count, minlength=len(tuples)).astype(np.int64))[gram]
            features = np.bincount(row, count, minlength=b.num_rows).astype(np.int64)
            size, last = _pieces(np.bincount(row, minlength=b.num_rows), piece)
            text = np.repeat(np.arange(b.num_rows), np.diff(last, prepend=-1))
            yield _coded_rows(
                len(size), scope=pa.array(np.full(len(size), scope.name)), at=pa.array(np.arange(len(size)) + scope.n_rows),
                doc_id=b.column(0).take(pa.array(text)), text_key=b.column(2).take(pa.array(text)), n_words=pa.array(np.diff(w.first)[text]), n_features=pa.array(features[text]),
                gram=lists(gram, size, pa.int32()), count=lists(count, size, pa.int32()), last=pa.array(np.isin(np.arange(len(size)), last)),
            )
            scope.n_rows += len(size)
            if scope.full(*limits):
                yield from scope.rows(most == 1, piece)
                scope = Scope(scope.name + 1)
        if scope.words:
            yield from scope.rows(most == 1, piece)

    return run


def coded(texts: DataFrame, least: int, most: int, name: str) -> DataFrame:
    """Texts (doc_id, text) as counts of numbered n-grams, and what the numbers of each scope stand for."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return written(rows.mapInArrow(_coded(least, most), _CODED), name)


def dictionary(*coded_texts: DataFrame) -> DataFrame:
    """(word, id): every distinct word once, with an integer of its own."""
    each = [c.filter("words is not null").select(F.explode("words").alias("word")) for c in coded_texts]
    both = each[0]
    for more in each[1:]:
        both = both.unionByName(more)
    return written(both.distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")


def _packed(piece: int, held: int):
    """Rows of scope, at, value as few rows with lists of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            parts.append([c.to_numpy() for c in b.columns])
            n += b.num_rows
            if n >= held:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    def packed(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        scope, at, value = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(scope, kind="stable")
        names, sizes = np.unique(scope, return_counts=True)
        size, last = _pieces(sizes, piece)
        cols = [np.repeat(names, np.diff(last, prepend=-1)), np.full(len(size), -1)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), lists(at[order], size, pa.int32()), lists(value[order], size, pa.int64())], ["scope", "at", "places", "values"])

    return run


def _beside(values: DataFrame, rows: DataFrame) -> DataFrame:
    """values (scope, at, value) and rows (scope, at, row), each scope's in one task, its values first, then its rows in order."""
    both = values.select("scope", "at", "value").mapInArrow(_packed(PIECE, HELD), "scope long, at long, places array<int>, values array<long>")
    return both.unionByName(rows, allowMissingColumns=True).repartition("scope").sortWithinPartitions("scope", "at")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(scope, values, at, rows): rows of one scope, as they come, with all values of it by place."""
    scope, parts, values = None, [], np.zeros(0, np.int64)
    for b in batches:
        names, at = b.column(0).to_numpy(), b.column(1).to_numpy()
        # a cut before each new scope and before its rows
        cuts = np.flatnonzero((np.diff(names, prepend=names[:1]) != 0) | (np.diff(at < 0, prepend=at[:1] < 0) != 0)).tolist()
        for x, y in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if x == y:
                continue
            if names[x] != scope:
                scope, parts, values = int(names[x]), [], np.zeros(0, np.int64)
            if at[x] < 0:
                parts.append([c.slice(x, y - x).flatten().to_numpy() for c in b.columns[2:4]])
                continue
            if parts:
                place, value = map(np.concatenate, zip(*parts, strict=True))
                values, parts = np.zeros(len(place), np.int64), []
                values[place] = value
            yield scope, values, at[x:y], pa.RecordBatch.from_struct_array(b.column(4).slice(x, y - x))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of grams and totals beside the ids of their scope's words: a row for each n-gram, as ids."""
    for scope, ids, at, rows in _met(batches):
        size, gram = rows["grams"].value_lengths().to_numpy(), rows["grams"].flatten()
        named = lists(ids[gram.flatten().to_numpy()], gram.value_lengths().to_numpy(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), scope)), pa.array(ranges(at, size)), named, rows["totals"].flatten()], ["scope", "at", "gram", "n"])


def id_tuples(coded_texts: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(scope, at, gram, n): every scope's distinct n-grams as tuples of dictionary ids, with their counts in it."""
    named = coded_texts.filter("words is not null")
    if most == 1:  # a tuple of one id is there as soon as its word has met the dictionary
        said = named.select("scope", "at", F.posexplode(F.arrays_zip("words", "totals")).alias("i", "x")).select("scope", (F.col("at") + F.col("i")).alias("at"), F.col("x.words").alias("word"), F.col("x.totals").alias("n"))
        return said.join(known, "word").select("scope", "at", F.array("id").alias("gram"), "n")
    places = named.select("scope", "at", F.posexplode("words").alias("i", "word")).join(known, "word").select("scope", (F.col("at") + F.col("i")).alias("at"), F.col("id").alias("value"))
    rows = coded_texts.filter("grams is not null").select("scope", "at", F.struct("grams", "totals").alias("row"))
    return _beside(places, rows).mapInArrow(_named, "scope long, at long, gram array<long>, n long")


def hashed_tuples(tuples: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """tuples of distinct gram. With `bucket`: the CRC-32 of the words that it stands for, joined by a space, modulo buckets."""
    said = tuples.select("gram", F.posexplode("gram").alias("at", "id")).join(known, "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    bucket = said.groupBy("gram").agg(phrase.alias("phrase")).select("gram", (F.crc32(F.col("phrase").cast("binary")) % buckets).alias("bucket"))
    return tuples.join(bucket, "gram")


def gain(s: Column, t: Column, all_s: Column, all_t: Column, buckets: int) -> Column:
    s, t, all_s, all_t = (c.cast("double") for c in (s, t, all_s, all_t))
    return F.floor(SCALE * F.ln((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).cast("long")


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts beside the gains of their scope: a row for each text. What the rows of a text give is carried on to its last one."""
    carried = 0
    for _, gains, _, rows in _met(batches):
        gram, count, size = rows["gram"].flatten().to_numpy(), rows["count"].flatten().to_numpy(), rows["gram"].value_lengths().to_numpy()
        so_far = np.concatenate([[0], np.cumsum(gains[gram] * count)]).astype(np.int64)[np.cumsum(size, dtype=np.int64)] + carried
        last = np.flatnonzero(rows["last"].to_numpy(zero_copy_only=False))
        done = so_far[last]
        carried = int(so_far[-1]) - (int(done[-1]) if len(done) else 0)
        yield pa.RecordBatch.from_arrays([*(rows[c].take(pa.array(last)) for c in _TEXT), pa.array(np.diff(done, prepend=0))], [*_TEXT, "weight"])


def weights(docs: DataFrame, target: DataFrame, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text_key, n_words, n_features, weight) of every document; target: a table with `text`."""
    own = coded(docs, least, most, "coded")
    wanted = coded(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), least, most, "coded_target")
    known = dictionary(own, wanted)
    grams = written(id_tuples(own, known, most), "id_tuples")
    counts = grams.select("gram", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(id_tuples(wanted, known, most).select("gram", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    features = written(hashed_tuples(counts.groupBy("gram").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), known, buckets), "features")
    per_bucket = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = features.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    gains = per_bucket.crossJoin(F.broadcast(totals)).select("bucket", gain(F.col("s"), F.col("t"), F.col("all_s"), F.col("all_t"), buckets).alias("gain"))
    worth = features.filter("s > 0").join(F.broadcast(gains), "bucket").select("gram", F.col("gain").alias("value"))
    texts = own.filter("gram is not null").select("scope", "at", F.struct(*_TEXT, "gram", "count", "last").alias("row"))
    rows = _beside(grams.select("scope", "at", "gram").join(worth, "gram"), texts)
    out = written(rows.mapInArrow(_weighed, ", ".join(f"{c} long" for c in [*_TEXT, "weight"])), "weights")
    drop(own, wanted, known, grams, features)
    return out


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """With `score`: weight and a scaled Gumbel draw."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-SCALE * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long"))


def ranked(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """With `score` and `rank`, from 1: of the documents with enough words the drawn ones; null for all others."""
    short = F.when(F.col("n_words") >= min_words, 0).otherwise(1)
    order = [short, -F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("weight"), F.monotonically_increasing_id()]
    placed = numbered(scored(weighed, seed), order, "rank")
    n = placed.agg((F.sum(1 - short) * percent / 100).cast("long").alias("_drawn"))  # one row
    rank = F.when((F.col("n_words") >= min_words) & (F.col("rank") <= F.col("_drawn")), F.col("rank").cast("long"))
    return placed.crossJoin(F.broadcast(n)).withColumn("rank", rank).drop("_drawn")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The drawn rows of docs, whole; a row that repeats a drawn one's id and text goes with it."""
    taken = ranked(weights(docs, target), percent).filter("rank is not null").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(taken, docs["doc_id"].eqNullSafe(taken["_id"]) & (key == taken["_key"]), "left_semi")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = weights(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return ranked(weighed).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH {CRC_SQL.strip()},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY 1, 2),
tw AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM benchmark) GROUP BY 1),
v AS (SELECT word, {crc_sql('word')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM dw UNION SELECT word FROM tw), crc_table),
b AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT bucket, n AS s, 0 AS t FROM dw JOIN v USING (word) UNION ALL SELECT bucket, 0, n FROM tw JOIN v USING (word)) GROUP BY 1),
g AS (SELECT bucket, CAST(floor({SCALE} * ln((CAST(t AS DOUBLE) + 1) * ((SELECT sum(s) FROM b) + {BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * ((SELECT sum(t) FROM b) + {BUCKETS})))) AS BIGINT) AS gain FROM b),
x AS (SELECT r, sum(n * gain) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
y AS (SELECT d.doc_id, len(w) AS n, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-{SCALE} * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
      FROM d LEFT JOIN x ON x.r = d.r),
z AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN n >= {MIN_WORDS} THEN 0 ELSE 1 END, score DESC, doc_id NULLS LAST) AS place, sum(CASE WHEN n >= {MIN_WORDS} THEN 1 ELSE 0 END) OVER () AS many FROM y)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n >= {MIN_WORDS} AND place <= {PERCENT} * many // 100 THEN CAST(place AS BIGINT) END AS rank
FROM z
"""
