"""Operator 2: a factorisation machine that scores the quality of whole texts.

A text's features are its hashed words (weighted by the logarithm of their counts), statistics of its structure
in bins, and one piece of metadata, the declared length in a bin. Pairwise interactions have low rank; a score takes
linear time by the sum-of-squares identity: sum over factors of ((sum v x)^2 - sum v^2 x^2) / 2.

The model is fitted on at most SAMPLE labelled rows, picked by a hash of their ids; held-out rows (crc32 of the id
as text, modulo 3, is 1) are never learnt from. Scoring covers every row and every word.

Defined results: null and empty texts get the score of an empty text; a null doc_id is scored and not held out;
repeated rows are scored alike; with no labelled rows at all every score is 0.5; a missing or null n_chars has a
bin of its own. Labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, drop, lists, table, words, written

#: Most labelled rows that a fit takes.
SAMPLE = 12_000
#: Most features, of eight bytes each, that all of these rows have together.
SAMPLE_FEATURES = 8_000_000
WORD_BINS = 1 << 16
STAT_BINS = 16
STATS = ("upper", "punctuation", "digits", "newlines", "non_ascii", "word_length", "distinct_words", "repeated_next", "symbol_ends", "length", "n_chars", "commonest")
WIDTH = WORD_BINS + STAT_BINS * len(STATS)
RANK = 8

_CLASS = np.zeros(256, np.uint8)
_CLASS[0x41:0x5B] = 1
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x0A] = 4
_CLASS[0x80:] = 5


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, feature numbers, values) of some texts; linear in their length."""
    n = len(texts)
    w = words(texts)
    bins = (w.hash >> np.uint64(48)).astype(np.int64) & (WORD_BINS - 1)
    key, counts = np.unique(w.row * WORD_BINS + bins, return_counts=True)
    row, bin_ = key // WORD_BINS, key % WORD_BINS
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value /= np.maximum(norm[row], 1e-9)

    size = np.maximum(np.diff(w.off), 1)
    kind = np.repeat(np.arange(n) * 6, np.diff(w.off)) + _CLASS[w.buf]
    share = np.bincount(kind, minlength=6 * n).reshape(n, 6) / size[:, None]
    n_words = np.maximum(np.diff(w.first), 1)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    symbol = _CLASS[w.buf[w.end - 1]] == 2
    most = np.zeros(n)
    np.maximum.at(most, row, counts)
    declared = np.where(np.isnan(n_chars), -1, n_chars)
    stats = np.stack(
        [
            np.sqrt(share[:, 1]) * STAT_BINS,
            np.sqrt(share[:, 2]) * STAT_BINS,
            np.sqrt(share[:, 3]) * STAT_BINS,
            np.sqrt(share[:, 4]) * 2 * STAT_BINS,
            share[:, 5] * STAT_BINS,
            np.bincount(w.row, w.end - w.start, minlength=n) / n_words,
            np.bincount(row, minlength=n) / n_words * (STAT_BINS - 1),
            np.sqrt(np.bincount(w.row, same, minlength=n) / n_words) * STAT_BINS,
            np.bincount(w.row, symbol, minlength=n) / n_words * (STAT_BINS - 1),
            np.log2(n_words),
            np.where(declared < 0, STAT_BINS - 1, np.minimum(np.log2(declared.clip(0) + 1), STAT_BINS - 2)),
            np.sqrt(most / n_words) * STAT_BINS,
        ],
        axis=1,
    )
    stat = WORD_BINS + np.arange(len(STATS)) * STAT_BINS + np.clip(stats, 0, STAT_BINS - 1).astype(np.int64)
    rows = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
    ids = np.concatenate([bin_, stat.ravel()])
    values = np.concatenate([value, np.full(stat.size, 0.5)])
    order = np.argsort(rows, kind="stable")
    off = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=n), out=off[1:])
    return off, ids[order], values[order].astype(np.float32)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, off: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = off[:-1]
        v = self.factors[ids] * x[:, None]
        return self.bias + np.add.reduceat(self.linear[ids] * x, at) + 0.5 * (np.add.reduceat(v, at, axis=0) ** 2 - np.add.reduceat(v * v, at, axis=0)).sum(axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(off: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """Adaptive gradient steps over small batches; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.5
    model = Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32))
    seen, seen_v, seen_0 = np.full(WIDTH, 1e-4, np.float32), np.full((WIDTH, RANK), 1e-4, np.float32), 1e-4
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            take = order[i : i + batch]
            n = off[take + 1] - off[take]
            at = np.cumsum(n) - n
            nz = np.repeat(off[take] - at, n) + np.arange(n.sum())
            f, v = ids[nz], x[nz]
            own = np.repeat(np.arange(len(take)), n)
            part = model.factors[f] * v[:, None]
            total = np.add.reduceat(part, at, axis=0)
            z = model.bias + np.add.reduceat(model.linear[f] * v, at) + 0.5 * (total**2 - np.add.reduceat(part * part, at, axis=0)).sum(axis=1)
            g = (_sigmoid(z) - y[take]).astype(np.float32)
            gx = g[own] * v
            uniq, inv = np.unique(f, return_inverse=True)
            g1 = np.bincount(inv, gx, minlength=len(uniq)).astype(np.float32)
            full = gx[:, None] * (total[own] - part)
            g2 = np.stack([np.bincount(inv, full[:, k], minlength=len(uniq)) for k in range(RANK)], axis=1).astype(np.float32)
            g1 += decay * model.linear[uniq]
            g2 += decay * model.factors[uniq]
            seen[uniq] += g1 * g1
            seen_v[uniq] += g2 * g2
            model.linear[uniq] -= rate * g1 / np.sqrt(seen[uniq])
            model.factors[uniq] -= rate * g2 / np.sqrt(seen_v[uniq])
            seen_0 += float(g.sum()) ** 2
            model.bias -= rate * float(g.sum()) / seen_0**0.5
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _plain(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), n_chars.alias("n_chars"))


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(float("nan")), dtype=np.float64)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        off, ids, x = features(b.column(1), _numbers(b.column(2)))
        n = np.diff(off)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), lists(ids.astype(np.int32), n, pa.int32()), lists(x, n, pa.float32())], ["doc_id", "quality", "ids", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES) -> Model:
    """Fit on at most `sample` labelled rows that are not held out, the ones with the smallest hashes of their ids, one row an id (of
    several the text with the smallest hash), and of these on as many, in the same order, as have `most_features` features together."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    of_id = docs.select("doc_id").schema[0].simpleString().replace(":", " ")
    labelled = _plain(docs).join(F.broadcast(known), "doc_id")
    one = labelled.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n_chars", "quality")).alias("r")).select("doc_id", "r.text", "r.n_chars", "r.quality")
    rows = written(one.mapInArrow(_feature_rows, f"{of_id}, quality int, ids array<int>, x array<float>"), "features")
    so_far = F.sum(F.size("ids")).over(W.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id"))  # over `sample` rows at most
    kept = rows.select("doc_id", "ids").withColumn("so_far", so_far).filter(F.col("so_far") <= most_features).select("doc_id")
    found = rows.join(F.broadcast(kept), "doc_id", "left_semi").toArrow()
    drop(rows)
    rows = found.sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return Model(0.0, np.zeros(WIDTH, np.float32), np.zeros((WIDTH, RANK), np.float32))
    ids, x = (rows.column(k).combine_chunks() for k in ("ids", "x"))
    if isinstance(ids, pa.ChunkedArray):
        ids, x = ids.chunk(0), x.chunk(0)
    off = np.asarray(ids.offsets, dtype=np.int64)
    return fit(off - off[0], np.asarray(ids.flatten(), dtype=np.int64), np.asarray(x.flatten()), np.asarray(rows.column("quality"), dtype=np.float64))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in chunks(batches):
            score = _sigmoid(m.logits(*features(b.column(1), _numbers(b.column(2)))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3, b.num_columns)), pa.array(score)], [*b.schema.names[3:], "quality_score"])

    return run


def score_quality(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all by default) and quality_score; one pass, the fixed-size model (WIDTH x (RANK + 1) floats) goes to each task."""
    base = docs.drop("quality_score")
    kept = base.select(*keep) if keep else base
    n_chars = F.col("n_chars").cast("double") if "n_chars" in base.columns else F.lit(None).cast("double")
    rows = base.select(F.lit(0).alias("_0"), F.coalesce(F.col("text"), F.lit("")).alias("text"), n_chars.alias("_n"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(kept.columns)))
    schema = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema)) + ", quality_score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_score(shared), schema)
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept.columns)), "quality_score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score_quality(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
