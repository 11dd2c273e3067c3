"""Helpers shared by the corpus operators: word hashing on Arrow buffers, and tables in the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.shared import shared_dir

#: Most text that one round of array work holds; one longer document is still handled whole.
CHUNK_BYTES = 1 << 20

#: While a table is written: its shuffle files go when the job ends, and Arrow batches are short, as rows may be whole texts.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

_U = np.uint64
#: Base of the sums along short runs of word hashes, and its inverse, modulo 2**64.
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_powers = np.ones((2, 1), np.uint64)
#: Words are named by keyed digests; the key is any fixed one.
_KEY = b"words of a corpus"
#: Longest span, in bytes, whose quick hash is made for many spans at once.
_QUICK_BYTES = 64

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[0x41:0x5B] += 0x20
#: ASCII but for letters and digits.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        p = np.empty((2, max(n, CHUNK_BYTES + (1 << 17))), np.uint64)
        p[0], p[1] = _BASE, _INVERSE
        p[:, 0] = 1
        _powers = np.multiply.accumulate(p, axis=1)
    return _powers[:, :n]


def mix(h: np.ndarray, k: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(k)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


@dataclass
class Words:
    """The words of some texts: where each starts and ends in buf, its text's number, its hash; first[i]:first[i+1] are text i's.
    number[i] is word i's place among the distinct ones, and unique[n] a word that holds the nth of these."""

    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    number: np.ndarray
    unique: np.ndarray


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and each text's offset; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def quick(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for the bytes of each span, eight bytes at a time. It finds candidates for equality; it decides nothing."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    left = (end - start).astype(np.int64)
    h = left.astype(np.uint64) * _BASE
    live = np.flatnonzero(left <= _QUICK_BYTES)
    at = start[live]
    rest = left[live]
    while len(live):
        some = rest > 0
        live, at, rest = live[some], at[some], rest[some]
        low = eight[at] & _MASK[np.minimum(rest, 8)]
        h[live] = mix(h[live] ^ low)
        at, rest = at + 8, rest - 8
    for i in np.flatnonzero(left > _QUICK_BYTES).tolist():
        h[i] = np.frombuffer(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for size[i] numbers, end to end."""
    done = np.cumsum(size)
    return np.repeat(first - done + size, size) + np.arange(done[-1] if len(done) else 0)


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, first): the number of each span's bytes among the distinct ones, and a span that holds each of these.

    Spans that hash alike are compared byte by byte; where two differ, all are told apart by their bytes themselves."""
    number, names = pd.factorize(quick(buf, start, end))
    first = np.zeros(len(names), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    size = end - start
    as_first = first[number]
    other = np.flatnonzero(as_first != np.arange(len(number)))
    same = np.array_equal(size[other], size[as_first[other]]) and np.array_equal(buf[ranges(start[other], size[other])], buf[ranges(start[as_first[other]], size[other])])
    if not same:
        raw = buf.tobytes()
        number, names = pd.factorize(np.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], object))
        first = np.zeros(len(names), np.int64)
        first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return number, first


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a keyed digest of each span's bytes."""
    raw = buf.tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8, key=_KEY).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64)


def words(texts: pa.Array, fold: np.ndarray = IDENTITY, gaps: np.ndarray = SPACES) -> Words:
    """Split texts at the bytes in gaps; a word never crosses from one text to the next. Hashes see folded bytes."""
    buf, off = utf8(texts)
    n = len(buf)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~gaps[buf]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    inner = solid[1:-1]
    start = np.flatnonzero(inner & (~solid[:-2] | cut[:-1]))
    end = np.flatnonzero(inner & (~solid[2:] | cut[1:])) + 1
    folded = buf if fold is IDENTITY else fold[buf]
    number, unique = distinct(folded, start, end)
    h = digests(folded, start[unique], end[unique])[number]
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(buf, off, start, end, row, first, h, number, unique)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring hashes."""
    n = max(0, len(h) - k + 1)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = (g ^ (g >> _U(31))) * _U(0xC2B2AE3D27D4EB4F) + h[j : j + n]
    return mix(g)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a column's texts in each stay near `most` bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = utf8(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from end-to-end values and the length of each list."""
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.select("*").write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t._quill_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
