"""Operator 10: token ids in files of interleaved range-coded blocks.

Documents are tokenised in ascending doc_id order; each ends with END. A file is one range of ids, written by Spark as
rows of blocks, so it can lie in any store and a lost task is written again. All blocks of a file share one frequency
table (its own rows, one per file); every block is coded by a static range asymmetric numeral system in LANES interleaved
states, and starts from a checkpoint of its own: the final states, the number of words and the place of its first
token. Blocks decode in parallel and in any order. Two checksums guard each: of the coded bytes and of the ids.

Block (little endian): magic "QRB1", u32 documents, u64 ids, u32 lanes, u32 coded words, u32 crc of the coded part, u32
crc of the ids, then i64 doc_ids, u32 lengths (the top bit marks a missing id), u64 lane states, u32 words. Table: magic "QRT1", u32 symbols, then
compressed: u16 differences of the symbols and u32 frequencies, which sum to 2**SCALE.

Defined results: a null text is the end id alone; rows that repeat a doc_id stand next to each other, ordered by text;
a null doc_id comes before all others; an empty table gives no files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, chunks, digests, distinct, ranges, table, utf8, written

END = 2
SCALE = 20
LANES = 512
#: A block is closed when it has this many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Bytes of units and their ids that a worker remembers; beyond it, it starts anew.
REMEMBER = 96 << 20
#: Text that is cut into units at once.
CHUNK_BYTES = 2 << 20
VOCABULARY = "byte_bpe_50k.json"

_U = np.uint64
#: Bytes that white space beyond ASCII, and the separators 1C to 1F, have first.
_DOUBTFUL = np.zeros(256, bool)
_DOUBTFUL[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: In a block's lengths, marks a document without an id.
_NO_ID = 1 << 31


#: Classes of ASCII bytes that a byte-level vocabulary never puts in one piece side by side. The apostrophe is in neither.
_WORD, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[b for b in range(0x21, 0x7F) if not _WORD[b] and b != 0x27]] = True


class Units:
    """Ids of known units, by the units' hashes, with their bytes to tell apart units that hash alike. Arrays grow by doubling."""

    def __init__(self) -> None:
        self.hash, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hash
        self.n, self.n_ids, self.n_bytes = 0, 0, 0
        self.ids, self.raw = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.uint8)
        self.id_ends, self.raw_ends = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)  # ends[i]:ends[i + 1] are unit i's

    def size(self) -> int:
        return 16 * self.n + sum(x.nbytes for x in (self.ids, self.raw, self.id_ends, self.raw_ends))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the unit with each hash, or -1."""
        if not self.n:
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.hash, h), self.n - 1)
        return np.where(self.hash[i] == h, self.at[i], -1)

    def same(self, number: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether the units' bytes are those of the spans."""
        first, size = self.raw_ends[number], end - start
        if not np.array_equal(self.raw_ends[number + 1] - first, size):
            return False
        return np.array_equal(self.raw[ranges(first, size)], buf[ranges(start, size)])

    def add(self, h: np.ndarray, raw: np.ndarray, raw_sizes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        new = self.n + np.arange(len(h))
        order = np.argsort(np.concatenate([self.hash, h]), kind="stable")
        self.hash, self.at = np.concatenate([self.hash, h])[order], np.concatenate([self.at, new])[order]
        self.ids, self.raw = _room(self.ids, self.n_ids, ids), _room(self.raw, self.n_bytes, raw)
        self.id_ends = _room(self.id_ends, self.n + 1, self.n_ids + np.cumsum(sizes))
        self.raw_ends = _room(self.raw_ends, self.n + 1, self.n_bytes + np.cumsum(raw_sizes))
        self.n, self.n_ids, self.n_bytes = self.n + len(h), self.n_ids + len(ids), self.n_bytes + len(raw)


def _room(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """held with more written at n; a new array, twice as long, only when it is full."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.zeros(max(n, len(more)) + len(more), held.dtype)])
    held[n : n + len(more)] = more
    return held


class Encoder:
    """Ids of texts by the tokenizers library.

    A byte-level vocabulary starts a new piece at every run of white space and where ASCII letters or digits meet other
    printable ASCII (but for the apostrophe), so texts are cut there into units. Equal units are found by hash and compared; those that
    are not known yet go through the library together, parted by a special token, which nothing crosses. Texts with special
    tokens or white space beyond ASCII are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.parting = next(iter(added.items()), None)
        self.added = [t.encode() for t in added]
        # special tokens cut a text before white space is looked at; some characters are white space to the library alone
        self.direct = re.compile("|".join([*map(re.escape, added), "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"]))
        self.known = Units()

    def _encoded(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of units that stand end to end in raw."""
        ends = np.cumsum(sizes).tolist()
        units = [raw[a:b].decode() for a, b in zip([0, *ends], ends)]
        if self.parting is None:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            return np.array([x for own in ids for x in own], np.uint16), np.array([len(x) for x in ids])
        text, part = self.parting
        flat = []
        for i in range(0, len(units), 4096):
            flat += [part, *self.tokenizer.encode_batch_fast([text.join(units[i : i + 4096])], add_special_tokens=False)[0].ids]
        ids = np.array(flat, np.uint16)
        at = np.flatnonzero(ids == part)
        return ids[ids != part], np.diff(np.append(at, len(ids))) - 1

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each text) of texts without a cause to be encoded whole."""
        buf, off = utf8(texts)
        if not len(buf):
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        gap, word, mark = SPACES[buf], _WORD[buf], _MARK[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[0] = gap[0]
        cut[1:-1] = gap[1:] & ~gap[:-1] | word[1:] & mark[:-1] | mark[1:] & word[:-1]
        cut[off] = True
        at = np.flatnonzero(cut)  # each unit's start, and the end
        start, end = at[:-1], at[1:]
        inverse, first = distinct(buf, start, end)
        h = digests(buf, start[first], end[first])
        if self.known.size() > REMEMBER:
            self.known = Units()
        number = self.known.find(h)
        old = number >= 0
        if not old.all():
            fresh = first[~old]
            sizes = end[fresh] - start[fresh]
            raw = buf[ranges(start[fresh], sizes)]
            self.known.add(h[~old], raw, sizes, *self._encoded(raw.tobytes(), sizes))
            number = self.known.find(h)
        if not self.known.same(number, buf, start[first], end[first]):  # units that hash alike: these texts go without memory
            self.known = Units()
            ids = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate(ids), np.array([len(x) for x in ids])
        n_unit = (self.known.id_ends[number + 1] - self.known.id_ends[number])[inverse]
        ids = self.known.ids[ranges(self.known.id_ends[number][inverse], n_unit)]
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(n_unit, out=total[1:])
        return ids, np.diff(total[np.searchsorted(start, off)])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without END."""
        buf, off = utf8(texts)
        doubtful = np.flatnonzero(_DOUBTFUL[buf])
        rows = np.arange(len(texts)) if any(x in buf.tobytes() for x in self.added) else np.unique(np.searchsorted(off, doubtful, side="right") - 1)
        whole = [i for i in rows.tolist() if self.direct.search(texts[i].as_py() or "")]
        ids, sizes = self._cut(pc.if_else(pa.array(np.isin(np.arange(len(texts)), whole)), "", texts) if whole else texts)
        out = np.split(ids, np.cumsum(sizes)[:-1])
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint16)
        return out


@cache
def encoder(path: str) -> Encoder:
    """One encoder, and so one memory, for all tasks of a worker."""
    return Encoder(path)


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 for what occurs, in sum 2**SCALE."""
    seen = np.flatnonzero(counts)
    f = np.zeros(len(counts), np.int64)
    if not len(seen):
        return f
    f[seen] = np.maximum(1, counts[seen] * (1 << SCALE) // counts.sum())
    over = int(f.sum()) - (1 << SCALE)
    order = seen[np.argsort(-f[seen], kind="stable")]
    i = 0
    while over > 0:  # the commonest give back what rounding up took
        give = min(over, int(f[order[i]]) // 2)
        f[order[i]] -= give
        over -= give
        i += 1
    f[order[0]] -= over
    return f


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = np.zeros(len(freq), np.uint64)
        self.low[1:] = np.cumsum(self.freq)[:-1]
        self._slots = None

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(final lane states, words). Lane j codes ids j, j + LANES, ...; steps run backwards."""
        x = np.full(LANES, 1 << 31, np.uint64)
        words = []
        for at in range((len(ids) - 1) // LANES * LANES, -1, -LANES) if len(ids) else ():
            s = ids[at : at + LANES]
            f, c, y = self.freq[s], self.low[s], x[: len(s)]
            big = y >= f << _U(63 - SCALE)
            if big.any():
                words.append((y[big] & _U(0xFFFFFFFF)).astype(np.uint32))
                y[big] >>= _U(32)
            q = y // f
            x[: len(s)] = (q << _U(SCALE)) + (y - q * f) + c
        words.reverse()
        return x, np.concatenate(words) if words else np.zeros(0, np.uint32)

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        x, out, at = states.copy(), np.empty(n, np.uint16), 0
        for i in range(0, n, LANES):
            y = x[: min(LANES, n - i)]
            slot = y & _U((1 << SCALE) - 1)
            s = self._slots[slot.astype(np.int64)]
            out[i : i + len(s)] = s
            y[:] = self.freq[s] * (y >> _U(SCALE)) + slot - self.low[s]
            low = np.flatnonzero(y < _U(1 << 31))
            y[low] = (y[low] << _U(32)) | words[at : at + len(low)]
            at += len(low)
        if at != len(words):
            raise ValueError("a block has words left over")
        return out


_HEAD = struct.Struct("<4sIQIIII")


def pack_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, coder: Coder) -> bytes:
    states, words = coder.encode(ids)
    coded = states.tobytes() + words.tobytes()
    head = _HEAD.pack(b"QRB1", len(doc_ids), len(ids), LANES, len(words), zlib.crc32(coded), zlib.crc32(ids.tobytes()))
    return head + doc_ids.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + coded


def unpack_block(block: bytes, coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids), checked against both checksums."""
    magic, n_docs, n, lanes, n_words, crc, ids_crc = _HEAD.unpack_from(block)
    if magic != b"QRB1" or lanes != LANES:
        raise ValueError("not a block of this format")
    at = _HEAD.size
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    lengths = np.frombuffer(block, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    if zlib.crc32(block[at:]) != crc:
        raise ValueError("a block's coded bytes are damaged")
    ids = coder.decode(n, np.frombuffer(block, "<u8", lanes, at), np.frombuffer(block, "<u4", n_words, at + 8 * lanes))
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("a block's ids are damaged")
    return doc_ids, lengths, ids


def pack_table(freq: np.ndarray) -> bytes:
    seen = np.flatnonzero(freq)
    return struct.pack("<4sI", b"QRT1", len(seen)) + zlib.compress(np.diff(seen, prepend=0).astype("<u2").tobytes() + freq[seen].astype("<u4").tobytes())


def unpack_table(b: bytes) -> np.ndarray:
    magic, n = struct.unpack_from("<4sI", b)
    if magic != b"QRT1":
        raise ValueError("not a frequency table of this format")
    freq = np.zeros(1 << 16, np.int64)
    raw = zlib.decompress(b[8:])
    freq[np.cumsum(np.frombuffer(raw, "<u2", n))] = np.frombuffer(raw, "<u4", n, 2 * n)
    return freq


BLOCKS = "file int, block int, n_ids long, table binary, data binary"
#: Ids that a task gathers before it writes a file of blocks with their table.
FILE_IDS = 1 << 23


def _pack_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(path), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, ids, held, number
            counts = np.zeros(1 << 16, np.int64)
            for x in ids:
                counts += np.bincount(x, minlength=1 << 16)
            freq = normalised(counts)
            coder, shared = Coder(freq), pack_table(freq)
            lengths = np.array([len(x) for x in ids])
            group = np.cumsum(lengths) // BLOCK_IDS
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ids)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                joined = np.concatenate(ids[a:b])
                known = np.array([d is not None for d in docs[a:b]])
                data = pack_block(np.array([d or 0 for d in docs[a:b]], np.int64), lengths[a:b] | np.where(known, 0, _NO_ID), joined, coder)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([i], pa.int32()), pa.array([len(joined)], pa.int64()), pa.array([shared if i == 0 else None], pa.binary()), pa.array([data], pa.binary())], ["part", "block", "n_ids", "table", "data"])
            docs, ids, held, number = [], [], 0, number + 1

        for b in chunks(batches, most=CHUNK_BYTES):
            docs += b.column(0).to_pylist()
            ids += [np.append(x, np.uint16(END)) for x in encode(b.column(1))]
            held += sum(map(len, ids[-b.num_rows :]))
            if held >= FILE_IDS:
                yield from flush()
        if ids:
            yield from flush()

    return run


def write_tokens(docs: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Tokenise in doc_id order and write the files; returns them as read back: file, part, block, n_ids, table, data."""
    spark = docs.sparkSession
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    blocks = ordered.mapInArrow(_pack_rows(path), "part int, block int, n_ids long, table binary, data binary")
    return written(blocks.select(F.spark_partition_id().alias("file"), "*"), "tokens")


def _unpack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of start (ids before the block), table and data."""
    last, coder = None, None
    for b in batches:
        for start, shared, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if shared != last:
                last, coder = shared, Coder(unpack_table(shared))
            doc_ids, lengths, ids = unpack_block(data, coder)
            missing, lengths = lengths >= _NO_ID, lengths & (_NO_ID - 1)
            ends = np.cumsum(lengths, dtype=np.int64)
            wide = ids.astype("<u4")
            crcs = [zlib.crc32(wide[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            known = pa.array(doc_ids.astype(np.int64), mask=missing)
            yield pa.RecordBatch.from_arrays([known, pa.array(start + ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files; blocks are independent tasks' work."""
    per_file = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = per_file.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("before"))  # a row per file
    inside = F.sum("n_ids").over(W.partitionBy("file").orderBy("part", "block")) - F.col("n_ids")
    places = blocks.select("file", "part", "block", "n_ids").withColumn("inside", inside).join(before, "file")
    tables = blocks.filter("table is not null").select("file", "part", "table")
    known = places.select("file", "part", "block", (F.col("before") + F.col("inside")).alias("start")).join(tables, ["file", "part"])
    rows = blocks.select("file", "part", "block", "data").join(known, ["file", "part", "block"])
    return rows.select("start", "table", "data").mapInArrow(_unpack_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"), path)


def tokens_of(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table's tokens and describe what stands in the files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return read_tokens(write_tokens(docs, path))
