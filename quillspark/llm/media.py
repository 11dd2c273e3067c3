"""Operator 4: media columns. Signature sniffing with carving, and texts stored as 8-bit sound.

sniff() finds magic bytes with an Aho-Corasick automaton over the whole value, confirms each candidate with its
format's validator (structure and stated length), names the type that the leading bytes prove, and lists every
confirmed piece of embedded media with its place and length. A false magic number fails its validator.

stored_media() stores a payload as the samples of an 8-bit mono sound file; read_media() sniffs the stored bytes back, carves
the samples out and computes features from them. described() does so, too, with an attachment of each text: a sound, picture or archive
that holds the payload, bare or inside a letter, and mostly declared as something else.

Defined results: null and empty payloads become 64 zero bytes in op4; null values sniff as type null with nothing
embedded; values that match no format keep their declared type. Rows are independent, so repeats give repeats.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

RATE = 8000
HEADER = 44

#: The leading bytes of each format.
MAGIC = {
    "png": b"\x89PNG\r\n\x1a\n",
    "gif87": b"GIF87a",
    "gif89": b"GIF89a",
    "jpeg": b"\xff\xd8\xff",
    "riff": b"RIFF",
    "bmp": b"BM",
    "pdf": b"%PDF-",
    "zip": b"PK\x03\x04",
    "gzip": b"\x1f\x8b\x08",
    "flac": b"fLaC",
    "ogg": b"OggS",
}


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for name, magic in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (name, len(magic)))
    a.make_automaton()
    return a


#: Bytes that a compressed stream is read and written by.
_PIECE = 1 << 16


def _png(b: Value, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[p : p + 8])
        if first and (kind != b"IHDR" or n != 13) or p + 12 + n > len(b):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack(">I", b[p + 8 + n : p + 12 + n])[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _gif(b: Value, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: Value, at: int) -> tuple[str, int] | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF and b[p + 1] not in (0x00, 0xFF):
        if b[p + 1] == 0xDA:
            end = b.after(b"\xff\xd9", p)
            return None if end < 0 else ("image/jpeg", end + 2 - at)
        p += 2 + struct.unpack(">H", b[p + 2 : p + 4])[0]
    return None


def _riff(b: Value, at: int) -> tuple[str, int] | None:
    if at + 20 > len(b):
        return None
    size, kind = struct.unpack("<I4s", b[at + 4 : at + 12])
    end = at + 8 + size
    if end > len(b) or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    p, names = at + 12, []
    while p + 8 <= end:
        name, n = struct.unpack("<4sI", b[p : p + 8])
        names.append(name)
        p += 8 + n + (n & 1)
    if p not in (end, end + 1) or kind == b"WAVE" and not {b"fmt ", b"data"} <= set(names):
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[kind], end - at


def _bmp(b: Value, at: int) -> tuple[str, int] | None:
    if at + 30 > len(b):
        return None
    size, _, offset, head = struct.unpack("<IIII", b[at + 2 : at + 18])
    planes, depth = struct.unpack("<HH", b[at + 26 : at + 30])
    ok = head in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + head <= offset <= size
    return ("image/bmp", size) if ok and at + size <= len(b) else None


def _pdf(b: Value, at: int) -> tuple[str, int] | None:
    end = b.after(b"%%EOF", at)
    return None if end < 0 or not 0x30 <= b[at + 5] <= 0x39 else ("application/pdf", end + 5 - at)


def _zip(b: Value, at: int) -> tuple[str, int] | None:
    end = b.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset, note = struct.unpack("<IIH", b[end + 12 : end + 22])
    return ("application/zip", end - at + 22 + note) if size + offset == end - at and end + 22 + note <= len(b) else None


def _gzip(b: Value, at: int) -> tuple[str, int] | None:
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof and (p < len(b) or d.unconsumed_tail):
            piece = d.unconsumed_tail
            if not piece:
                piece, p = b[p : p + _PIECE], min(p + _PIECE, len(b))
            d.decompress(piece, _PIECE)  # what comes out is not kept
    except zlib.error:
        return None
    return ("application/gzip", p - at - len(d.unused_data)) if d.eof else None


def _flac(b: Value, at: int) -> tuple[str, int] | None:
    return ("audio/flac", len(b) - at) if at + 42 <= len(b) and b[at + 4] & 0x7F == 0 and bytes(b[at + 5 : at + 8]) == b"\0\0\x22" else None


def _ogg(b: Value, at: int) -> tuple[str, int] | None:
    p = at
    while p + 27 <= len(b) and bytes(b[p : p + 4]) == b"OggS" and b[p + 4] == 0:
        n = b[p + 26]
        last = b[p + 5] & 4
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
        if last:
            return "audio/ogg", p - at
    return None


_VALIDATE = {"png": _png, "gif87": _gif, "gif89": _gif, "jpeg": _jpeg, "riff": _riff, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg}


class Value:
    """Bytes in place: slices copy what they name, and the places of an end mark are looked up once however many starts ask."""

    def __init__(self, value: bytes):
        self.value, self.marks = value, {}

    def __len__(self) -> int:
        return len(self.value)

    def __getitem__(self, at):
        return self.value[at]

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark from `at` on, or -1."""
        if mark not in self.marks:
            places, p = [], self.value.find(mark)
            while p >= 0:
                places.append(p)
                p = self.value.find(mark, p + 1)
            self.marks[mark] = places
        places = self.marks[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1


def sniff(value: bytes) -> list[tuple[str, int, int]]:
    """Every confirmed (type, start, length); pieces inside a confirmed piece are listed too."""
    view, found = Value(value), []
    for end, (name, n) in _automaton().iter(value.decode("latin-1")):
        if hit := _VALIDATE[name](view, end - n + 1):
            found.append((hit[0], end - n + 1, hit[1]))
    return sorted(found, key=lambda x: (x[1], -x[2]))


def sound(samples: bytes) -> bytes:
    """An 8-bit mono sound file that holds the samples unchanged."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples_of(value: bytes, start: int, length: int) -> bytes:
    """The sample bytes of the sound file found at a place."""
    p = start + 12
    while p + 8 <= start + length:
        name, n = struct.unpack_from("<4sI", value, p)
        if name == b"data":
            return value[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("a sound file without samples")


def payload(text: str | None) -> bytes:
    b = (text or "").encode()
    return b + bytes(-len(b) % 64 or (0 if b else 64))


def _features(samples: bytes) -> str:
    s = np.frombuffer(samples, np.uint8)
    counts = np.bincount(s, minlength=256)
    share = counts[counts > 0] / len(s)
    entropy = float(-(share * np.log2(share)).sum())
    crossings = int(np.count_nonzero(np.diff(s >= 128)))
    return f"mean={s.mean():.4f};std={s.std():.4f};min={s.min()};max={s.max()};zero_crossings={crossings};entropy={entropy:.4f};seconds={len(s) / RATE:.4f}"


SNIFFED = "struct<declared:string,type:string,corrected:boolean,embedded:array<struct<type:string,start:long,length:long>>>"


def sniff_column(df: DataFrame, value: str, declared: str | None = None, out: str = "media") -> DataFrame:
    """The input's columns and a struct: declared type, proven type, whether they differ, and embedded media."""

    @F.pandas_udf(SNIFFED)
    def run(values, types):
        import pandas as pd

        rows = []
        for v, t in zip(values, types, strict=True):
            found = sniff(bytes(v)) if v is not None else []
            proven = next((k for k, at, _ in found if at == 0), None)
            inner = [{"type": k, "start": at, "length": n} for k, at, n in found if at > 0]
            rows.append({"declared": t, "type": proven or t, "corrected": bool(proven and proven != t), "embedded": inner})
        return pd.DataFrame(rows, columns=["declared", "type", "corrected", "embedded"])

    return df.withColumn(out, run(F.col(value), F.col(declared) if declared else F.lit(None).cast("string")))


#: What a column of texts says of itself before anything is looked at.
DECLARED = "text/plain"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        texts = [t.as_py() for t in b.column(1)]
        stored = [sound(payload(t)) for t in texts]
        sizes = [len((t or "").encode()) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"])


def stored_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as the samples of a sound file."""
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for v in b.column(2):
            media = v.as_py()
            found = sniff(media)
            kind, start, length = next((x for x in found if x[1] == 0), (None, 0, 0))
            if kind != "audio/wav":
                raise ValueError("a stored value is not the sound file that was written")
            got = samples_of(media, start, length)
            out.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"type={kind};{_features(got)}", kind, kind != DECLARED, len(found) - 1))
        cols = list(zip(*out, strict=True)) or [()] * 9
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "type", "corrected", "n_embedded"])


def read_media(media: DataFrame) -> DataFrame:
    """Sniff, carve and describe what stored_media() stored: the proven type in place of the declared one, and how many media the
    payload holds inside."""
    return media.mapInArrow(_read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, type string, corrected boolean, n_embedded long")


#: The forms that attachments come in.
FORMS = ("audio/wav", "image/png", "image/bmp", "application/gzip", "application/zip")
_WIDTH = 64


def _png_of(samples: bytes) -> bytes:
    rows = np.zeros((len(samples) // _WIDTH, _WIDTH + 1), np.uint8)  # a filter byte before each row
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, _WIDTH)
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    head = struct.pack(">IIBBBBB", _WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC["png"] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def _bmp_of(samples: bytes) -> bytes:
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    grey[:, 3] = 0
    start = 54 + 1024
    head = struct.pack("<IiiHHIIiiII", 40, _WIDTH, -(len(samples) // _WIDTH), 1, 8, 0, len(samples), 2835, 2835, 256, 256)
    return struct.pack("<2sIHHI", b"BM", start + len(samples), 0, 0, start) + head + grey.tobytes() + samples


def _zip_of(samples: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("payload"), samples)
    return out.getvalue()


def encoded(samples: bytes, kind: str) -> bytes:
    """A file of the kind that holds the samples, a multiple of 64 of them, unchanged."""
    of = {"audio/wav": sound, "image/png": _png_of, "image/bmp": _bmp_of, "application/gzip": lambda b: gzip.compress(b, 1, mtime=0), "application/zip": _zip_of}
    return of[kind](samples)


def decoded(value: bytes, kind: str) -> bytes:
    """The samples of a file that encoded() made."""
    if kind == "audio/wav":
        return samples_of(value, 0, len(value))
    if kind == "image/png":
        p, parts = 8, []
        while p < len(value):
            n, name = struct.unpack(">I4s", value[p : p + 8])
            if name == b"IDAT":
                parts.append(value[p + 8 : p + 8 + n])
            p += 12 + n
        return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, _WIDTH + 1)[:, 1:].tobytes()
    if kind == "image/bmp":
        return value[struct.unpack_from("<I", value, 10)[0] :]
    if kind == "application/gzip":
        return gzip.decompress(value)
    with zipfile.ZipFile(io.BytesIO(value)) as z:
        return z.read("payload")


def attachment(samples: bytes) -> tuple[str, bytes]:
    """(declared type, value): the samples as a file of a form that their checksum picks, one in three inside a letter; what it is declared
    as is picked apart from that, so most declarations are wrong."""
    c = zlib.crc32(samples)
    value = encoded(samples, FORMS[c % len(FORMS)])
    if c // 5 % 3 == 0:
        value = b"Attached, with greetings:\r\n\r\n" + value + b"\r\n-- end of letter"
    return FORMS[c // 15 % len(FORMS)], value


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        own = [attachment(payload(t.as_py())) for t in b.column(1)]
        for stored in _store(iter([b])):
            yield pa.RecordBatch.from_arrays([*stored.columns, pa.array([d for d, _ in own], pa.string()), pa.array([v for _, v in own], pa.binary())], ["doc_id", "n_bytes", "media", "declared", "attached"])


_ATTACHED = "attachment_declared string, attachment_type string, attachment_corrected boolean, carved_type string, carved_start long, carved_length long, carved_sha256 string"


def carved(declared: str, value: bytes) -> tuple:
    """(declared, type, corrected, carved type, start, length, digest of its samples): the type that the leading bytes prove, or the declared one, and the first
    confirmed piece of a value, cut out and decoded."""
    found = sniff(value)
    proven = next((k for k, at, _ in found if at == 0), None)
    kind, at, n = next((x for x in found if x[0] in FORMS), (None, None, None))
    digest = hashlib.sha256(decoded(value[at : at + n], kind)).hexdigest() if kind else None
    return declared, proven or declared, bool(proven and proven != declared), kind, at, n, digest


def _read_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [carved(d.as_py(), v.as_py()) for d, v in zip(b.column(3), b.column(4), strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in _ATTACHED.split(", ")]
        for read in _read(iter([b])):
            yield pa.RecordBatch.from_arrays([*read.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*read.schema.names, *names])


def described(docs: DataFrame) -> DataFrame:
    """What read_media() says of the stored texts, and of an attachment of each: its declared and its proven type, and the media carved out of it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.select("doc_id", "text").mapInArrow(_attach, f"doc_id {kind}, n_bytes long, media binary, declared string, attached binary")
    read = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, type string, corrected boolean, n_embedded long"
    return both.mapInArrow(_read_both, f"doc_id {kind}, n_bytes long, {read}, {_ATTACHED}")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(table(spark, sf_dir, "documents"))
