"""JSON arrays in files of any size: one file is read by many tasks.

The text source cuts files into byte ranges and each range into fragments that end at "}", wherever line breaks are. What a
quote or a comma means depends on all that stands before it, so the ranges are read twice. The first pass tells, for each range, how
quotes and brackets add up if it starts outside a string and if it starts inside one; a running sum over the ranges of a file
(a row each) then gives the state in which each really starts. The second pass cuts the ranges at the commas of the outer array.
An element that crosses ranges comes in pieces, which are put together by the element's number in the file; all other
elements never leave their task. An element is a row, so one element must fit into a task; a file need not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.sources.shared import materialised

#: Largest table of ranges, in rows, that is sent to every task; beyond it fragments are shuffled to their range.
BROADCAST_RANGES = 200_000

_QUOTE, _BACKSLASH, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True


def _quotes(b: np.ndarray) -> np.ndarray:
    """1 at quotes that open or close a string: those after an even number of backslashes."""
    at = np.flatnonzero(b == _QUOTE)
    slash = b == _BACKSLASH
    if len(at) and slash.any():
        plain = np.flatnonzero(~slash)
        before = np.searchsorted(plain, at) - 1  # the last byte before each quote that is no backslash
        run = at - np.where(before >= 0, plain[np.maximum(before, 0)], -1) - 1
        at = at[run % 2 == 0]
    out = np.zeros(len(b), np.int8)
    out[at] = 1
    return out


def _depths(b: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte belongs to a string, change of depth after each byte) from a start inside or outside a string."""
    string = (np.cumsum(_quotes(b)) + inside) % 2 == 1  # a closing quote is not in it, but neither steps nor parts
    return string, np.cumsum(np.where(string, 0, _STEP[b]), dtype=np.int64)


def _ranges_of(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[bytes]]]:
    """Fragments as they come, gathered while their first `columns` columns, a range's, stay the same; at most a batch at once."""
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(columns)), strict=True))
        texts = b.column(columns).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], texts[start:i]
                start = i


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: bytes, fragments, first byte that is no space, parity of quotes, change of depth from outside and from inside."""
    seen: dict[tuple, list] = {}
    for key, texts in _ranges_of(batches, 2):
        own = seen.setdefault(key, [0, 0, None, 0, 0, 0])
        b = np.frombuffer(b"}".join(texts) + b"}", np.uint8)
        own[0] += len(b) - len(texts)
        own[1] += len(texts)
        solid = np.flatnonzero(~_SPACE[b])
        if own[2] is None and len(solid):
            own[2] = chr(b[solid[0]])
        out, into = (int(_depths(b, inside)[1][-1]) for inside in (own[3] == 1, own[3] == 0))
        own[4], own[5] = own[4] + out, own[5] + into
        own[3] = (own[3] + int(_quotes(b).sum())) % 2
    if seen:
        rows = [[*k, *v] for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["path", "block", "n_bytes", "n", "lead", "parity", "out", "into"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of elements: path, block, piece (its number in the range), text, and what the whole range ends with, at its last piece."""
    range_, state = None, None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64()))], ["path", "block", "piece", "text", "last", "sound", "opened"])
        out.clear()
        return made

    def close() -> None:
        path, block, *_ = range_
        out.append((path, block, state["piece"], bytes(state["held"]), True, state["sound"] and (not state["final"] or (state["depth"] == 0 and not state["inside"])), state["opened"]))

    for key, texts in _ranges_of(batches, 7):
        if key != range_:
            if range_ is not None:
                close()
            range_ = key
            state = {"inside": key[2], "depth": key[3], "piece": 0, "held": bytearray(), "sound": True, "opened": 0, "n": 0, "final": key[5]}
        path, block, _, _, is_list, final, open_end = key
        state["n"] += len(texts)
        raw = b"}".join(texts) + b"}"
        if open_end and state["n"] == open_end:
            raw = raw[:-1]  # nothing ends the file's last fragment
        b = np.frombuffer(raw, np.uint8)
        string, change = _depths(b, state["inside"])
        depth = state["depth"] + change
        if is_list:
            before = depth - np.where(string, 0, _STEP[b])
            frame = ~string & (np.minimum(depth, before) == 0) & (depth != before)  # the outer brackets
            outside = (depth == 0) & ~frame & ~_SPACE[b] & (before == 0)
            state["sound"] &= not outside.any() and not (depth < 0).any()
            state["opened"] += int((frame & (depth == 1)).sum())
            cuts = np.flatnonzero(~string & (b == _COMMA) & (depth == 1))
            frames = np.flatnonzero(frame).tolist()
            at = 0
            for cut in [*cuts.tolist(), None]:
                part = raw[at:cut] if cut is not None else raw[at:]
                for f in reversed([f - at for f in frames if at <= f < (cut if cut is not None else len(raw))]):
                    part = part[:f] + part[f + 1 :]
                state["held"] += part
                if cut is not None:
                    out.append((path, block, state["piece"], bytes(state["held"]), False, True, 0))
                    state["piece"], state["held"], at = state["piece"] + 1, bytearray(), cut + 1
        else:
            state["held"] += raw
        if len(b):
            state["depth"] = int(depth[-1])
            state["inside"] = bool((int(_quotes(b).sum()) + state["inside"]) % 2)
        if len(out) >= 2000:
            yield batch()
    if range_ is not None:
        close()
    if out:
        yield batch()


def _fragments(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, block, text, at, size): what lies between two "}" of a file, in the order of each range."""
    meta = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder)
    return rows.select(meta("file_path").alias("path"), meta("file_block_start").alias("block"), F.col("value").cast("binary").alias("text"), F.monotonically_increasing_id().alias("at"), meta("file_size").alias("size"), meta("file_modification_time").alias("modified_at"))


def read_elements(spark: SparkSession, folder: str, glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(files, elements) of all JSON files below a folder; runs the jobs that find the ranges' states and writes their pieces.

    files: path, size, modified_at, is_list, readable, n: an empty or broken file is there, not readable and without elements.
    elements: path, position (from 0), text: of the readable lists, each element's JSON text.
    """
    fragments = _fragments(spark, folder, glob)
    sums = materialised(fragments.select("path", "block", "text").mapInArrow(_sums, "path string, block long, n_bytes long, n long, lead string, parity int, `out` long, `into` long"), "ranges")
    in_file = W.partitionBy("path").orderBy("block")  # a row for each range of a file
    earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("parity").over(earlier) % 2 == 1, F.lit(False))
    states = sums.withColumn("inside", inside).withColumn("_step", F.when(F.col("inside"), F.col("into")).otherwise(F.col("out")))
    states = states.withColumns({
        "depth": F.coalesce(F.sum("_step").over(earlier), F.lit(0)),
        "first": F.first("lead", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "final": F.lead("block").over(in_file).isNull(),
        "whole": F.sum(F.col("n_bytes") + F.col("n")).over(in_file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    states = materialised(states.select("path", "block", "inside", "depth", (F.col("first") == "[").alias("is_list"), "final", "whole", "n"), "range_states")

    small = states.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    joined = fragments.join(F.broadcast(states) if small else states, ["path", "block"])
    if not small:
        joined = joined.sortWithinPartitions("path", "block", "at")
    open_end = F.when(F.col("final") & (F.col("whole") != F.col("size")), F.col("n")).otherwise(0)
    pieces = joined.select("path", "block", "inside", "depth", F.coalesce("is_list", F.lit(False)).alias("is_list"), "final", open_end.alias("open_end"), "text")
    pieces = materialised(pieces.mapInArrow(_pieces, "path string, block long, piece long, text binary, last boolean, sound boolean, opened long"), "pieces")

    ends = pieces.filter("last").select("path", "block", "piece", "sound", "opened")
    before = ends.select("path", "block", F.coalesce(F.sum("piece").over(earlier), F.lit(0)).alias("before"), F.col("piece").alias("last_piece"))
    placed = pieces.join(F.broadcast(before) if small else before, ["path", "block"]).withColumn("position", F.col("before") + F.col("piece"))
    own = (F.col("piece") > 0) & (F.col("piece") < F.col("last_piece"))
    shared = placed.filter(~own).groupBy("path", "position").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined_text = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["text"])).cast("string")
    elements = placed.filter(own).select("path", "position", F.col("text").cast("string").alias("text")).unionByName(shared.select("path", "position", joined_text.alias("text")))
    elements = elements.withColumn("text", F.trim("text", F.lit(" \t\n\r")))

    judged = elements.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.try_parse_json("text").isNotNull()).alias("good"), F.max("text").alias("any"))
    sound = ends.groupBy("path").agg(F.bool_and("sound").alias("sound"), F.sum("opened").alias("opened"))
    kind = states.groupBy("path").agg(F.bool_or("is_list").alias("is_list"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"))
    # the sources pass over files without a byte; the driver has all files' names in any case
    names = [re.sub("^([a-z0-9+.-]+):///", r"\1:/", p) for p in spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(folder).inputFiles()]
    found = spark.createDataFrame([(p,) for p in names], "path string").join(found, "path", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    empty = (F.col("n") == 1) & (F.col("any") == "") & F.col("is_list")
    files = (
        found.join(judged, "path", "left").join(sound, "path", "left").join(kind, "path", "left")
        .select("path", "size", "modified_at", F.coalesce("is_list", F.lit(False)).alias("is_list"), F.coalesce(F.col("sound") & (~F.col("is_list") | (F.col("opened") == 1)) & (F.col("good") | empty), F.lit(False)).alias("readable"), F.when(empty | ~F.col("is_list"), 0).otherwise(F.col("n")).alias("n"))
        .withColumn("n", F.when(F.col("readable"), F.col("n")).otherwise(0))
    )
    files = materialised(files, "json_files")
    lists = files.filter("readable and is_list and n > 0").select("path")
    return files, elements.join(F.broadcast(lists) if small else lists, "path", "left_semi")


def write_arrays(rows: DataFrame, folder: str, file: str, order: str, text: str) -> None:
    """One JSON array for each value of `file`, of the JSON texts in `text` by `order`; a file is one task's work, so its rows must be bounded."""
    spark = rows.sparkSession
    in_file = W.partitionBy(file)
    nth, n = F.row_number().over(in_file.orderBy(order)), F.count(F.lit(1)).over(in_file)
    lines = rows.select(F.col(file).alias("_file"), nth.alias("_nth"), n.alias("_n"), F.col(text).alias("_text"))
    line = F.concat(F.when(F.col("_nth") == 1, "[").otherwise(","), F.col("_text"), F.when(F.col("_nth") == F.col("_n"), "]").otherwise(""))
    lines.select("_file", "_nth", line.alias("value")).repartition("_file").sortWithinPartitions("_file", "_nth").drop("_nth").write.partitionBy("_file").option("compression", "none").text(f"{folder}/parts")
    named_files(spark, f"{folder}/parts", folder)


def named_files(spark: SparkSession, parts: str, folder: str) -> None:
    """Move the one part of each `_file=` folder to the name that the folder gives; a rename a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    for own in fs.listStatus(path(parts)):
        name = own.getPath().getName()
        if name.startswith("_file="):
            part = next(p for p in fs.listStatus(own.getPath()) if p.getPath().getName().startswith("part-"))
            fs.rename(part.getPath(), path(f"{folder}/{name[6:]}"))
    fs.delete(path(parts), True)


