"""Operator 7: license scans by fuzzy search for short notices.

Texts are folded to lower-case words joined by one space. The base are places where a phrase's words stand in a row.
The fuzzy search adds to it: a notice that may have k errors is cut into k + 1 pieces, one of which must stand exactly
in any match (pigeonhole); an Aho-Corasick automaton finds all pieces in one pass, and the regex library's bounded-error
matching verifies the neighbourhood of each and reports the span and its errors.

Defined results: null and empty texts have no words, no labels and score 0; rows are independent, so repeated rows
give repeated results. Whole texts are searched. score is 1 for an exact notice, else 1 - errors / length of the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of the fuzzy search, their labels and the errors that each may have.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("apache license", "apache", 1),
    ("mit license", "mit", 1),
    ("bsd license", "bsd", 1),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("cc by sa", "cc-by-sa", 0),
    ("cc by nc", "cc-by-nc", 0),
    ("cc by nd", "cc-by-nd", 0),
    ("all rights reserved", "proprietary", 1),
    ("dedicated to the public domain", "public-domain", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 3),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("permission is hereby granted free of charge to any person", "mit", 3),
    ("permission to use copy modify and or distribute this software", "isc", 3),
    ("you can redistribute it and or modify it under the terms of", "gpl", 3),
    ("creative commons zero", "cc0", 1),
    ("creative commons attribution sharealike", "cc-by-sa", 2),
    ("creative commons attribution noncommercial", "cc-by-nc", 2),
    ("boost software license", "bsl", 2),
    ("artistic license", "artistic", 1),
    ("microsoft public license", "ms-pl", 2),
    ("common development and distribution license", "cddl", 3),
    ("common public license", "cpl", 1),
    ("european union public licence", "eupl", 2),
    ("open font license", "ofl", 1),
    ("gnu free documentation license", "gfdl", 2),
    ("open database license", "odbl", 1),
    ("server side public license", "sspl", 2),
    ("business source license", "busl", 2),
    ("academic free license", "afl", 1),
    ("python software foundation license", "psf", 2),
)

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def folded(text: str | None) -> tuple[int, str]:
    """How many words, and the words with one space between and around."""
    w = (text or "").encode().translate(_FOLD).split()
    return len(w), (b" " + b" ".join(w) + b" ").decode()


def base_places(text: str) -> list[tuple[int, str]]:
    """(place in the folded text, label) of every exact phrase."""
    out = []
    for phrase, label in BASE.items():
        sought, at = f" {phrase} ", -1
        while (at := text.find(sought, at + 1)) >= 0:
            out.append((at, label))
    return sorted(out)


@cache
def _search() -> tuple[ahocorasick.Automaton, list]:
    a, seeds, patterns = ahocorasick.Automaton(), {}, []
    for i, (phrase, _, k) in enumerate(NOTICES):
        patterns.append(regex.compile(f"(?b)(?<= )(?:{regex.escape(phrase, literal_spaces=True)}){{e<={k}}}(?= )" if k else f"(?<= ){phrase}(?= )"))
        cut = [len(phrase) * j // (k + 1) for j in range(k + 2)]
        for low, high in zip(cut, cut[1:]):
            seeds.setdefault(phrase[low:high], []).append((i, low))
    for piece, uses in seeds.items():
        a.add_word(piece, (len(piece), uses))
    a.make_automaton()
    return a, patterns


def fuzzy_places(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, errors) of verified notices in the folded text; the best for each neighbourhood."""
    a, patterns = _search()
    tried, found = {}, {}
    for end, (n, uses) in a.iter(text):
        for i, low in uses:
            phrase, label, k = NOTICES[i]
            start = end - n + 1 - low
            if tried.get(i, -1) >= start:  # that neighbourhood has been searched
                continue
            left, right = max(0, start - 2 * k - 1), start + len(phrase) + 2 * k + 2
            tried[i] = start + k
            if m := patterns[i].search(text, left, min(len(text), right)):
                key, errors = (m.start(), label), sum(m.fuzzy_counts)
                if key not in found or errors < found[key][3]:
                    found[key] = (m.start(), m.end(), label, errors)
    return sorted(found.values())


_SPAN = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("errors", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]
    for b in chunks(batches):
        out = []
        for t in b.column(1):
            n, text = folded(t.as_py())
            base, fuzzy = base_places(text), fuzzy_places(text)
            number, at, spaces = {}, 0, 0
            for p in sorted({p for p, _ in base} | {s - 1 for s, *_ in fuzzy}):
                spaces += text.count(" ", at, p)
                at = p
                number[p] = spaces
            spans = [{"first_word": number[s - 1], "n_words": text.count(" ", s, e) + 1, "label": x, "errors": k} for s, e, x, k in fuzzy]
            labels = {x for _, x in base}
            score = max([float(bool(base)), *(1 - k / (e - s) for s, e, _, k in fuzzy)])
            places = [number[p] for p, _ in base]
            out.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for _, _, x, _ in fuzzy})), score, spans))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: counts and places of base phrases, labels, score, and every fuzzy span with its errors."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,n_words:long,label:string,errors:long>>")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")
