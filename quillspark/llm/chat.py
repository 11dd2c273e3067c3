r"""Operator 5: chat formatting. Layouts are recognised by hashes of their nested field paths.

Every layout names the field paths that it needs and, declaratively, where ids, roles and texts lie. A schema's or a
JSON record's paths are hashed; the layout whose required hashes are all there (the one with most of them, ties by
name) decides the mapping. Field order, extra fields and clashing names elsewhere do not matter. Out come canonical
turns: conv_id, turn, role, text.

The template writes a turn as `### <role>:\n<text></turn>\n`. A backslash stands before every backslash, `#` and `<`
of a text (and `:` of a role), so no control string can arise inside one, and taking it away again restores the text.
The loss mask covers the text of each assistant turn.

Conversations are read back as a sorted stream with running hashes: no conversation is ever held whole, however
long. One conversation's hash is sequential by its definition, so one task reads it, a turn at a time.

Defined results: null roles and texts are empty; a null conv_id is a conversation of its own; rows that tie on turn
are ordered by role, then text, and repeated rows are kept; null turns come first; a record that fits no layout gives
no turns (unmatched() lists it). The query adds conversation -7; turns that the table has under that id join it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

CANONICAL = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Layout:
    """needs: required paths. A list of turns lies at `turns` with role and text fields; or each (role, path) is one turn; or a row is a turn."""

    name: str
    needs: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    id: str = "conv_id"
    order: str = ""
    roles: tuple[tuple[str, str], ...] = ()


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("chatgpt", "assistant"))

LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), role="role", text="text", order="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=SHARED_ROLES),
    Layout("instruction", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("instruction", "input", "output"), fixed=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "completion"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt", ("system", "prompt", "completion"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("question", "answer"), fixed=(("user", "question"), ("assistant", "answer"))),
)


def path_hash(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


_NEEDS = {x.name: frozenset(map(path_hash, x.needs)) for x in LAYOUTS}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def value_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")}
    return {at}


def choose(paths) -> Layout | None:
    """The layout that these paths fit best."""
    have = frozenset(map(path_hash, paths))
    fits = [x for x in LAYOUTS if _NEEDS[x.name] <= have]
    return min(fits, key=lambda x: (-len(x.needs), x.name), default=None)


def fingerprint(paths) -> str:
    return path_hash("\n".join(sorted(set(paths))))


def _role(layout: Layout, role: str | None) -> str:
    return dict(layout.roles).get(role or "", role or "")


def record_turns(record) -> list[tuple[str, str]] | None:
    """(role, text) of a parsed record's turns, or None if no layout fits."""
    layout = choose(value_paths(record)) if isinstance(record, dict) else None
    if layout is None or layout.order:
        return None
    text = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
    if layout.fixed:
        return [(role, text(record.get(at))) for role, at in layout.fixed]
    return [(_role(layout, text(m.get(layout.role))), text(m.get(layout.text))) for m in record[layout.turns] or [] if isinstance(m, dict)]


def canonical_rows(df: DataFrame) -> DataFrame:
    """Canonical turns of a table whose schema fits a layout, by DataFrame expressions."""
    layout = choose(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no layout has the fingerprint {fingerprint(schema_paths(df.schema))}")
    fix = F.create_map(*(F.lit(x) for pair in layout.roles for x in pair)) if layout.roles else None
    role = lambda c: F.coalesce(F.element_at(fix, c), c) if fix is not None else c
    conv = F.col(layout.id).cast("long").alias("conv_id") if layout.id in df.columns else F.lit(None).cast("long").alias("conv_id")
    if layout.order:
        return df.select(conv, F.col(layout.order).cast("long").alias("turn"), F.col(layout.role).alias("role"), F.col(layout.text).alias("text"))
    if layout.fixed:
        parts = F.array(*(F.struct(F.lit(r).alias("role"), F.col(at).cast("string").alias("text")) for r, at in layout.fixed))
    else:
        parts = F.transform(layout.turns, lambda m: F.struct(role(m[layout.role]).alias("role"), m[layout.text].alias("text")))
    return df.select(conv, F.posexplode(parts).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def canonical_json(df: DataFrame, conv_id: str, record: str) -> DataFrame:
    """Canonical turns of JSON records, each with a layout of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for c, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    turns = record_turns(json.loads(r)) if r else None
                except ValueError:
                    turns = None
                out += [(c, i, role, text) for i, (role, text) in enumerate(turns or [])]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text"])

    return df.select(F.col(conv_id).cast("long"), F.col(record)).mapInArrow(run, CANONICAL)


def unmatched(df: DataFrame, record: str) -> DataFrame:
    """The JSON records that no layout fits."""

    @F.pandas_udf("boolean")
    def fits(values):
        import pandas as pd

        def one(v):
            try:
                return record_turns(json.loads(v)) is not None if v else False
            except ValueError:
                return False

        return pd.Series([one(v) for v in values])

    return df.filter(~fits(F.col(record)))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*):\n([^\\#<]*(?:\\.[^\\#<]*)*)</turn>\n", re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and the places in it that the loss mask covers (none: both 0)."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}:\n"
    body = escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}</turn>\n", *span


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn starts at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted, loss_start, loss_end): a conversation is its pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [format_turn(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, k) for x, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True))], [*b.schema.names, "formatted", "loss_start", "loss_end"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"{CANONICAL}, formatted string, loss_start long, loss_end long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from pieces in order; state is two running hashes and three counters."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    done: list[tuple] = []
    now, started = None, False
    for b in batches:
        for conv, piece, low, high in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if not started or conv != now:
                if started:
                    done.append((now, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars))
                now, started, n, loss_n, chars, all_, loss = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in read_turns(piece):
                n += 1
                all_.update(f"{role}\n{text}\n".encode())
            masked = unescape(piece[low:high])
            loss_n += len(masked)
            loss.update(masked.encode())
            chars += len(piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done = []
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((now, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars), kinds, strict=True)], names)


def read_chat(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted pieces."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Fixed values of the contract: one more conversation, whose texts look like control strings.
EXTRA = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = json.dumps({"messages": [{"role": r, "content": EXTRA} for r in ("user", "assistant")]})
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    turns = canonical_rows(table(spark, sf_dir, "conversations")).unionByName(canonical_json(extra, "conv_id", "record"))
    return read_chat(format_chat(turns))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) x(conv_id, turn, role, text)),
n AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS body, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + head + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
