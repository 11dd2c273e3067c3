"""State by key that runs out, as streams: a read-through cache, one-use tokens, tails of logs.

Events may come out of order by as much as the watermark waits. Each key keeps the events that the watermark has not passed
yet; a timer at the earliest of them fires when it has, and they are then taken in order of time, so a stream gives what the
batch operators (quillspark.operators.caches) give, however its files are cut. What a key remembers besides is a time or two, and a
timer forgets it as soon as it no longer decides anything. Events that come after the watermark has passed them are dropped.

State lies in RocksDB under the checkpoint folder; a stream that is started again on it goes on where it stopped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An event of this key and time ends a stream: the watermark passes all others.
END_KEY, END = "", dt.datetime(2200, 1, 1)
#: Most events that one row of the state holds.
ROW_EVENTS = 10_000


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own on the same cluster whose streams keep their state in RocksDB; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return own




class _InOrder(StatefulProcessor):
    """Keeps events (micros, id, kind) until the watermark has passed them, then hands them to `take` in order.

    What a batch brings for a key is one row of the state, so reading and writing it costs a call a batch and not one an event."""

    OUT: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros array<long>, id array<long>, kind array<string>")
        self.held = handle.getValueState("held", "micros long, used boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            self.waiting.appendValue((part["micros"].tolist(), part["id"].tolist(), part["kind"].tolist()))
            least = int(part["micros"].min())
            earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((e for some in self.waiting.get() for e in zip(*some, strict=True)), key=self.order)
        ready = [e for e in waiting if e[0] < passed]
        before = held = self.held.get()
        out = []
        for micros, i, kind in ready:
            held, verdict = self.take(held, micros, kind)
            if verdict is not None:
                out.append((key[0], i, verdict))
        later = waiting[len(ready) :]
        if ready:
            self.waiting.put([tuple(list(c) for c in zip(*later[k : k + ROW_EVENTS], strict=True)) for k in range(0, len(later), ROW_EVENTS)]) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        held, again = self.kept(held, passed)
        if held is None and before is not None:
            self.held.clear()
        if held is not None:
            if before is None or tuple(held) != tuple(before):
                self.held.update(held)
            if again is not None:
                self.handle.registerTimer(again // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "verdict"])

    def close(self) -> None:
        pass

    @staticmethod
    def order(event) -> tuple:
        return event[0], event[1]


class ReadThrough(_InOrder):
    """A fetch holds for its time to live; the fetch's time is forgotten after that."""

    def __init__(self, days: int):
        self.span = days * 86_400_000_000

    def take(self, held, micros: int, kind: str):
        if held is None or micros >= held[0] + self.span:
            return (micros, False), "fetch"
        return held, "cached"

    def kept(self, held, passed: int):
        if held is None or held[0] + self.span <= passed:
            return None, None
        return held, held[0] + self.span


class OneUse(_InOrder):
    """A token is minted once and taken once within its time to live. The time it was minted stays, to tell expired from unknown."""

    def __init__(self, minutes: int):
        self.span = minutes * 60_000_000

    def take(self, held, micros: int, kind: str):
        if kind == "mint":
            return held or (micros, False), None
        if held is None:
            return held, "unknown"
        if micros > held[0] + self.span:
            return held, "expired"
        return (held[0], True), "used" if held[1] else "ok"

    def kept(self, held, passed: int):
        return held, None

    @staticmethod
    def order(event) -> tuple:
        return event[0], event[2] == "take", event[1]


VERDICTS = "key string, id long, verdict string"


def _verdicts(events: DataFrame, late: str, processor: StatefulProcessor) -> DataFrame:
    """events: key, ts, id, kind."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), F.col("kind"))
    rows = rows.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(processor, VERDICTS, "append", "eventTime")


def read_through_stream(requests: DataFrame, days: int = 7, late: str = "1 day") -> DataFrame:
    """requests: key, ts, id. (key, id, verdict): fetch or cached, as caches.read_through has it."""
    return _verdicts(requests.withColumn("kind", F.lit("take")), late, ReadThrough(days))


def tokens_stream(events: DataFrame, minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """events: key, ts, id, kind (mint or take). (key, id, verdict) of each take, as caches.tokens_taken has it."""
    return _verdicts(events, late, OneUse(minutes))


# tails of logs


def _tails(kept: int):
    """Per task: each agent's newest lines, and how many lines there were. Only these are shuffled, so a busy agent is not one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        newest: dict[str, pd.DataFrame] = {}
        for b in batches:
            for agent, rows in b.to_pandas().groupby("agent", sort=False):
                n[agent] = n.get(agent, 0) + len(rows)
                both = pd.concat([newest[agent], rows]) if agent in newest else rows
                newest[agent] = both.sort_values("line_no").tail(kept)
        for agent, rows in newest.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"agent": [agent], "n": [n[agent]], "numbers": [rows["line_no"].tolist()], "lines": [rows["line"].tolist()]}), schema=_TAIL, preserve_index=False)

    return run


_TAIL = pa.schema([("agent", pa.string()), ("n", pa.int64()), ("numbers", pa.list_(pa.int64())), ("lines", pa.list_(pa.string()))])


class Ring(StatefulProcessor):
    """The newest `kept` lines of an agent and the number of all; out goes the whole tail whenever it changes."""

    def __init__(self, kept: int):
        self.size = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "line_no long, line string")
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.ring.get())
        total = self.total.get()[0] if self.total.exists() else 0
        for part in rows:
            for n, numbers, lines in zip(part["n"], part["numbers"], part["lines"], strict=True):
                total += int(n)
                held = sorted([*held, *zip((int(x) for x in numbers), lines, strict=True)], key=lambda x: x[0])[-self.size :]
        self.ring.put(held)
        self.total.update((total,))
        yield pd.DataFrame({"agent": [key[0]], "total": [total], "dropped": [total - len(held)], "numbers": [[x[0] for x in held]], "lines": [[x[1] for x in held]]})

    def close(self) -> None:
        pass


def tail_stream(lines: DataFrame, kept: int = 500) -> DataFrame:
    """lines: agent, line_no, line. (agent, total, dropped, numbers, lines): the tail of each agent that got lines."""
    some = lines.select("agent", F.col("line_no").cast("long").alias("line_no"), F.col("line").cast("string").alias("line")).mapInArrow(_tails(kept), "agent string, n long, numbers array<long>, lines array<string>")
    return some.groupBy("agent").transformWithStateInPandas(Ring(kept), "agent string, total long, dropped long, numbers array<long>, lines array<string>", "update", "none")


def log_since(tails: DataFrame, since: DataFrame) -> DataFrame:
    """since: agent, since. The lines of a tail after the first `since` of all, where to go on, and how many are lost for good.

    An agent without a log has no lines and goes on from 0."""
    start = F.greatest(F.lit(0), F.col("since") - F.coalesce("dropped", F.lit(0))).cast("int")
    rows = since.join(tails, "agent", "left")
    given = F.coalesce(F.slice("lines", start + 1, F.greatest(F.size("lines") - start, F.lit(0))), F.array().cast("array<string>"))
    return rows.select("agent", given.alias("lines"), F.coalesce("total", F.lit(0)).cast("long").alias("next"), F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"))


# streams into folders


def write_batches(stream: DataFrame, target: str, checkpoint: str, mode: str = "append"):
    """Each micro-batch goes to a folder of its own, so one that runs twice writes the same place twice."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{target}/batch={batch:012d}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").option("basePath", target).parquet(f"{target}/*")


def newest_tails(batches: DataFrame) -> DataFrame:
    """Of the tails that each batch wrote, every agent's last one."""
    last = F.max_by(F.struct("total", "dropped", "numbers", "lines"), "batch").alias("t")
    return batches.groupBy("agent").agg(last).select("agent", "t.*")
