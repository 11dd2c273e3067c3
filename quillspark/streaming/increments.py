"""Usage sums by several groupings, kept up to date: each batch adds its part, and readers merge parts.

A part is at the finest grain: sums by day and surface, and the users of each as bitmaps, which merge exactly. A batch is
published by a manifest, so one that runs twice counts once; when there are many parts, they are merged into one, which is
published in the same way while readers go on with the parts they have. The work of a batch depends on the batch, that of a
reader on days, surfaces and users, not on the events so far.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.versions import Manifests

SETS = (("day", "surface"), ("day",), ("surface",), ())
PART = "day date, surface string, bucket long, calls long, cost_usd decimal(38,6), users binary"


@dataclass
class UsageSums(Manifests):
    #: So many parts are merged into one.
    most: int = 16

    def _head(self) -> dict:
        return self.manifest() if self.versions() else {"version": 0, "parts": [], "batches": {}}

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/parts/{name}")
        return name

    def add(self, events: DataFrame, batch: int, writer: str = "stream") -> None:
        """events: ts, user_id (long), surface, cost_usd."""
        m = self._head()
        if m["batches"].get(writer, -1) >= batch:
            return
        user = F.col("user_id").cast("long")
        rows = events.select(F.to_date("ts").alias("day"), "surface", F.col("cost_usd").cast("decimal(38,6)").alias("cost_usd"), F.bitmap_bucket_number(user).alias("bucket"), F.bitmap_bit_position(user).alias("at"), user.alias("user"))
        # events without a user count, and are no user
        part = rows.groupBy("day", "surface", "bucket").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("decimal(38,6)").alias("cost_usd"), F.bitmap_construct_agg(F.when(F.col("user").isNotNull(), F.col("at"))).alias("users"))
        name = self._write(part.select(*(c.split()[0] for c in PART.split(", "))))
        self.publish({"version": m["version"] + 1, "parts": [*m["parts"], name], "batches": {**m["batches"], writer: batch}})
        if len(m["parts"]) + 1 >= self.most:
            self.merge()

    def _merged(self, rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        return rows.groupBy(*by, "bucket").agg(F.sum("calls").alias("calls"), F.sum("cost_usd").cast("decimal(38,6)").alias("cost_usd"), F.bitmap_or_agg("users").alias("users"))

    def parts(self) -> DataFrame:
        m = self._head()
        folders = [f"{self.root}/parts/{p}" for p in m["parts"]]
        return self.spark.read.schema(PART).parquet(*folders) if folders else self.spark.createDataFrame([], PART)

    def merge(self) -> None:
        """All parts in one. What is read meanwhile is not deleted: `swept` does that when nobody reads."""
        m = self._head()
        name = self._write(self._merged(self.parts(), ("day", "surface")).select(*(c.split()[0] for c in PART.split(", "))))
        self.publish({**m, "version": m["version"] + 1, "parts": [name]})

    def swept(self) -> list[str]:
        """Delete the parts that the newest manifest does not name."""
        path, fs = self._fs()
        folder, used = path(f"{self.root}/parts"), set(self._head()["parts"])
        gone = [f for f in (fs.listStatus(folder) if fs.exists(folder) else ()) if f.getPath().getName() not in used]
        for f in gone:
            fs.delete(f.getPath(), True)
        return [f.getPath().getName() for f in gone]

    def sums(self, sets: tuple[tuple[str, ...], ...] = SETS) -> DataFrame:
        """(day, surface, level, calls, cost_usd, users): a row for each group of every set; `level` names the set's columns, the others are null."""
        finest, out = self.parts(), None
        for by in sets:
            one = self._merged(finest, by)
            n = one.groupBy(*by).agg(F.sum("calls").alias("calls"), F.sum("cost_usd").cast("decimal(38,6)").alias("cost_usd"), F.sum(F.bitmap_count("users")).alias("users"))
            columns = [F.col(c) if c in by else F.lit(None).cast(t).alias(c) for c, t in (("day", "date"), ("surface", "string"))]
            own = n.filter("calls > 0").select(*columns, F.lit("+".join(by) or "all").alias("level"), "calls", "cost_usd", "users")
            out = own if out is None else out.unionByName(own)
        return out
