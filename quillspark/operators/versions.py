"""A table in versions: changes are staged beside it and published by one manifest, so readers see all of a change or nothing.

    root/data/<stage>/_bucket=7/...   rows, dealt to buckets by id
    root/log/<stage>/...              a row for each file that the change commits
    root/manifests/000000000012.json  which stage holds each bucket, and the stages of the log

A change writes only the buckets that it touches, into a stage of its own name, and then creates the next manifest. Creating a
file that must not exist yet is the one atomic step: of two writers one fails, and a writer that dies before it leaves nothing
but a stage that no manifest names, which `swept` deletes. A manifest has a line for each bucket, not for each row.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators import snapshots as s
from quillspark.sources.shared import materialised

BUCKETS = 16
#: Columns that are lists of structs or of texts: a change gives their JSON.
_NESTED = ("array", "struct", "map")
LOG = "file string, agent string, version long, committed_at timestamp_ntz, entries long, applied long, skipped_no_change long, skipped_duplicate long, errors long"


class Conflict(RuntimeError):
    """Another change was published first."""


@dataclass
class Manifests:
    """The numbered manifests of a folder; the one with the greatest number holds."""

    spark: SparkSession
    root: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs()
        folder = path(f"{self.root}/manifests")
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict:
        version = self.versions()[-1] if version is None else version
        text = self.spark.read.option("wholetext", "true").text(f"{self.root}/manifests/{version:012d}.json").head()[0]
        return json.loads(text)

    def publish(self, manifest: dict) -> None:
        """The switch: fails where the version exists already."""
        path, fs = self._fs()
        try:
            out = fs.create(path(f"{self.root}/manifests/{manifest['version']:012d}.json"), False)
        except Exception as e:
            if "already exists" in str(e):
                raise Conflict(f"version {manifest['version']} was published by another writer") from e
            raise
        out.write(json.dumps(manifest).encode())
        out.close()


@dataclass
class VersionedTable(Manifests):
    key: str = "id"
    buckets: int = BUCKETS
    log_schema: str = LOG

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def stage(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Write rows into a new stage; (its name, the buckets it holds)."""
        name = uuid.uuid4().hex
        dealt = rows.withColumn("_bucket", self._bucket(F.col(self.key)))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{name}")
        path, fs = self._fs()
        return name, sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path(f"{self.root}/data/{name}")) if "=" in f.getPath().getName())

    def create(self, rows: DataFrame) -> int:
        name, _ = self.stage(rows)
        self.publish({"version": 1, "schema": rows.schema.json(), "stages": {str(b): name for b in range(self.buckets)}, "log": []})
        return 1

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"]))
        path, fs = self._fs()
        asked = range(self.buckets) if buckets is None else buckets
        folders = [f for f in (f"{self.root}/data/{m['stages'][str(b)]}/_bucket={b}" for b in asked) if fs.exists(path(f))]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def log(self, version: int | None = None) -> DataFrame:
        folders = [f"{self.root}/log/{name}" for name in self.manifest(version)["log"]]
        return self.spark.read.schema(self.log_schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.log_schema)

    def swept(self) -> list[str]:
        """Delete the stages that no manifest names; their names. Only while no change is under way."""
        path, fs = self._fs()
        used = {name for v in self.versions() for m in [self.manifest(v)] for name in [*m["stages"].values(), *m["log"]]}
        gone = []
        for kind in ("data", "log"):
            folder = path(f"{self.root}/{kind}")
            for f in fs.listStatus(folder) if fs.exists(folder) else ():
                if f.getPath().getName() not in used:
                    fs.delete(f.getPath(), True)
                    gone.append(f.getPath().getName())
        return gone

    def done(self, writer: str, batch: int) -> bool:
        """Whether a writer's batch is in the table."""
        return self.manifest().get("batches", {}).get(writer, -1) >= batch

    def changed(self, changes: DataFrame, log: DataFrame | None = None, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Publish changes: key, op and `row` or `columns`, and the rows of the log that go with them. Returns the new version.

        batch: a writer's name and the number of its batch, which count up. A batch that the table has already changes nothing, so a
        writer that is run again after a failure, as a stream is, writes table and log exactly once.

        op "upsert" replaces the row or adds it, "insert" adds it where the key is free, "delete" removes it; `row` is a struct of the
        table's columns. op "patch" sets the named `columns` (text by name) of a row that is there. A key has one row of
        upsert, insert or delete, and any number of columns, each once. Only touched buckets are read and written."""
        m = self.manifest(base)
        if batch is not None and m.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return m["version"]
        schema = StructType.fromJson(json.loads(m["schema"]))
        changes = materialised(changes, "changes")
        touched = sorted(r[0] for r in changes.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect())  # a number a bucket
        now = self.read(m["version"], touched).withColumn("_there", F.lit(True))
        whole = changes.filter("op <> 'patch'").select(F.col(self.key).alias("_key"), F.col("op").alias("_op"), F.col("row").alias("_row"))
        patch = changes.filter("op = 'patch'").select(F.col(self.key).alias("_patched"), F.col("columns").alias("_columns"))
        # a change's columns repeat, so its files are small and its rows many: sizes of files are no ground to broadcast it
        both = now.join(whole.hint("merge"), F.col(self.key) == F.col("_key"), "full_outer").join(patch.hint("merge"), F.coalesce(F.col(self.key), F.col("_key")) == F.col("_patched"), "left")
        new = F.coalesce((F.col("_op") == "upsert") | ((F.col("_op") == "insert") & F.col("_there").isNull()), F.lit(False))
        kept = both.filter(F.coalesce(F.col("_op") != "delete", F.lit(True)) & (F.coalesce("_there", F.lit(False)) | new))
        out = kept.select(*(self._value(f, new).alias(f.name) for f in schema.fields))
        name = self.stage(out)[0] if touched else ""
        # a bucket that lost its last row is in the new stage too, as a folder that is not there
        stages = {**m["stages"], **{str(b): name for b in touched}}
        logs = list(m["log"])
        if log is not None:
            own = uuid.uuid4().hex
            log.withColumn("version", F.lit(m["version"] + 1).cast("long")).select(*(c.split()[0] for c in self.log_schema.split(", "))).write.parquet(f"{self.root}/log/{own}")
            logs.append(own)
        batches = {**m.get("batches", {}), **({batch[0]: batch[1]} if batch else {})}
        self.publish({"version": m["version"] + 1, "schema": m["schema"], "stages": stages, "log": logs, "batches": batches})
        return m["version"] + 1

    def _value(self, field, new: Column) -> Column:
        text, kind = F.element_at("_columns", F.lit(field.name)), field.dataType
        typed = F.from_json(text, kind) if kind.typeName() in _NESTED else text.cast(kind)
        was = F.when(new, F.col("_row")[field.name]).otherwise(F.col(field.name))
        return F.when(F.coalesce(F.map_contains_key("_columns", F.lit(field.name)), F.lit(False)), typed).otherwise(was)


def _order(files: DataFrame) -> DataFrame:
    """(file, nth): files by the instant in their names, then by name; a row a file."""
    from pyspark.sql import Window as W

    from quillspark.functions import dates

    return files.select("file").distinct().select("file", F.row_number().over(W.orderBy(dates.snapshot_time(F.col("file")).asc_nulls_first(), "file")).alias("nth"))


def commit_snapshots(table: VersionedTable, entries: DataFrame, now: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """Commit whole snapshot files, oldest first, as one version of the table; (file, agent, ..., applied, errors) of each.

    entries: file, agent, position, entry. What applies is what the plan of each file says, with the files before it committed: a
    new row whose URL an earlier file brings is a duplicate, and of several changes to a column of one row the last one stays. A
    file that the log holds already is refused as a whole: it has no row in the result. An entry whose changes name a column that
    the table lacks is an error and applies nothing. New rows without an id get one from their URL; one whose id is taken is an
    error. Changes of ids that the table lacks count as applied and do nothing, as for any update by predicate. columns: for each column
    of a new row, its value from `entry`; other columns are null."""
    m = table.manifest()
    schema = StructType.fromJson(json.loads(m["schema"]))
    names = [f.name for f in schema.fields]
    fresh = entries.join(table.log(m["version"]).select("file").distinct(), "file", "left_anti")
    current = table.read(m["version"])
    planned = materialised(s.plan(fresh, current), "planned").join(_order(fresh), "file")
    place = F.struct("nth", "position")

    patched = s.patches(planned, now, keep=["nth", "position"])
    known = F.array(*map(F.lit, names))
    bad = F.size(F.array_except(F.map_keys("columns"), known)) > 0
    patched = materialised(patched.withColumn("bad", bad), "patches")
    sets = patched.filter("not bad").select("id", F.explode("columns").alias("column", "value"), "nth", "position")
    last = sets.groupBy("id", "column").agg(F.max_by("value", place).alias("value"))
    columns_of = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("columns"))  # no more than the table's columns

    e = F.col("entry")
    key = s.weak_key(e)
    rows = planned.filter("verdict = 'applied' and agent = 'scraper'").withColumn("key", key).withColumn("id", F.coalesce(F.nullif(e["id"], F.lit("")), F.concat(F.lit("u"), F.substring(F.md5("key"), 1, 16))))
    firsts = rows.groupBy("key").agg(F.min(place).alias("first"))
    rows = rows.join(firsts, "key").withColumn("repeat", F.col("first") < place)
    by_id = rows.filter("not repeat").groupBy("id").agg(F.min(place).alias("first_id"))
    rows = rows.join(by_id, "id", "left").join(current.select(F.col(table.key).alias("id"), F.lit(True).alias("taken")), "id", "left")
    rows = materialised(rows.withColumn("taken", F.coalesce("taken", F.lit(False)) | (F.col("first_id") < place)), "inserts")
    value = {"id": F.col("id"), "is_active": F.lit(False), "url": e["url"], "name": e["name"], **(columns or {})}
    row = F.struct(*(value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
    added = rows.filter("not repeat and not taken").select(F.col("id").alias(table.key), F.lit("insert").alias("op"), row.alias("row"), F.lit(None).cast("map<string,string>").alias("columns"))
    changes = added.unionByName(columns_of.select(F.col("id").alias(table.key), F.lit("patch").alias("op"), F.lit(None).cast(row_type(schema)).alias("row"), "columns"))

    counts = s.commit_counts(planned)
    wrong = patched.filter("bad").groupBy("file").agg(F.count(F.lit(1)).alias("bad"))
    twice = rows.groupBy("file").agg(F.count_if("repeat").alias("repeats"), F.count_if(F.col("taken") & ~F.col("repeat")).alias("taken"))
    counts = counts.join(wrong, "file", "left").join(twice, "file", "left").na.fill(0, ["bad", "repeats", "taken"])
    log = counts.select("file", "agent", F.lit(now).cast("timestamp_ntz").alias("committed_at"), "entries", (F.col("applied") - F.col("bad") - F.col("repeats") - F.col("taken")).alias("applied"), "skipped_no_change", (F.col("skipped_duplicate") + F.col("repeats")).alias("skipped_duplicate"), (F.col("bad") + F.col("taken")).alias("errors"))
    log = materialised(log, "commit_log")
    if not log.isEmpty():
        table.changed(changes, log, m["version"])
    return log


def row_type(schema: StructType) -> str:
    return schema.simpleString()
