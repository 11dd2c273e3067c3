"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import math
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: So many rows of a large table are one task's work, and so few of a small one are worth a task.
TASK_ROWS, SMALL_ROWS = 250_000, 20_000


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where the session names nothing, a folder of our own, which only a local master can share."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^]]*\])?", conf.get("spark.master") or ""):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or f"file:///tmp/checkpoints/quillspark-{os.getpid()}").rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, read back: keys that several joins use are computed once, and lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by key to as many tasks as `rows`, its number of rows, asks for: what a task sorts or collects stays as large when the table grows."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, math.ceil(rows / TASK_ROWS), min(usual, math.ceil(rows / SMALL_ROWS))), *keys)
