"""Session settings shared by the tests, the benchmark and ad hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "12g", app: str = "quillspark") -> SparkSession:
    """A local session; a cluster brings its own settings instead."""
    os.environ.setdefault("TZ", "UTC")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
