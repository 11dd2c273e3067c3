"""Connected parts of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.shared import materialised


def parts(links: DataFrame) -> DataFrame:
    """links: a, b. (node, part) of every node that has links; a part is named by its least node. Runs jobs when it is called.

    In each round a node takes the least name among its neighbours' and its own, then the name of the node that it is named by, so a chain
    of n nodes is done in about log n rounds. A round is one table in the shared folder."""
    both = materialised(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    named = materialised(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("part")).withColumnRenamed("a", "node"), "parts")
    while True:
        near = both.join(named.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near"))
        least = named.join(near, "node").select("node", F.col("part").alias("was"), F.least("part", "near").alias("to"))
        ahead = named.select(F.col("node").alias("to"), F.col("part").alias("further"))
        after = least.join(ahead, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("part"), "was")
        after = materialised(after.withColumn("moved", F.col("part") != F.col("was")), "parts")
        named = after.select("node", "part")
        if after.filter("moved").isEmpty():
            return named
