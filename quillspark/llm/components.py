"""Connected components of a table of links, by spreading the least id and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b. (id, component) of every linked id, the component's least id; each round is a table in the shared folder.

    A round takes the least label among neighbours, then the label of that label, so a star is done after one round
    and a chain after about the logarithm of its length. Hot ids are aggregated before they are shuffled.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        own = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        ahead = labels.select(F.col("id").alias("to"), F.col("component").alias("jump"))
        following = written(own.join(ahead, "to", "left").select("id", F.least("to", F.coalesce("jump", "to")).alias("component"), (F.col("was") != F.least("to", F.coalesce("jump", "to"))).alias("moved")), "labels")
        drop(labels)
        labels = following.select("id", "component")
        labels._quill_path = following._quill_path
        if following.filter("moved").limit(1).count() == 0:
            drop(edges)
            return labels
