"""Places in an order over all rows, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.sources.shared import materialised

_BITS = 33  # of monotonically_increasing_id(): the row in its partition below, the partition above


def numbered(rows: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """row_number() over the order, whose last key is unique: sorted ranges, rows counted per range, and a running sum over the ranges.

    Ranges are cut by the whole order, so a common leading value is spread over several. They are written once, as another
    evaluation could cut them elsewhere. The table that is broadcast has a row for each range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order, strict=True)))
    cut = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_at", F.monotonically_increasing_id())
    cut = materialised(cut, "numbered").withColumn("_range", F.shiftright("_at", _BITS))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    nth = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    return cut.join(F.broadcast(before), "_range").withColumn(place, F.col("_before") + nth).drop("_at", "_range", "_before")
