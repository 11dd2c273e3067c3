"""Outside calls as injected functions over Arrow batches, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Enricher = Callable[[pd.DataFrame], pd.DataFrame]


def enriched(rows: DataFrame, enricher: Enricher, schema: str, size: int = 25) -> DataFrame:
    """Calls the enricher on at most `size` rows at a time; it must be repeatable, as a lost task calls it again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                yield enricher(frame.iloc[at : at + size])

    return rows.mapInPandas(run, schema)


def mock_dates(rows: DataFrame, as_of: str) -> DataFrame:
    """A repeatable next date 20 to 119 days ahead, from a hash of the name."""
    number = F.conv(F.substring(F.md5(F.coalesce("name", F.lit(""))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("date", F.date_add(F.to_date(F.lit(as_of)), (F.lit(20) + number % 100).cast("int")))


def mock_ranking(rows: DataFrame, order: str = "id", most: int = 12, strong: int = 4) -> DataFrame:
    """The first rows as a ranking: the leading ones are strong, the others worth a look."""
    from pyspark.sql import Window as W

    top = rows.orderBy(order).limit(most)
    n = F.row_number().over(W.orderBy(order))
    return top.select(F.col(order).alias("id"), n.alias("place"), F.when(n <= strong, "strong").otherwise("look").alias("tier"))


#: The subjects of the catalog, and those of a text that names fewer than two.
SUBJECTS = ("Mixed", "STEM", "Medicine", "Humanities", "Art", "Business", "Engineering", "Computer Science", "Mathematics", "Biology", "Physics", "Astronomy", "Chemistry", "Leadership", "Law", "Logic", "Education")
DEFAULT_SUBJECTS = ("STEM", "Mixed")


def inferred_subjects(text):
    """Subjects that a text names, five at most."""
    from quillspark.functions.text import mentions

    return mentions(text, list(SUBJECTS), 2, list(DEFAULT_SUBJECTS), 5)


def scored(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results with the score that a call gave them, best rank first; those without one go."""
    return results.join(scores.select("id", "rank", "score"), "id").orderBy("rank", "id")
