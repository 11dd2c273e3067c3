"""A corpus pipeline: quality, near duplicates, benchmark leaks, source mixing, token files.

Every stage works on all rows that the one before kept, and its decisions take effect. All but the last return the
columns of documents.

Defined results: a null text is an empty one to the classifier, has no words, links with nothing, and takes no part in
mixing, as documents without words do not; rows without a doc_id are never near copies or leaks and stay; rows that repeat a
doc_id and its text go the same way at every stage and are one row after mixing takes them together; of linked documents the
least doc_id stays; an empty table gives an empty result. Other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, jaccard, mixing, quality, token_files
from quillspark.llm.common import drop, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from the labelled documents among them."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).filter("quality_score >= 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of linked documents; rows without an id stay."""
    groups = jaccard.similar_groups(docs)
    copies = groups.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    hits = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select(*decontaminate.KEY)
    return decontaminate.keyed(docs).join(hits, list(decontaminate.KEY), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, each once for every epoch that takes it."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents, described as read back."""
    return token_files.tokens_of(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]

#: No SQL can express the classifier and the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_").replace("/", "_"))
        if before is not None:
            drop(before)  # nothing reads the stage before last any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
