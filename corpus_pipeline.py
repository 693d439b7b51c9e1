"""The corpus pipeline: quality classifier, host rules, line dedup, near-dedup, length buckets.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last return
the columns of ``documents``; what a stage returns is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chosen_path, host_rules, length_buckets, line_setjoin, quality_gam
from ledgerloom.llm.common import prepare, read, staged

#: SQL has no boosting, and the later stages work on what the classifier keeps.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1; it is fitted on the labels outside the held-out quarter."""
    prepare(spark)
    model = quality_gam.train(docs, read(spark, sf_dir, "labels"))
    return quality_gam.scored(docs, model, score="__score").filter(F.col("__score") >= quality_gam.THRESHOLD).drop("__score")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their host's rate reject."""
    prepare(spark)
    measured = host_rules.measure(docs, prefix="__")
    verdicts = host_rules.host_verdicts(measured, "source", "__base_failed")
    return host_rules.judge(measured, verdicts, "source", "__base_failed", "__kept").filter("__kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones (n_chars follows); a document that had
    words and loses every line with a word is a copy as a whole and goes."""
    prepare(spark)
    left = line_setjoin.dedup(docs, prefix="__")
    changed = left.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.filter((F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest id. Documents without words
    and rows without an id stay."""
    prepare(spark)
    return chosen_path.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, padded length, batch and place in the batch."""
    prepare(spark)
    return length_buckets.query(docs)


STAGES = [("quality classifier", quality), ("quality rules", rules), ("line dedup", lines), ("near-dedup", near_copies), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the packed batches."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
