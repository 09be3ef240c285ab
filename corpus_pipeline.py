"""The corpus pipeline: toxicity, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns
the columns of ``documents``; the last returns the packed pieces.  ``run`` applies the stages
one after another, each written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from railspark.llm import exact_dedup, near_dedup, packing, substring_dedup, toxicity
from railspark.llm.common import ship, table, written
from railspark.llm.entry import RANKS, VOCABULARY


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects (0.3 or more) go."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (A-Z lower-cased) one stays, with the smallest id."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) one row stays, with the smallest id."""
    ship(spark)
    return near_dedup.drop_near_copies(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur more than once are cut out; every row stays."""
    ship(spark)
    return substring_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack(docs, VOCABULARY, ranks=RANKS)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage),
          ("suffix_dedup", suffix_dedup_stage), ("packing", packing_stage)]

#: The classifier, sketches and best-fit plan have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
