"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing, one written stage after the other.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crowdspark.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from crowdspark.llm.common import materialize, read_table, run_dir
from crowdspark.llm.queries import word_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the learned rules keep."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"), run_dir(spark, "pipeline-quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs, run_dir(spark, "pipeline-exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links."""
    return near_dedup.drop_near_duplicates(docs, run_dir(spark, "pipeline-near"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of domains draws them: those of a domain below its weight repeat."""
    fitted = mixing.fit_mixture(docs, read_table(spark, sf_dir, "labels"), mixing.WEIGHTS, run_dir(spark, "pipeline-mix"))
    return mixing.mix_documents(docs, fitted)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, word_bpe(), 2048, 1)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: The learned rules, the classifier and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, run_dir(spark, f"pipeline-stage-{i}"))
    return docs
