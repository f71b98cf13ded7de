"""From raw documents to packed training sequences: rules, classifier, near-dedup, secrets, packing.

Each stage works on all that the one before kept, and all but the last return the columns
of documents, extra ones included, whatever their names. SQL can't express the fitted
stages; tests compare each with brute force.

Null and empty texts have no words and go with the first stage, as do texts of fewer than
ten words. Very long texts are read, scored, compared and packed whole. Rows without an id
are judged like any other and are nobody's near-duplicate; of rows that repeat an id one
stays. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import staged
from weftline.llm.near_dedup import deduplicated
from weftline.llm.packing import packed
from weftline.llm.quality_gbt import accepted
from weftline.llm.quality_rules import passed
from weftline.llm.secrets import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    return passed(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by the name of their kind."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces of sequences of 1,024 tokens."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
