"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again. All stages but the last return the columns of ``documents``. Part of the subpackage ``tidemark.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, jaccard, mixing, quality, tokens
from tidemark.llm.shared import saved, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject (score of 0.7 at least)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by 5-word shingles at a similarity of 0.8."""
    return jaccard.keep_one(docs, stored=True)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the rule of op10."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.emit(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents; the digest of what is read back from them."""
    return tokens.tokenized(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources", mix_sources),
    ("token files", write_tokens),
]

#: Compression, suffix arrays and tokenisation are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
