"""A corpus pipeline: each stage keeps, drops or changes the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm.decontam import drop_contaminated
from vectorloom.llm.jaccard_join import keep_one_of_each
from vectorloom.llm.mixing import mix_sources
from vectorloom.llm.quality import drop_rejected
from vectorloom.llm.secrets import redact_secrets
from vectorloom.llm.shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored like others, repeated rows share their fate."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at Jaccard 0.8 over five-word shingles the smallest doc_id stays.

    Texts without words link with nothing and stay; so do rows without a doc_id.
    """
    return keep_one_of_each(docs, words=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no row goes, null texts stay null."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; a null source is one of its own, texts without words give 0."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("source mix", mix),
]

#: The classifier and the tiling are not expressible in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again. An empty table passes through all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
