"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes what its predecessor kept, and its decisions take effect: rejected and
repeated documents go, secrets are masked, sources are mixed to their targets (documents
may come twice), and what is left is encoded. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside.llm import bpe, mixing, quality, secrets, simhash
from quayside.session import scratch_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by SimHash: 3-word shingles, 3 bits."""
    return simhash.keep_one(docs, width=3, k=3)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every found secret masked; n_chars follows the text."""
    net = secrets.train_findings(secrets.finding_rows(docs))
    masked = secrets.mask_secrets(docs, net)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to weights 5, 2, 1 over 150 % of all words; a row per copy taken."""
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the encoded and decoded text of every row."""
    return bpe.bpe_round_trip(docs, "byte_bpe_50k.json")


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

# No SQL statement can express the fitted models, the hashes and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written to shared storage
    and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_dir(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
