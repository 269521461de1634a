"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that the one before kept, as a stored table, and
all but the last return documents with the columns they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relflow.llm import common, importance, minhash, mixing, packing, secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling: the documents outside the sample go."""
    sampler, _ = importance.sampler(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return sampler.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SuperMinHash near-duplicates (five-word shingles, similarity 0.8 or more):
    one document of each group stays."""
    return minhash.distinct_documents(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blob ledger scan: secrets are replaced by their kind in the texts."""
    return secrets.redacted_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact source quotas: each document as often as the mix takes it."""
    return mixing.mixed_documents(mixing.mix(docs, block_words=None))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places: ``sequence_id`` and ``offset``."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None       # the first and fourth stage draw by hash; tests replay all five by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.step(spark, lambda: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
