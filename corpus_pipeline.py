"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes the documents that its predecessor kept, as a table; what it decides
takes effect: lines and documents that fail quality rules go, one document of each
near-duplicate group stays, secrets are replaced by a mark, sources are mixed to their
weights (a document comes as often as the mix takes it), and texts become token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, near, quality, secret_scan
from millrace.session import discard, materialize, spread

#: No SQL: components of a near-duplicate graph, entropy windows and BPE are beyond it.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` as it is after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    return _sized(quality.keep_clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8): that of smallest id.

    SimHash finds candidates by blocks, MinHash bands complete them, and all are verified.
    """
    return near.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return _sized(secret_scan.redact(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of what they decode to."""
    return bpe.tokenize(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
