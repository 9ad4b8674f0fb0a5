"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, redact, encode.

Every stage takes all documents that the one before kept, and its decision takes effect: what
it rejects is gone from later stages, what it redacts stays redacted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from salesmart.llm import bpe, decontaminate, neardup, pii, quality
from salesmart.llm.common import table
from salesmart.sources.staging import stage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates."""
    return neardup.deduplicate(docs, size=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars counts anew."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), keep_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicate removal", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("personal data", redact),
    ("byte-level BPE", encode),
]

#: A trained classifier and a tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
