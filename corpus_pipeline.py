"""The training-data pipeline: five stages over ``documents``, each written as a table and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the last
return the columns of ``docs`` as they came, extra ones included; a stage's own columns never meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import packing, quality, secret_scan, simhash, suffixes
from wardlight.llm.common import read
from wardlight.llm.tokens import public_tokenizer
from wardlight.session import materialise

END_ID = 1


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learned from the labels of the input itself.

    A null text counts as empty and is scored like one; repeated rows are scored alike.
    """
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest id; see ``simhash.drop_near_duplicates`` for null and repeated ids."""
    return simhash.drop_near_duplicates(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a twentieth of their words in benchmark windows; null texts have no words and stay."""
    return suffixes.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and ``n_chars`` set anew where that happened."""
    words = secret_scan.Words(secret_scan.vocabulary_words(public_tokenizer("word_bpe_49k.json")))
    return secret_scan.redact(docs, secret_scan.train(spark, words), path_col="source" if "source" in docs.columns else None,
                              length_col="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; an empty or null text is its end id."""
    pieces = packing.pack(docs, public_tokenizer("byte_bpe_50k.json"), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_classifier", good_quality), ("simhash_near_dedup", one_of_each), ("benchmark_decontamination", not_in_benchmark),
          ("secret_scans", without_secrets), ("packing", packed)]

# Stages learn models, hash and tokenise: SQL cannot express them. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
