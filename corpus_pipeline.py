"""A training corpus from documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bpe, decontaminate, pii, simhash, toxicity
from pairloom.llm.common import pinned, read
from pairloom.llm.vocabulary import rank_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"), threshold=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints lie within 3 bits, step by step: the one with the smallest id."""
    return simhash.without_near_duplicates(docs, radius=3, shingle=3, seed=42)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark passage."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` counts the new text's characters."""
    masked = pii.redacted(docs)
    counted = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", counted)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids, packed as little-endian 32-bit numbers, with the digests of the ids and of the decoded bytes."""
    ranks = rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    # Small blocks: the stages before have grown the executors, and every task has little room left.
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_chars=3_000_000)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("byte_level_bpe", encode_tokens),
]

# A learned lexicon, an iterated graph of links and the tokenizer's merges have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = pinned(stage(spark, docs, sf_dir))
    return docs
