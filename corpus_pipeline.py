"""A corpus cleaned and packed: five stages, each over all that the one before kept.

toxicity (rejected documents go), exact duplicates (the largest doc_id of equal texts stays), near duplicates (shingles of
five words, similarity 0.8; the smallest doc_id of each linked group stays), secrets (their spans are replaced, no document goes), packing into token sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.functions.session import stored
from fieldmerge.llm import dedup, near, packing, secrets, toxicity
from fieldmerge.llm.common import table


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the model learns from the labelled rows among docs that are not held out."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty) one row, that with the largest doc_id; see drop_exact_duplicates for ties."""
    return dedup.drop_exact_duplicates(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at similarity 0.8 one row, that with the smallest doc_id; unrelated rows stay, whatever their doc_id."""
    return near.drop_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text and counts its characters anew; names that docs use often prime the compressor. No row goes."""
    return secrets.redact_secrets(docs, known=secrets.learnt_identifiers(docs)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 1024 tokens, with its ids and its place."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


STAGES = [
    ("toxicity", keep_civil),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_near_copy),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Scores and fingerprints are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage written to the shared folder and read again.

    Null texts count as empty, null doc_ids stay, rows that repeat in every column count as exact copies, extra columns of
    documents go along up to packing, and an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
