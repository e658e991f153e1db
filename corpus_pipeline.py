"""The corpus pipeline: documents in, token counts and digests of the kept texts out.

Each stage's result is written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import byte_bpe, decontaminate, language_id, simhash, suffix_dedup
from strata.llm.common import staged, table, unstage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.keep_identified(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(spark, docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of passages that others share."""
    return suffix_dedup.cut_repeats(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item: one is enough to leak it."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, and digests of its ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", languages),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", passages),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: The stages aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        kept = staged(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            unstage(spark, docs)
        docs = kept
    return docs
