"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept.
All but the last return the columns of ``documents``.

Executors and their Python workers live as long as the session, so what one stage holds counts in the
next.  Stages hand texts to Python in batches of at most 4 MB, which they set in the session, and a
packing task gives its tokenizer back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import catalogue, near_copies, packing, quality, scratch, substring_dedup

BATCH_BYTES = 4 << 20
TASK_WORDS = 1 << 16
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the document with the smallest id stays."""
    return near_copies.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document with a smaller id has too go."""
    return substring_dedup.dedup(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    return packing.pack(docs, catalogue.vocabulary("word_bpe_49k.json"), task_words=TASK_WORDS)


def _small_batches(stage: Stage) -> Stage:
    """Lowers the bytes of an Arrow batch for the session; a smaller value that it has stays."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", spark.conf.get(_BATCH).lower()).groups()
        if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
            spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(stage.__name__, _small_batches(stage)) for stage in (quality_filter, near_duplicates, repeated_passages, packed_sequences)]

ORACLE_SQL = None  # a trained score and a packing have no SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
