"""The corpus pipeline: five stages over a table of documents, each a DataFrame for the next.

Counted as part of the subpackage ``squall.llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from squall.llm import byte_bpe, decontaminate, ngram_join, quality, toxicity
from squall.llm.common import Scratch, pinned, table

#: Rows that go to a Python worker at once. Workers live through all stages, so each is to hold less
#: than Spark's default of 10,000 whole texts.
ROWS_AT_ONCE = ("spark.sql.execution.arrow.maxRecordsPerBatch", "200")


def _small_batches(spark: SparkSession) -> None:
    """Set ROWS_AT_ONCE for the session, unless it has a value of its own."""
    if spark.conf.get(ROWS_AT_ONCE[0], None) is None:
        spark.conf.set(*ROWS_AT_ONCE)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score reaches 0.7."""
    _small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose posterior quality is under one half."""
    _small_batches(spark)
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near copies (five-word shingles,
    similarity 0.8)."""
    _small_batches(spark)
    return ngram_join.drop_near_copies(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item or a near copy of one."""
    _small_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents left, and whether decoding gives them back. The
    workers have run the other stages before, so less is kept in their memory than by default."""
    _small_batches(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), most=60_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Trees, calibration and merges are beyond SQL; the stages are tested on planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage
    read is removed once its own rows are written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = Scratch(spark)
        docs = written.pin(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if read:
            read.drop()
        read = written
    out = pinned(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
    read.drop()
    return out
