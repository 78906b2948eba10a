"""The corpus pipeline: documents in, token ids out, one operator of ``timberline.llm`` per stage.

Each stage takes what its predecessor kept. Documents may have null ids and
texts, repeated rows and extra columns; the operators' docstrings say what
becomes of them. An empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from timberline.llm import bpe, lines, minhash, mixing, quality
from timberline.llm.common import bounded_batches, table
from timberline.llm.queries import op2_columns
from timberline.session import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the likelihood ratio; the others go."""
    bounded_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came earlier; documents of which no word is left go."""
    bounded_batches(spark)
    return lines.drop_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity 0.8."""
    bounded_batches(spark)
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, counted and hashed, and the hash of what they decode to."""
    bounded_batches(spark)
    return op2_columns(bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup),
          ("mix sources", mix_sources), ("byte-level bpe", encode)]
ORACLE_SQL = None  # likelihood ratios, edit joins and BPE merges are not SQL; tests/llm/test_pipeline.py holds brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
