"""The corpus pipeline: toxicity, language, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes every stage's
frame as Parquet to the shared folder and hands the reread table to the next stage.  The
filtering stages return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradescope.llm.common import table
from tradescope.llm.language_id import fit_language_filters, keep_identified
from tradescope.llm.packing import pack
from tradescope.llm.simhash_dedup import keep_one
from tradescope.llm.toxicity import drop_toxic, fit_toxicity
from tradescope.operators.staging import stage

# A document goes when its toxicity reaches this.
TOXIC = 0.3
# A document goes when less than this share of its n-grams belongs to its language.
LEAST_LANGUAGE = 0.3
# Documents are near copies when their fingerprints of so many words differ in so few bits.
SHINGLE, BITS = 4, 4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity of ``TOXIC`` or more."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), TOXIC)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those that no learned language explains."""
    return keep_identified(docs, fit_language_filters(docs), LEAST_LANGUAGE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every component of linked fingerprints."""
    return keep_one(docs, width=SHINGLE, radius=BITS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_copies", near_copies),
    ("packing", packing),
]

# Learned models and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
