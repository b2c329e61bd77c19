"""The registered queries of the training-data operators.

Each applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradescope.llm.bpe_codec import bpe_round_trip
from tradescope.llm.chat_format import format_chats, read_back
from tradescope.llm.chat_repair import damaged, repair
from tradescope.llm.common import table
from tradescope.llm.fingerprints import compare_with_next
from tradescope.llm.language_id import fit_language_filters, identify_languages
from tradescope.llm.merkle import merkle_manifest
from tradescope.llm.oracles import MERKLE_SQL, REPAIR_SQL
from tradescope.llm.packing import pack
from tradescope.llm.pii import find_pii, fit_pii
from tradescope.llm.simhash_dedup import near_duplicates
from tradescope.llm.token_shards import read_documents, write_shards
from tradescope.llm.token_counts import token_counts
from tradescope.llm.toxicity import fit_toxicity, remainder, score_toxicity
from tradescope.llm.vector_search import nearest
from tradescope.operators.staging import stage_root


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    filters = fit_language_filters(docs, train_on=~held_out)
    return identify_languages(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', :said), (-1L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)",
        {"said": said},
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_chats(turns, path), path)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_root(spark)}/token-shards-{uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), train_on=remainder("doc_id", 4) != 2)
    return score_toxicity(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "offending"
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered)


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit_pii(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_language_id, op3_chat_format, op4_bpe_codec, op5_token_shards,
        op6_packing, op7_near_duplicates, op8_toxicity, op9_fingerprints, op10_nearest,
        op11_merkle_manifest, op12_chat_repair, op13_pii,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """What SQL can say; ``tests/llm`` holds the others against other versions."""
    return {"op11_merkle_manifest": MERKLE_SQL, "op12_chat_repair": REPAIR_SQL}
