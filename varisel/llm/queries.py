"""Queries opN_<name>: each numbered operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, oracles


def word_bpe() -> str:
    """The tokenizer's file; it is read where it lies and never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(common.table(spark, sf_dir, "documents"), word_bpe())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    placed = shard_documents(common.table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_texts

    return score_texts(common.table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversations, format_preferences, preference_pairs

    pairs = preference_pairs(common.written(conversations(common.table(spark, sf_dir, "conversations")), "conversations"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), ",").alias(c)
    return format_preferences(pairs).select(F.col("pair_id").alias("conv_id"), "rejected_id", "n_common", "prompt", "chosen", shown("chosen_spans"), "rejected", shown("rejected_spans"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .token_output import document_digests, read_token_files, write_token_files

    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(common.table(spark, sf_dir, "documents"), path, word_bpe())
    return document_digests(read_token_files(spark, path))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("text_hash")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects, with their scores."""
    from .quality import select

    return select(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")).drop("text")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import top_k

    return top_k(common.table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    found = leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_shingles", "shared", "total", "similarity")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(common.table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repaired

    return repaired(common.table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_sharding, op3_lm_scoring, op4_chat, op5_token_output, op6_quality, op7_simhash, op8_top_k, op9_decontamination, op10_line_dedup, op11_minhash, op12_spelling, op13_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": oracles.OP4, "op8_top_k": oracles.OP8, "op9_decontamination": oracles.OP9, "op11_minhash": oracles.OP11, "op12_spelling": oracles.OP12, "op13_repair": oracles.OP13}
