"""Registered queries of this package over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qplate.llm.common import load


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.suffix_dedup import remove_repeats
    return remove_repeats(load(spark, sf_dir, "documents"), length=200)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.line_dedup import drop_common_lines
    return drop_common_lines(load(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.decontaminate import decontaminate
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("k1", "k2")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.warc import read_archives, write_archives
    return read_archives(write_archives(load(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.packing import pack
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, longest=2048).drop("bucket")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations, a row per turn's piece: roles recovered by a model fitted on four fifths of them."""
    from qplate.llm import transcripts as T
    from qplate.llm.transcript_source import transcripts
    src = transcripts(load(spark, sf_dir, "conversations")).withColumn("truth", F.when(F.col("fold") < 4, F.col("truth")))
    placed = T.pieces(src, truth_col="truth")
    blocked = T.blocks(placed)
    return T.format_chats(placed, blocked, T.fit(blocked)).select(
        F.col("conv").cast("long").alias("conv_id"), F.col("ord").alias("turn"), "n_lines", "n_turns", "states", "rendered")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.token_files import read_token_files, write_token_files
    return read_token_files(write_token_files(load(spark, sf_dir, "documents"),
                                              public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.quality import quality_rules
    return quality_rules(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.secret_scan import scan, train
    docs = load(spark, sf_dir, "documents")
    return scan(docs, train(docs))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.near_dedup import near_duplicates
    return near_duplicates(load(spark, sf_dir, "documents"), percent=75, size=5).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.spelling import variants
    return variants(load(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.merkle import manifest, without_newlines
    altered, where = without_newlines("text", "doc_id")
    return manifest(load(spark, sf_dir, "documents"), altered=altered, where=where).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from qplate.llm.language_id import identify, train
    docs = load(spark, sf_dir, "documents")
    return identify(docs, train(docs))


REGISTRY = {f.__name__: f for f in (
    op1_suffix_dedup, op2_line_dedup, op3_decontaminate, op4_warc, op5_packing, op6_chat_formatting, op7_token_files,
    op8_quality_rules, op9_secret_scan, op10_near_dedup, op11_spelling, op12_merkle, op13_language_id)}
