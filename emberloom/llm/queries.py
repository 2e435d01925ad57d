"""The queries that apply this package's operators to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, cover_tree, html_text, line_dedup, mixing, pieces, quality_rules, repair, sharding, simhash, suffix_dedup, token_align
from .common import table
from .oracles import ORACLES


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", F.col("_words").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "_copies")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op 1 says of each source."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("source", F.col("_source_size").alias("source_size"), F.round("_target", 6).alias("target")).distinct()


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op 2's law says of each shard: its rows, and slots without gaps from 0."""
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), text=None)


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_replies(table(spark, sf_dir, "conversations"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.link_documents(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_hilbert_sharding": op2_hilbert_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_cover_tree": op5_cover_tree,
    "op6_simhash": op6_simhash,
    "op7_pieces": op7_pieces,
    "op8_html_text": op8_html_text,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chat_quotes": op10_chat_quotes,
    "op11_token_align": op11_token_align,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_line_dedup": op13_line_dedup,
    "mixing_targets": mixing_targets,
    "shard_sizes": shard_sizes,
}
