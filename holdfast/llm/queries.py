"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import (
    ball_hashing, chunk_dedup, conversation_trie, language_filters, length_histogram, line_templates, positional_index,
    rotation_codes, suffix_order, token_alignment, trie_encoding, warc_bundles, weak_labels)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc_bundles.write_archive(table(spark, folder, "pages"))
    return warc_bundles.read_archive(archive, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_positional_index(spark: SparkSession, folder: str) -> DataFrame:
    return positional_index.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return length_histogram.context_limits(length_histogram.histogram(table(spark, folder, "documents")))


def op4_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return weak_labels.score_quality(table(spark, folder, "documents"))


def op5_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_trie_encoding(spark: SparkSession, folder: str) -> DataFrame:
    encoded = trie_encoding.encode(table(spark, folder, "documents"))
    return trie_encoding.digests(trie_encoding.decode(encoded))


def op7_chunk_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.exact_duplicates(table(spark, folder, "documents"))


def op8_suffix_order(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_order.remove_repeats(table(spark, folder, "documents"))


def op9_ball_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return ball_hashing.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", ball_hashing.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    return language_filters.identify(table(spark, folder, "documents"))


def op11_rotation_codes(spark: SparkSession, folder: str) -> DataFrame:
    return rotation_codes.linked_vectors(table(spark, folder, "embeddings"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, folder, "documents"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_nodes(table(spark, folder, "conversations"))


QUERIES = {q.__name__: q for q in (
    op1_warc_bundles, op2_positional_index, op3_length_histogram, op4_weak_labels, op5_line_templates, op6_trie_encoding,
    op7_chunk_recipes, op8_suffix_order, op9_ball_hashing, op10_language_filters, op11_rotation_codes,
    op12_token_alignment, op13_conversation_trie)}
