"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import ann, bpe, chat_format, license_scan, merkle, paragraph_sketch, prefix_trie, quality, secret_scan, simhash, tokens, toxicity, winnowing
from larkspur.session import table


def span_encoder() -> tokens.SpanEncoder:
    return tokens.SpanEncoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.op1(table(spark, sf_dir, "conversations"), span_encoder())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"), span_encoder())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op3(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op4(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op6(table(spark, sf_dir, "embeddings"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op7(table(spark, sf_dir, "documents"))


def op8_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op11(table(spark, sf_dir, "conversations"))


def op12_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.op12(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_token_counts, op3_bpe, op4_secrets, op5_quality, op6_neighbours, op7_licenses, op8_benchmark_overlap, op9_toxicity, op10_simhash_groups, op11_prefix_trie, op12_paragraph_sketch, op13_merkle_manifest)
}
ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE_SQL,
    "op4_secrets": secret_scan.ORACLE_SQL,
    "op7_licenses": license_scan.ORACLE_SQL,
    "op8_benchmark_overlap": winnowing.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
