"""The thin queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exactdedup, language, licenses, merkle, oracles, packing, repeats, secrets, sharding, simhash, sketch, tokencount
from .common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(language.training_rows(docs))
    return language.predict(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.find_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.written(F.col("print")).alias("fingerprint"), "component_id")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exactdedup.find_groups(docs, exactdedup.newer_half(F.col("doc_id")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return merkle.verify_documents(table(spark, sf_dir, "documents"), tampered, F.col("n_chars") + 1)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_sharding": op2_sharding,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_packing": op4_packing,
    "op5_language_id": op5_language_id,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_token_counts": op8_token_counts,
    "op9_license_scans": op9_license_scans,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_alignment": op11_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

ORACLES: dict[str, str] = oracles.ORACLES
