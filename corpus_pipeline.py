"""From raw documents to packed token sequences: five stages, each one operator of textloom.llm.

Every stage takes the documents that the one before kept and its decisions take effect: documents that language
identification rejects go, of equal and of nearly equal documents one stays, secrets are cut out of the texts,
and what remains is packed. All stages but the last return the columns of documents.

Defined results: a null or empty text has no language and goes in the first stage, as a text of digits does; texts of
any length are handled whole; of rows equal in doc_id and text one stays, and rows that share a doc_id alone are told
apart by their texts; of equal texts the largest doc_id stays, of near copies the smallest; a row without doc_id can't
be linked to near copies and stays; an empty table, or one without labelled rows, gives no pieces; columns beyond
those of documents are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exactdedup, language, packing, secrets, simhash
from textloom.llm.common import checkpoint_folder, removed, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those too far from every language's centroids."""
    docs = docs.select(COLUMNS)
    return language.keep_known(docs, language.fit(language.training_rows(docs)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the largest doc_id."""
    docs = docs.select(COLUMNS)
    return exactdedup.keep_first(docs, exactdedup.find_groups(docs, exactdedup.newer_half(F.col("doc_id"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share at least 0.8 of their shingles of five words, directly or in turn, keeps the smallest doc_id."""
    docs = docs.select(COLUMNS)
    return simhash.keep_least(docs, simhash.find_similar(docs))


def cut_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span that the secret scan reports; all documents stay."""
    return secrets.redact(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", cut_out_secrets),
    ("packing", pack),
]

#: SQL can express neither centroids nor fingerprints nor column generation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a Parquet table in the shared checkpoint folder, until the next is written."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
