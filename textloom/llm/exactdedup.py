"""Exact deduplication of incoming documents against an immutable snapshot.

Texts are equal if they are identical after lower-casing A-Z. A snapshot is saved once (``save_snapshot``): its
groups of equal texts, one row for each digest in buckets by range of the digest, and a static binary fuse filter of
about ``KEYS`` digests for each range. Any number of later batches are compared with the saved tables
(``compare``); neither the snapshot's documents nor its filters are made again. An incoming batch is grouped
by digest on its own first (its duplicates among itself need no filter); the filter of its range screens each
distinct digest once. Digests that pass join the snapshot's exact buckets, where the bytes of one text of
either side are compared, and only equal bytes merge the two groups.

Hot groups: copies are counted map-side, so a digest reaches the filters once however often it occurs; in the
last join a large group's copies meet its row in parts.

Defined results: null text counts as empty; of equal rows (same text, same doc_id) exactly one is kept; a row
without doc_id is kept only if all of its group lack one; texts of any length are compared whole; an empty table gives
no rows, an empty snapshot holds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import fuse
from .common import ascii_lower, checkpoint_folder, counted, durable, fresh, met_in_parts

#: Distinct digests of a filter, about.
KEYS = 1 << 13


def normalized(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def text_digest(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def digests(docs: DataFrame, incoming: Column) -> DataFrame:
    """(doc_id, incoming, digest): the lower-case SHA-256 of the normalised text in hexadecimal."""

    ship(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.large_binary())
            found = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("incoming"), pa.array(found, pa.string())], ["doc_id", "incoming", "digest"])

    return docs.select("doc_id", "text", incoming.alias("incoming")).mapInArrow(work, "doc_id long, incoming boolean, digest string")


def key_of(digests_: pd.Series) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in digests_], np.uint64)


def build_filters(groups: DataFrame, ranges: int) -> DataFrame:
    """(part, filter): one binary fuse filter for each range of digests; groups has distinct digests."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": frame["part"][:1], "filter": [fuse.build(key_of(frame["digest"]))]})

    return groups.select(part_of(ranges), "digest").groupBy("part").applyInPandas(work, "part int, filter binary")


def part_of(ranges: int) -> Column:
    return F.pmod(F.conv(F.substring("digest", 17, 8), 16, 10).cast("long"), F.lit(ranges)).cast("int").alias("part")


def screened(groups: DataFrame, filters: DataFrame, ranges: int) -> DataFrame:
    """The digests of the groups that the filter of their range may hold."""

    def work(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        passed = fuse.holds(held["filter"].iloc[0], key_of(own["digest"])) if len(own) and len(held) else np.zeros(len(own), bool)
        return own.loc[passed, ["digest"]]

    return groups.select(part_of(ranges), "digest").groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(work, "digest string")


def texts_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, digest, body): the normalised texts of the wanted documents."""
    ids = counted(wanted.select("doc_id").distinct())
    found = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return found.select("doc_id", text_digest(F.col("text")).alias("digest"), normalized(F.col("text")).alias("body"))


def same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The digests of pairs (digest, old_id, new_id) whose two texts are equal byte for byte."""
    wanted = pairs.select("digest", F.explode(F.array_distinct(F.array("old_id", "new_id"))).alias("doc_id"))
    bodies = texts_for(docs, wanted).join(wanted, ["digest", "doc_id"], "left_semi")
    return bodies.groupBy("digest").agg((F.min("body") == F.max("body")).alias("same")).filter("same").select("digest")


def grouped(rows: DataFrame, row: str) -> DataFrame:
    """(digest, best, n) of rows (doc_id, digest, row); best is the row that stays."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", row)).alias("best"), F.count(F.lit(1)).alias("n"))


def write_snapshot(groups: DataFrame, folder: str) -> None:
    """Tables below the folder, in a file system that all executors share: groups (digest, best, n), filters (part, filter)."""
    groups.write.parquet(f"{folder}/groups")
    saved = groups.sparkSession.read.parquet(f"{folder}/groups")
    ranges = max(1, saved.count() // KEYS)
    build_filters(saved, ranges).withColumn("ranges", F.lit(ranges)).write.parquet(f"{folder}/filters")


def save_snapshot(docs: DataFrame, folder: str) -> None:
    """Saves an immutable snapshot of documents (doc_id, text): a row for each distinct text, and the filters."""
    rows = durable(digests(docs, F.lit(False)).withColumn("row", F.monotonically_increasing_id()))  # row numbers must not change
    write_snapshot(grouped(rows, "row").select("digest", F.struct("best.doc_id", "best.row").alias("best"), "n"), folder)


def compare(spark: SparkSession, folder: str, new: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, old, old_n, new, new_n): the groups of a batch (digest, best, n) that the snapshot holds too.

    texts: (doc_id, text) of both sides, from which the bytes of one text of either side are fetched.
    """
    old, filters = spark.read.parquet(f"{folder}/groups"), spark.read.parquet(f"{folder}/filters")
    first = filters.select("ranges").first()
    if first is None:  # an empty snapshot has no filters
        passed = new.select("digest").limit(0)
    else:
        passed = screened(new, filters.select("part", "filter"), first["ranges"])
    own = new.select("digest", F.col("best").alias("new"), F.col("n").alias("new_n"))
    meet = durable(passed.join(own, "digest").join(old.select("digest", F.col("best").alias("old"), F.col("n").alias("old_n")), "digest"))
    pairs = meet.filter("old.doc_id is not null and new.doc_id is not null").select("digest", F.col("old.doc_id").alias("old_id"), F.col("new.doc_id").alias("new_id"))
    unnamed = meet.filter("old.doc_id is null or new.doc_id is null").select("digest")  # nothing to fetch the text by; the 256-bit digest decides
    return meet.join(same_bytes(texts, pairs).unionByName(unnamed), "digest", "left_semi")


def screen_batch(docs: DataFrame, folder: str, snapshot_texts: DataFrame) -> DataFrame:
    """A row for each document of a later batch: doc_id, digest, keep_id, group_size, kept, held by the snapshot.

    What the snapshot holds goes, whatever its doc_id, as the snapshot can't change; of texts that are new, the row with
    the largest doc_id stays. Sizes count the snapshot's copies.
    """
    row = fresh("row")
    rows = durable(digests(docs, F.lit(True)).withColumn(row, F.monotonically_increasing_id()))
    new = durable(grouped(rows, row))
    both = docs.select("doc_id", "text").unionByName(snapshot_texts.select("doc_id", "text"))
    held = compare(docs.sparkSession, folder, new, both).select("digest", F.col("old.doc_id").alias("old_id"), "old_n")
    final = new.join(held, "digest", "left")
    there = F.col("old_n").isNotNull()
    return met_in_parts(rows, final, ["digest"], row, new).select(
        "doc_id",
        "digest",
        F.when(there, F.col("old_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("group_size"),
        (~there & (F.col(row) == F.col(f"best.{row}"))).alias("kept"),
        there.alias("held"),
    )


def find_groups(docs: DataFrame, incoming: Column) -> DataFrame:
    """A row for each document: doc_id, digest, keep_id, group_size, kept.

    Documents that aren't incoming are saved as a snapshot; the incoming ones are compared with it.
    """
    spark, folder = docs.sparkSession, f"{checkpoint_folder(docs.sparkSession)}/snapshot-{uuid.uuid4().hex}"
    rows = durable(digests(docs, incoming).withColumn("row", F.monotonically_increasing_id()))  # row numbers must not change
    write_snapshot(grouped(rows.filter("not incoming"), "row"), folder)
    new = durable(grouped(rows.filter("incoming"), "row"))
    merged = compare(spark, folder, new, docs).select("digest", F.greatest("old", "new").alias("all_best"), (F.col("old_n") + F.col("new_n")).alias("all_n"))
    groups = spark.read.parquet(f"{folder}/groups").withColumn("incoming", F.lit(False)).unionByName(new.withColumn("incoming", F.lit(True)))
    final = groups.join(merged, "digest", "left").select("digest", "incoming", "n", F.coalesce("all_best", "best").alias("best"), F.coalesce("all_n", "n").alias("group_size"))
    return met_in_parts(rows, final, ["digest", "incoming"], "row", groups).select("doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))


def newer_half(ids: Column) -> Column:
    """Which documents count as the incoming batch where a table comes without one: half of them, by a hash of the id."""
    return F.coalesce(F.pmod(F.xxhash64(ids, F.lit(3)), F.lit(2)) == 1, F.lit(True))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents, all columns, that their group keeps; of rows equal in id and text, one."""
    mark, id_, held, n = fresh("digest"), fresh("id"), fresh("held"), fresh("n")
    states = groups.groupBy(F.col("doc_id").alias(id_), F.col("digest").alias(mark)).agg(F.max("kept").alias(held), F.count(F.lit(1)).alias(n))
    special = durable(states.filter(~F.col(held) | (F.col(n) > 1)))
    on = [F.col("doc_id").eqNullSafe(F.col(id_)), text_digest(F.col("text")) == F.col(mark)]
    clear = docs.join(counted(special), on, "left_anti")
    twice = docs.join(counted(special.filter(F.col(held))), on, "left_semi").dropDuplicates(["doc_id", "text"])
    return clear.unionByName(twice)
