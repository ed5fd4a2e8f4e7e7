"""What the operators of this subpackage share: reading, worker batches, durable intermediate tables, numbering."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

T = TypeVar("T")

#: Where checkpoints go if a local session names no folder (tests); a cluster has to name a shared one.
LOCAL_CHECKPOINT_DIR = "/tmp/textloom-checkpoints"
#: Rows that a worker handles at a time; text batches are further bounded by Spark's bytes per batch.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a local session without one takes its machine's own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINT_DIR


def durable(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage, so that lost executors cost nothing."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()


def written(df: DataFrame, stem: str) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder, smaller than a checkpoint; it goes when the application ends."""
    spark, folder = df.sparkSession, f"{checkpoint_folder(df.sparkSession)}/{stem}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    removed_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def removed_at_end(spark: SparkSession, folder: str) -> None:
    """Has a folder of intermediate tables deleted when the driver's application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables on whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of up to so many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 17


def counted(keys: DataFrame) -> DataFrame:
    """Slim keys for a join: a broadcast if their counted rows are within the bound, else as they are."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: Rows of a group that a task meets at least before the group is split.
ROWS_A_PART = 1 << 10


def met_in_parts(rows: DataFrame, groups: DataFrame, keys: list[str], by: str, sizes: DataFrame | None = None) -> DataFrame:
    """Rows with the columns of their group; groups: a row for each key, with the number of its rows in ``n``.

    The row of a large group is copied to as many parts as its rows need, and its rows are dealt to them by a hash of
    the column ``by``, so no task gathers a group. Other groups are joined as they are. Groups count as large from
    ROWS_A_PART rows on, or from a BROADCAST_ROWS-th of all rows if that is more, so there are no more than
    BROADCAST_ROWS of them to broadcast. Where groups are costly to make, sizes gives their keys and ``n`` at less cost.
    """
    sizes = (groups if sizes is None else sizes).select(*keys, "n")
    whole = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    most = max(ROWS_A_PART, -(-whole["rows"] // BROADCAST_ROWS))
    if whole["largest"] < most:
        return rows.join(groups, keys)
    parts, part = fresh("parts"), fresh("part")
    needed = (F.col("n") / most).cast("int") + 1
    heavy = durable(sizes.filter(F.col("n") >= most).select(*keys, needed.alias(parts)))
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn(part, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    copies = groups.withColumn(part, F.explode(F.sequence(F.lit(0), needed - 1)))
    return dealt.join(copies, [*keys, part]).drop(part)


def fresh(stem: str) -> str:
    """A column name that no input column has."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Arrow batches in, Arrow batches out, in slices of bounded rows."""

    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield work(batch.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, schema)


_BUILT: dict[str, object] = {}


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that lives on holds no more than its present plan needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def once(key: str, build: Callable[[], T]) -> T:
    """In a worker, what ``build`` gives, kept until another key comes; the driver makes up the key, one for each plan."""
    if key not in _BUILT:
        _BUILT.clear()
        give_back()
        _BUILT[key] = build()
    return _BUILT[key]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as strings, null as the empty string."""
    return pc.fill_null(batch.column(name), "").to_pylist()


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; a text of ASCII alone takes the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, spread: int | Column) -> DataFrame:
    """Adds a gapless number from 0 within each group without gathering a group in one task.

    Rows go to ``spread`` buckets (a number, or one that depends on the group) by a hash of the order columns; the
    counts of (group, bucket) give each bucket its first number, and only the rows of one bucket are sorted together.
    Rows that are equal in all order columns get different numbers in any order, but share a bucket.
    """
    bucket, first, local, n = fresh("bucket"), fresh("first"), fresh("local"), fresh("n")
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(*order), spread if isinstance(spread, Column) else F.lit(spread)).cast("int"))
    keys = [*group, bucket]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn(local, F.row_number().over(within) - 1)
        .join(starts, keys)
        .withColumn(name, (F.col(first) + F.col(local)).cast("long"))
        .drop(bucket, first, local)
    )
