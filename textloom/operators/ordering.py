"""Ordered operators that hold no whole key in memory: scans in blocks, so that a key of any size runs in many tasks; greedy batches alone fold a key in one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..session import ship


def spread(df: DataFrame) -> DataFrame:
    """Deals out rows of an input that has far fewer partitions than there are cores, before costly expressions.

    Larger inputs have more partitions than cores and stay as they are. Select columns first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores // 2 else df


def ordered_number(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """Adds a number from 1 within each key, in the order given, however many rows a key has.

    ``block`` must not decrease along the order. Rows are numbered within (key, block), and the counts of a
    key's earlier blocks are added; only blocks, not keys, need to fit a task.
    """
    rows = df.withColumn("__block", block)
    sizes = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy(*keys, "__block").orderBy(*order)
    numbered = rows.withColumn("__own", F.row_number().over(own))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__block"]]
    joined = numbered.alias("l").join(starts.alias("r"), on)
    return joined.select(*[f"l.{c}" for c in df.columns], (F.col("__first") + F.col("__own")).alias(name))


def scanned(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str, total: bool, own: bool = True, down: bool = False) -> DataFrame:
    """Adds, along the order within each key, the sum of the values up to a row, or the last value that isn't null.

    ``block`` must not decrease along the order columns; ``down`` scans from their end. Rows are scanned within (key,
    block), then what the blocks end with, and each row takes what the blocks before its own have left; so only blocks,
    and a key's row for each block, need to fit a task. ``own``: whether a row's own value counts.
    """
    fold = F.sum if total else lambda c: F.last(c, ignorenulls=True)
    rows = df.withColumn("__block", block).withColumn("__value", value)
    towards = F.desc if down else F.asc
    within = Window.partitionBy(*keys, "__block").orderBy(*map(towards, order))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", fold("__value").over(upto)).withColumn("__last", F.lead(F.lit(1)).over(within).isNull())
    if not own:
        rows = rows.withColumn("__own", fold("__value").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = Window.partitionBy(*keys).orderBy(towards("__block")).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.filter("__last").select(*keys, "__block", fold("__upto").over(blocks).alias("__before"))
    mine = F.col("__upto" if own else "__own")
    found = F.coalesce(mine + F.col("__before"), mine, F.col("__before")) if total else F.coalesce(mine, F.col("__before"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__block"]]
    return rows.alias("l").join(before.alias("r"), on).select(*[f"l.{c}" for c in df.columns], found.alias(name))


def carried_forward(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null, own row included."""
    return scanned(df, keys, order, block, value, name, total=False)


def next_where(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, wanted: Column, name: str) -> DataFrame:
    """Adds the value of the next row that is wanted, own row excluded."""
    return scanned(df, keys, order, block, F.when(wanted, value), name, total=False, own=False, down=True)


def islands(df: DataFrame, keys: list[str], order: list[str], block: Column, continues: Column, name: str) -> DataFrame:
    """Adds a group number; a row joins the group of the row before if that one continues."""
    after = scanned(df, keys, order, block, F.coalesce(continues, F.lit(False)).cast("int"), "__after", total=False, own=False)
    return scanned(after, keys, order, block, 1 - F.coalesce("__after", F.lit(0)), name, total=True).drop("__after")


def greedy_batches(df: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """(keys, batch, n, cost): rows in order fill a batch until the next would exceed the budget.

    A batch has one row at least. Where a batch ends depends on all rows before, so a key is folded in one task; its
    rows stream through in order, and the task holds no more than the batch that is open.
    """
    ship(df.sparkSession)
    rows = df.select(*keys, *order, cost.cast("long").alias("__cost"))
    kinds = rows.select(*keys).schema
    schema = StructType([*kinds.fields, *[StructField(c, LongType()) for c in ("batch", "n", "cost")]])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # the key, its batch, and the batch's rows and cost so far
        for batch in batches:
            done = []
            for *key, c in zip(*[batch.column(k).to_pylist() for k in (*keys, "__cost")], strict=True):
                if state and state[0] == key and state[3] + c <= budget:
                    state[2:] = state[2] + 1, state[3] + c
                    continue
                number = 1
                if state:
                    done.append((*state[0], *state[1:]))
                    number = state[1] + 1 if state[0] == key else 1
                state = [key, number, 1, c]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(arrow)], arrow.names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*state[0], *state[1:]), arrow, strict=True)], arrow.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)
