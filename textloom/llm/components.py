"""Connected components by alternating large-star and small-star steps.

Edges are rewritten until each node points at the least node of its component. All state stays in
DataFrames and each step is written to the shared checkpoint folder. Nodes with very many edges, and only these, meet
theirs in parts by a hash of the other end, as many as their edges need.

Defined results: an edge from a node to itself, or with a null end, links nothing; repeated edges count once; a
component of any size or shape is found whole, or an error says that it didn't settle; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, met_in_parts

MOST_STEPS = 60


def with_least(around: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the least of a and its neighbours."""
    ends = around.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
    return met_in_parts(around, ends, ["a"], "b").select("a", "b", "m")


def pairs(*ends: tuple[str, str]) -> Column:
    """For each row, an edge (a, b) of each two columns."""
    return F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ends])).alias("e")


def star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Joins the neighbours of each node to the least of them: the larger ones, or itself and the smaller ones."""
    if both_ways:
        around = edges.select(pairs(("a", "b"), ("b", "a"))).select("e.a", "e.b")
        new = with_least(around).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = with_least(around).select(pairs(("b", "m"), ("a", "m"))).select("e.a", "e.b")
    return new.filter("a <> b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none of those at a lower end has one; edges have a > b."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("e")
    nodes = edges.select(ends).groupBy("e.node").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("least"))
    return nodes.filter("down > 1 or (down = 1 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); the root is the least node that it reaches. No edges, no rows."""
    now = durable(edges.select("a", "b").filter("a <> b").distinct())
    for _ in range(MOST_STEPS):
        now = durable(star(durable(star(now, True)), False))
        if settled(now):
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
