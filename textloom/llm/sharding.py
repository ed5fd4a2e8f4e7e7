"""Balanced sharding by label propagation under capacity quotas.

Documents start in a shard by a hash of doc_id and text, whatever the layout of the files. In each round, every group of linked documents counts its members by
shard and points at the shard with most of them; members elsewhere want to move there. How much may move from
one shard to another is settled from the 8 x 8 table of wanted bytes so that no shard exceeds its capacity, and
the moves that fit are chosen by a hash of the group, so that groups move whole where they can. In the end,
small amounts move from fuller to emptier shards, unlinked documents before linked ones and groups whole before
parts of them, until the bytes of all shards are near equal: the law is ``bytes``.

What reaches the driver is bounded by parameters: the sums for shards, and histograms of shards x shards x
``BUCKETS``. No group is gathered: groups are counted map-side, and joins on groups are split by adaptive
execution where one holds a large share of all rows.

Defined results: null text has size 1 and links with empty texts; repeated rows are documents of their own, also
without doc_id; of equally good shards the lower one wins; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import counted, durable, numbered

ROUNDS, SLACK, BUCKETS = 6, 0.25, 1 << 10
#: Rows that are numbered together.
ROWS_A_BUCKET = 1 << 12
#: Sweeps of levelling: what moves together (groups, equal marks, or nothing), and which part of it all, 1 / 64 to this power.
SWEEPS = (("hub", 0), ("mark", 0), ("mark", 1), ("mark", 2), ("node", 0), ("node", 1))
#: Shards that differ by this part of their mean at most leave equal rows together.
EVEN = 0.005


def bucket(seed: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(BUCKETS)).cast("int")


def settled(wanted: np.ndarray, loads: np.ndarray, most: float) -> np.ndarray:
    """How much of the wanted bytes (from, to) may move so that no shard ends above the most."""
    allowed = wanted.astype(float)
    for _ in range(200):
        inflow, outflow = allowed.sum(axis=0), allowed.sum(axis=1)
        over = loads + inflow - outflow - most
        if (over <= 1e-6 * most).all():
            break
        scale = np.where((over > 0) & (inflow > 0), np.maximum(0, 1 - over / np.maximum(inflow, 1)), 1)
        allowed *= scale[None, :]
    return allowed


def load(state: DataFrame, shards: int) -> np.ndarray:
    out = np.zeros(shards)
    for r in state.groupBy("shard").agg(F.sum("size").alias("s")).collect():  # a row for each shard
        out[r["shard"]] = r["s"]
    return out


def voted(linked: DataFrame) -> DataFrame:
    """(hub, target): the shard that holds most of a group; the lower shard if two do."""
    votes = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("hub").agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("best")).select("hub", (-F.col("best.minus")).alias("target"))


def propagate(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(node, size, hub, mark, shard) from nodes (node, size, mark, shard) and links (node, hub); a node has one hub or none.

    Moves whole groups together where the capacity, (1 + slack) times the mean, lets them.
    """
    state = durable(nodes.join(links, "node", "left").select("node", "size", "hub", "mark", "shard"))
    loads = load(state, shards)
    most = (1 + slack) * loads.sum() / shards
    for _ in range(rounds):
        linked = state.filter("hub is not null")
        targets = durable(voted(linked))  # a table of its own, so that the join below can be split where a group is hot
        want = durable(linked.join(targets, "hub").filter("target <> shard").select("node", "size", "shard", "target", bucket(11, "hub").alias("b"), bucket(12, "mark").alias("c")))
        flows = want.groupBy("shard", "target", "b").agg(F.sum("size").alias("s")).collect()  # shards x shards x BUCKETS at most
        if not flows:
            break
        wanted = np.zeros((shards, shards))
        for r in flows:
            wanted[r["shard"], r["target"]] += r["s"]
        allowed = settled(wanted, loads, most)
        # Buckets below the cut move whole; of the bucket at the cut, the share that fits, by a hash of the node.
        cuts = []
        for s in range(shards):
            for t in range(shards):
                room = allowed[s, t]
                for r in sorted((r for r in flows if (r["shard"], r["target"]) == (s, t)), key=lambda r: r["b"]):
                    if r["s"] > room:
                        cuts.append((s, t, r["b"], int(BUCKETS * room / r["s"])))
                        break
                    room -= r["s"]
                else:
                    cuts.append((s, t, BUCKETS, 0))
        spark = state.sparkSession
        limits = F.broadcast(spark.createDataFrame(cuts, "shard int, target int, cut int, part int"))  # shards x shards rows
        moves = want.join(limits, ["shard", "target"]).filter("b < cut or (b = cut and c < part)").select("node", F.col("target").alias("moved"))
        state = durable(state.join(moves, "node", "left").select("node", "size", "hub", "mark", F.coalesce("moved", "shard").alias("shard")))
        loads = load(state, shards)
    return state


def levelled(state: DataFrame, shards: int, rows: int) -> DataFrame:
    """Moves hash buckets of unlinked nodes and of whole groups from shards above the mean to shards below it.

    Each sweep takes a finer part than the one before, so what remains uneven shrinks by a factor of BUCKETS or comes
    down to single documents. Groups are cut only after the first sweep (one may be larger than a shard), and rows equal
    in doc_id and text only in the last ones. state: as from propagate, and ``own``, a number for each row that doesn't
    depend on the layout.
    """
    spark = state.sparkSession
    loads = load(state, shards)
    mean = loads.sum() / shards
    for sweep, (unit, power) in enumerate(SWEEPS):
        if unit == "node" and loads.max() - loads.min() <= EVEN * mean:
            break
        own = F.coalesce(F.when(F.lit(unit == "hub") & F.col("hub").isNotNull(), F.xxhash64("hub")), F.col("own" if unit == "node" else "mark"))
        part = F.pmod(F.xxhash64(own, F.lit(100 + sweep)), F.lit(min(64**power, max(1, rows // BUCKETS)))) == 0
        marked = state.withColumn("linked", F.col("hub").isNotNull()).withColumn("b", F.pmod(F.xxhash64(own, F.lit(200 + sweep)), F.lit(BUCKETS)).cast("int"))
        cells = marked.filter(part & F.col("shard").isin([i for i in range(shards) if loads[i] > mean])).groupBy("shard", "linked", "b").agg(F.sum("size").alias("s"))
        moves = []
        for r in sorted(cells.collect(), key=lambda r: (r["linked"], -r["s"], r["shard"], r["b"])):  # shards x 2 x BUCKETS at most
            to = int(loads.argmin())
            if loads[r["shard"]] - loads[to] > r["s"]:
                loads[r["shard"]] -= r["s"]
                loads[to] += r["s"]
                moves.append((r["shard"], r["linked"], r["b"], to))
        if not moves:
            continue
        table = F.broadcast(spark.createDataFrame(moves, "shard int, linked boolean, b int, moved int"))  # as bounded
        found = marked.join(table, ["shard", "linked", "b"], "left")
        state = found.select("node", "size", "hub", "mark", "own", F.when(part, F.coalesce("moved", "shard")).otherwise(F.col("shard")).alias("shard"))
        state = durable(state)
        loads = load(state, shards)
    return state


def told_apart(rows: DataFrame, spread: int) -> DataFrame:
    """(node, own): a hash of doc_id, text and, for rows equal in both, which of them it is, whatever the layout of the files."""
    key = rows.select("node", F.xxhash64("doc_id", "hub").alias("key"))
    several = durable(key.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    if several.isEmpty():
        return key.select("node", F.col("key").alias("own"))
    few = counted(several)
    copies = numbered(key.join(few, "key", "left_semi"), ["key"], ["node"], "copy", spread)
    return key.join(few, "key", "left_anti").select("node", F.col("key").alias("own")).unionByName(copies.select("node", F.xxhash64("key", "copy").alias("own")))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """A row for each document: size, CRC-32 of the text, law, shard, gapless slot in the shard."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("hub"),
    )
    rows = durable(slim.withColumn("node", F.monotonically_increasing_id()))  # node numbers must not change
    total = rows.count()
    groups = durable(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub"))
    links = rows.join(groups, "hub", "left_semi").select("node", "hub")
    mark = F.xxhash64("doc_id", "text_crc32")  # the same whatever the layout of the files
    nodes = rows.select("node", "size", mark.alias("mark"), F.pmod(mark, F.lit(shards)).cast("int").alias("shard"))
    spread = max(8, total // ROWS_A_BUCKET)
    state = levelled(propagate(nodes, links, shards).join(told_apart(rows, spread), "node"), shards, total)
    placed = rows.join(state.select("node", "own", "shard"), "node")
    return numbered(placed, ["shard"], ["doc_id", "own"], "slot", spread).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )
