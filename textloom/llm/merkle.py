"""Merkle manifest of a dataset: a digest for every row, a tree over each run of rows, and proofs that a row belongs to it.

Rows are dealt by range into partitions of consecutive rows of a run, and each row gets its index in the run from the
partitions' counts. A partition keeps a mountain range: a stack of nodes for each level that carries as an odometer
with the fanout as its base does. A full stack is hashed into its parent (a node record); what can't be completed,
because its brothers lie in other partitions, is left as a peak: some for each level and edge, never a row for each
leaf. Peaks meet by aligned blocks of ``LIFT`` levels, which are merged by the same stack, round by round, until each
run has one node; no task holds a run. At the end of a run a stack with fewer nodes, even one, is hashed as it is,
without padding. Proofs come down the same way: a block's path joins its peaks, a partition's peaks their leaves.

Digests are SHA-256 in lower-case hexadecimal, and parents hash the joined text of their children's.

Defined results: a null field has its own mark, so it differs from an empty text; a null run is a run of its own, the
first; rows without order columns come first in their run; rows that are equal in the order columns are ordered by
their digests, and equal rows are leaves of their own with proofs of their own places; a run of one row has that row's
digest as its root and an empty path; texts of any length are hashed whole; an empty table gives no rows; other
columns are kept out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import durable

#: Levels that one round of merging climbs, for a fanout of two (blocks of 1,024 nodes); of others as many as give blocks of that size.
LIFT = 10
#: A leaf's level and place in its run, and the names of the steps of a path.
NODE, PATH = ["level", "pos"], ["lefts", "rights"]


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(leaves: int, fanout: int) -> int:
    """Levels above the leaves of a run."""
    levels, size = 0, 1
    while size < leaves:
        levels, size = levels + 1, size * fanout
    return levels


class Range:
    """Mountain range over consecutive nodes; nodes are pushed from left to right. A node at the level ``top`` stays."""

    def __init__(self, fanout: int, top: int | None = None) -> None:
        self.fanout, self.top, self.stacks = fanout, top, defaultdict(list)
        self.records: list[tuple[int, int, str]] = []
        self.peaks: list[tuple[int, int, str]] = []
        self.beside: dict[tuple[int, int], tuple[str, str]] = {}

    def hashed(self, level: int) -> None:
        """Hashes the stack into its parent; each child learns what stands left and right of it."""
        run = self.stacks.pop(level)
        digests = [digest for _, digest in run]
        for i, (pos, _) in enumerate(run):
            self.beside[level, pos] = "".join(digests[:i]), "".join(digests[i + 1 :])
        parent = level + 1, run[0][0] // self.fanout, joined(digests)
        self.records.append(parent)
        self.stacks[level + 1].append(parent[1:])

    def push(self, level: int, pos: int, digest: str) -> None:
        self.stacks[level].append((pos, digest))
        while level != self.top and (pos + 1) % self.fanout == 0:
            if len(run := self.stacks[level]) < self.fanout:  # its first nodes lie in another partition
                self.peaks += [(level, *node) for node in run]
                run.clear()
                return
            self.hashed(level)
            level, pos = level + 1, pos // self.fanout

    def rest(self) -> None:
        """What is still open becomes peaks."""
        self.peaks += [(level, *node) for level, run in self.stacks.items() for node in run]
        self.stacks.clear()

    def close(self) -> str:
        """At the end of a run, or of a block: hashes what is open, however few, up to the top; the node there."""
        for level in range(min(self.stacks), self.top):
            if self.stacks[level]:
                self.hashed(level)
        return self.stacks[self.top][-1][1]

    def path(self, level: int, pos: int) -> tuple[list[str], list[str], int, int]:
        """What stands left and right at each level on the way up, and the node at which the way ends here."""
        lefts, rights = [], []
        while (found := self.beside.get((level, pos))) is not None:
            lefts.append(found[0])
            rights.append(found[1])
            level, pos = level + 1, pos // self.fanout
        return lefts, rights, level, pos


def field(value: Column) -> Column:
    """A field as its bytes' number, a colon and the value, null as a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def run_key(run: Column) -> Column:
    """A string that orders as the runs do, null first."""
    return F.coalesce(F.concat(F.lit("="), run.cast("string")), F.lit(""))


def indexed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (run, leaf, the order columns, others) in ranges of consecutive rows, with their part and place; durable."""
    by = ["run", *order, "leaf"]
    tie = F.xxhash64(F.monotonically_increasing_id())  # deals rows that are equal in all these to many ranges
    keys = [F.asc_nulls_first(c) for c in by]
    dealt = leaves.withColumn("tie", tie).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").drop("tie")
    return durable(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))


def spans(rows: DataFrame) -> DataFrame:
    """(part, run, first, total): the index of each part's first row of a run, and the run's number of rows."""
    counts = rows.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("run")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return durable(counts.select("part", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(own).alias("total")))


def ranges(rows: pd.DataFrame, held: pd.DataFrame, fanout: int) -> Iterator[tuple[pd.Series, pd.DataFrame, Range]]:
    """For each run in a partition: its span, its rows in order, and its mountain range."""
    known = {s.run: s for s in held.itertuples()}
    for run, own in rows.groupby("run", sort=False):
        span, own = known[run], own.sort_values("place")
        made = Range(fanout)
        for i, digest in enumerate(own["leaf"]):
            made.push(0, span.first + i, digest)
        made.rest()
        yield span, own, made


def with_parts(rows: DataFrame, held: DataFrame, work, schema: str) -> DataFrame:
    """Each partition's rows beside what is held for it, whose columns get identities of their own."""
    ship(rows.sparkSession)
    held = held.select(*(F.col(c).alias(c) for c in held.columns))
    return rows.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(work, schema)


def peaks_of(rows: DataFrame, held: DataFrame, fanout: int) -> DataFrame:
    """(part, run, level, pos, digest, total): the nodes that no partition could complete."""

    def work(own: pd.DataFrame, span: pd.DataFrame) -> pd.DataFrame:
        found = [(s.part, s.run, *peak, s.total) for s, _, made in ranges(own, span, fanout) for peak in made.peaks]
        return pd.DataFrame(found, columns=["part", "run", *NODE, "digest", "total"])

    return with_parts(rows.select("part", "run", "place", "leaf"), held, work, "part int, run string, level int, pos long, digest string, total long")


def merged(nodes: DataFrame, top: int, fanout: int) -> DataFrame:
    """A row for each node: its path in its block, and the block's own node at the level ``top``, or the run's root if that is lower.

    nodes: (part, run, level, pos, digest, total). A block takes a bounded number of nodes from each partition or round below.
    """
    ship(nodes.sparkSession)

    def work(own: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(start=[p * fanout**k for k, p in zip(own["level"], own["pos"], strict=True)]).sort_values("start")
        made = Range(fanout, min(top, height(int(own["total"].iloc[0]), fanout)))
        for n in own.itertuples():
            made.push(n.level, n.pos, n.digest)
        digest = made.close()
        ways = [made.path(n.level, n.pos) for n in own.itertuples()]
        return own[["part", "run", *NODE, "total", "block"]].assign(lefts=[w[0] for w in ways], rights=[w[1] for w in ways], digest=digest)

    block = F.expr(f"pos div cast(pow({fanout}, {top} - level) as bigint)")
    schema = "part int, run string, level int, pos long, total long, block long, lefts array<string>, rights array<string>, digest string"
    return nodes.withColumn("block", block).groupBy("run", "block").applyInPandas(work, schema)


def levels(peaks: DataFrame, fanout: int, lift: int) -> tuple[int, int]:
    """The levels of the longest run, and those that the first round climbs: no lower than the highest peak."""
    most = peaks.agg(F.coalesce(F.max("total"), F.lit(0)), F.coalesce(F.max("level"), F.lit(0))).first()
    return height(most[0], fanout), max(lift, most[1])


def climbed(peaks: DataFrame, fanout: int, lift: int) -> DataFrame:
    """(part, run, level, pos, lefts, rights, root): each peak's way up to the root of its run."""
    longest, top = levels(peaks, fanout, lift)
    found = durable(merged(peaks, top, fanout))
    while top < longest:
        nodes = found.groupBy("run", "block").agg(F.min("digest").alias("digest"), F.min("total").alias("total"))
        finished = F.array(*(F.lit(fanout**k) for k in range(top + 1) if fanout**k < 1 << 62))
        level = F.least(F.lit(top), F.size(F.filter(finished, lambda x: x < F.col("total"))))
        up = merged(nodes.select(F.lit(0).alias("part"), "run", level.alias("level"), F.col("block").alias("pos"), "digest", "total"), top + lift, fanout)
        up = up.select("run", F.col("pos").alias("block"), F.col("block").alias("higher"), F.struct(*PATH).alias("more"), F.col("digest").alias("above"))
        longer = (F.concat(c, f"more.{c}").alias(c) for c in PATH)
        found = durable(found.join(up, ["run", "block"]).select("part", "run", *NODE, "total", F.col("higher").alias("block"), *longer, F.col("above").alias("digest")))
        top += lift
    return found.select("part", "run", *NODE, *PATH, F.col("digest").alias("root"))


def proven(rows: DataFrame, held: DataFrame, ways: DataFrame, keep: dict[str, str], fanout: int) -> DataFrame:
    """A row for each leaf: the kept columns, its path (lefts, rights) and the root that the peaks' ways lead to."""
    firsts = held.select("part", "run", "first", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("pos"), *(F.lit(None).cast("array<string>").alias(c) for c in PATH), F.lit(None).cast("string").alias("root"))
    both = firsts.unionByName(ways.select("part", "run", F.lit(None).cast("long").alias("first"), *NODE, *PATH, "root"))

    def work(own: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
        first = beside["level"].isna()
        above = {(w.run, int(w.level), int(w.pos)): w for w in beside[~first].itertuples()}
        out = []
        for span, leaves, made in ranges(own, beside[first].astype({"first": "int64"}), fanout):
            lefts, rights, roots = [], [], []
            for i in range(len(leaves)):
                left, right, level, pos = made.path(0, span.first + i)
                way = above[span.run, level, pos]
                lefts.append([*left, *way.lefts])
                rights.append([*right, *way.rights])
                roots.append(way.root)
            out.append(leaves[[*keep]].assign(lefts=lefts, rights=rights, root=roots))
        names = [*keep, *PATH, "root"]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    schema = ", ".join(f"{c} {kind}" for c, kind in keep.items()) + ", lefts array<string>, rights array<string>, root string"
    return with_parts(rows, both, work, schema)


def prove(leaves: DataFrame, order: list[str], fanout: int = 2, lift: int | None = None) -> DataFrame:
    """Leaves (run, leaf, order columns, others) with their path (lefts, rights) to the root of all, and both roots.

    Each run of leaves, ordered, has a tree; the roots of the runs, ordered by run, are the leaves of one more.
    """
    lift = lift or max(1, LIFT * 2 // fanout.bit_length())
    kinds = lambda df: {c: t for c, t in df.dtypes if c not in ("part", "place", "tie")}
    rows = indexed(leaves, order)
    held = spans(rows)
    ways = climbed(peaks_of(rows, held, fanout), fanout, lift)
    subroots = ways.groupBy("run").agg(F.min("root").alias("leaf")).select(F.col("run").alias("name"), F.lit("").alias("run"), "leaf")
    upper = indexed(subroots, ["name"])
    upper_held = spans(upper)
    upper_ways = climbed(peaks_of(upper, upper_held, fanout), fanout, lift)
    tops = durable(proven(upper, upper_held, upper_ways, kinds(upper), fanout).select(F.col("name").alias("run"), F.struct(*PATH).alias("more"), F.col("root").alias("whole")))
    whole = ways.join(tops, "run").select("part", "run", *NODE, *(F.concat(c, f"more.{c}").alias(c) for c in PATH), F.concat("root", "whole").alias("root"))
    found = proven(rows, held, whole, kinds(rows), fanout)
    return found.withColumn("subroot", F.substring("root", 1, 64)).withColumn("root", F.substring("root", 65, 64))


def node_records(leaves: DataFrame, order: list[str], fanout: int = 2, lift: int | None = None) -> DataFrame:
    """(run, level, pos, digest): every node of every run's tree, the leaves among them; the manifest's table."""
    lift = lift or max(1, LIFT * 2 // fanout.bit_length())
    rows = indexed(leaves, order)
    held = spans(rows)

    def low(own: pd.DataFrame, span: pd.DataFrame) -> pd.DataFrame:
        found = []
        for s, leaves_, made in ranges(own, span, fanout):
            found += [(s.run, 0, s.first + i, d) for i, d in enumerate(leaves_["leaf"])] + [(s.run, *record) for record in made.records]
        return pd.DataFrame(found, columns=["run", *NODE, "digest"])

    def high(own: pd.DataFrame) -> pd.DataFrame:
        made = Range(fanout, min(int(own["top"].iloc[0]), height(int(own["total"].iloc[0]), fanout)))
        for n in own.assign(start=[p * fanout**k for k, p in zip(own["level"], own["pos"], strict=True)]).sort_values("start").itertuples():
            made.push(n.level, n.pos, n.digest)
        made.close()
        return pd.DataFrame([(own["run"].iloc[0], *record) for record in made.records], columns=["run", *NODE, "digest"])

    schema = "run string, level int, pos long, digest string"
    nodes = durable(peaks_of(rows, held, fanout))
    out = with_parts(rows.select("part", "run", "place", "leaf"), held, low, schema)
    longest, top = levels(nodes, fanout, lift)
    while longest:
        block = F.expr(f"pos div cast(pow({fanout}, {top} - level) as bigint)")
        made = durable(nodes.withColumn("block", block).withColumn("top", F.lit(top)).groupBy("run", "block").applyInPandas(high, schema))
        out = out.unionByName(made)
        if top >= longest:
            break
        whole = nodes.select("run", "total").distinct()
        nodes = made.filter(F.col("level") == top).unionByName(nodes.filter(F.col("level") == top).select(*made.columns)).join(whole, "run").distinct()
        top += lift
    return out


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda node, step: F.sha2(F.concat(step["l"], node, step["r"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(F.arrays_zip(lefts.alias("l"), rights.alias("r")), lambda step: F.concat(step["l"], step["r"]))), 256)


def verify_documents(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """Every document's leaf, roots and proof; ``changed`` stands for n_chars in the tampered rows, whose leaves fold to another root."""
    ship(docs.sparkSession)
    fields = lambda n: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    seen = F.when(tampered & changed.isNotNull(), fields(changed))
    leaves = durable(docs.select(run_key(F.col("lang")).alias("run"), "doc_id", fields(F.col("n_chars")).alias("leaf"), seen.alias("seen")))
    found = prove(leaves, ["doc_id"])
    back = folded(F.coalesce("seen", "leaf"), F.col("lefts"), F.col("rights")).alias("folded_root")
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("lefts"), F.col("rights")).alias("proof_sha256"), back)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
