"""Near-duplicates by SimHash: segment-popcount embedding, grid range-join, exact verification.

Fingerprints are grouped first, so copies count once. Each distinct fingerprint is embedded as the bit counts
of its 32 two-bit segments, packed in one 64-bit number. The Manhattan distance of embeddings is at most the
Hamming distance of fingerprints; a pair within ``RADIUS`` differs in at most that many coordinates' blocks, so
with ``BLOCKS`` blocks of coordinates it shares all cells of some choice of BLOCKS - RADIUS of them. The join on
such cells is filtered by Manhattan distance and verified by exact Hamming distance.

A cell with more than ``CELL`` fingerprints is not joined with itself. Its fingerprints take the exact way for
dense places: two fingerprints are within two bits if and only if some point is within one bit of both, so
each is sent to its 65 points, and those that meet at a point (65 at most) link to the least of them. Rows
grow in proportion to fingerprints either way, and no link is lost.

Wider similarity (``find_similar``, the pipeline's stage): a Jaccard similarity of word shingles from 0.8 on flips ten
bits and more of a whole text's fingerprint, so the embedding can't find it: a grid at radius ten has no selective cells.
There, most candidates come from banded MinHash instead: a text has ``VIEWS`` bands of ``SAMPLE`` min-wise shingles each,
kept as one number, and two texts share a band with the fourth power of their similarity. The embedding only adds the
pairs whose whole fingerprints link as above. Every candidate pair is verified on all shingles. In a band's cell
beyond ``CELL`` texts each is compared first with the three that meet most others; the original
of many copies is such a one. Crowded cells whose texts then lie in several components take an exact way
(``crowded_pairs``): a similar pair shares a shingle among the rarest few of both, so that shared passages, which come
last, bring nothing together, and bounds by length and place leave out what can't be similar.

Defined results: null text counts as empty; no words give fingerprint zero, which links like any other;
rows equal in doc_id and text share a component, and rows that share a doc_id alone are told apart by their texts;
equal distances need no order, as components don't depend on it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, durable, fresh, give_back, map_batches, texts_of
from .components import components
from .exactdedup import text_digest
from .fuse import mix

RADIUS, BLOCKS, CELL = 2, 6, 48
SEED, TOGETHER = 42, 1 << 16
EVEN = 0x5555555555555555

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, words: int) -> int:
    """A bit is set if it is in over half of the shingles' hashes."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return 0
    line, width = b" ".join(found), min(words, len(found))
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-1]]
    n, digest = len(found) - width + 1, xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, TOGETHER):
        upto = min(n, at + TOGETHER)
        hashes = [digest(line[a : b - 1], SEED) for a, b in zip(starts[at:upto], ends[at + width - 1 : upto + width - 1], strict=True)]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print); the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words) for t in texts_of(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "print"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, print long")


def embedding(p: Column) -> Column:
    """The bit counts of all two-bit segments, two bits each."""
    a, b = p.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(p, 1).bitwiseAND(F.lit(EVEN))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # a half adder in each segment: no carry leaves it


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings: counts 0, 1, 2 that differ by two have only the upper bit in their difference."""
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVEN))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def masks() -> list[int]:
    """For each choice of blocks that a pair may share, the bits of their coordinates, as signed longs."""
    blocks = [sum(3 << (2 * int(i)) for i in part) for part in np.array_split(np.arange(32), BLOCKS)]
    whole = [sum(chosen) for chosen in itertools.combinations(blocks, BLOCKS - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def cells(prints: DataFrame) -> DataFrame:
    """(choice, cell, print) for each print and choice of blocks."""
    e = embedding(F.col("print"))
    places = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("choice"), e.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks())])
    return prints.select("print", F.explode(places).alias("at")).select("at.choice", "at.cell", "print")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of distinct prints within the radius; those in dense cells by a spanning star at each meeting point."""
    placed = cells(prints)
    crowd = placed.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")  # counted map-side: a dense cell is never gathered
    shared = durable(placed.join(crowd, ["choice", "cell"]))
    some = shared.filter(F.col("n") <= CELL)
    left, right = some.select("choice", "cell", F.col("print").alias("a")), some.select("choice", "cell", F.col("print").alias("b"))
    a, b = F.col("a"), F.col("b")
    near = (manhattan(embedding(a), embedding(b)) <= RADIUS) & (F.bit_count(a.bitwiseXOR(b)) <= RADIUS)
    pairs = left.join(right, ["choice", "cell"]).filter((a < b) & near).select("a", "b")
    dense = shared.filter(F.col("n") > CELL).select("print").distinct()
    points = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    met = dense.select(F.explode(points).alias("point"), "print")
    least = F.min("print").over(Window.partitionBy("point"))
    stars = met.select(F.col("print").alias("b"), least.alias("a")).filter("a < b").select("a", "b")
    return pairs.unionByName(stars).distinct()


def find_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, print, component_id): the least doc_id that links reach, its own included."""
    rows = durable(fingerprints(docs, words))
    prints = durable(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    found = components(links(prints.select("print"))).select(F.col("node").alias("print"), "root")
    placed = durable(prints.join(found, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(ids, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


SIMILARITY, VIEWS, SAMPLE, PIVOTS = 0.8, 12, 4, 3
#: Counters by part of a shingle's hash, which give the order by rarity; ratio of length classes; texts of a part of a block.
COUNTERS, STEP, PART = 1 << 20, 1.03, 256
SETS = "doc_id long, text_sha256 string, digest string, print long, views array<long>"


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    found = text.encode().translate(_LOWER).split()
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(found[i : i + width]), SEED) for i in range(len(found) - width + 1)] if found else [], np.uint64))


def majority(hashes: np.ndarray) -> int:
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def sampled(hashes: np.ndarray) -> list[int]:
    """For each view, the fingerprint of the members that its order puts first."""
    if len(hashes) <= SAMPLE:
        return [majority(hashes)] * bool(len(hashes))
    orders = (mix(hashes, 1000 + v) for v in range(VIEWS))
    return [majority(hashes[np.argpartition(m, SAMPLE)[:SAMPLE]]) for m in orders]


def set_digest(hashes: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.tobytes())


def described(docs: DataFrame, words: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in texts_of(batch)]
        columns = [
            batch.column("doc_id"),
            batch.column("text_sha256"),
            pa.array([set_digest(h) for h in sets], pa.string()),
            pa.array([majority(h) if len(h) else 0 for h in sets], pa.int64()),
            pa.array([sampled(h) for h in sets], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_sha256", "digest", "print", "views"])

    return map_batches(docs.select("doc_id", "text", text_digest(F.col("text")).alias("text_sha256")), work, SETS)


def ordered_pairs(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): digests of texts that share a view's fingerprint, or whose whole fingerprints are equal or link; and the
    places (view, cell, digest) in crowded cells, where only pairs with a pivot are among them."""
    places = sets.select("digest", F.posexplode("views").alias("view", "cell"))
    crowded = places.groupBy("view", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = durable(places.join(crowded, ["view", "cell"]))
    some = shared.filter(F.col("n") <= CELL)
    pairs = some.select("view", "cell", F.col("digest").alias("a")).join(some.select("view", "cell", F.col("digest").alias("b")), ["view", "cell"]).filter("a < b")
    meets = shared.groupBy("digest").agg(F.sum("n").alias("meets"))
    many = shared.filter(F.col("n") > CELL).join(meets, "digest").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(PIVOTS)))
    pivots = many.groupBy("view", "cell", "salt").agg(F.max(F.struct("meets", "digest")).alias("top")).select("view", "cell", F.col("top.digest").alias("b"))
    stars = many.select("view", "cell", F.col("digest").alias("a")).join(pivots, ["view", "cell"])
    # Texts of one print meet its least text; least texts of linked prints meet each other.
    first = sets.groupBy("print").agg(F.min("digest").alias("b"))
    within = sets.select("print", F.col("digest").alias("a")).join(first, "print")
    near = links(first.select("print")).withColumnRenamed("a", "x").withColumnRenamed("b", "y")
    across = near.join(first.select(F.col("print").alias("x"), F.col("b").alias("a")), "x").join(first.select(F.col("print").alias("y"), "b"), "y")
    every = [ordered_pairs(p.select("a", "b")) for p in (pairs, stars, within, across)]
    pairs = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3]).distinct()
    return pairs, shared.filter(F.col("n") > CELL).select("view", "cell", "digest")


def held_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(digest, hashes) of all shingles of the texts in pairs."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, words) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array([set_digest(h) for h in found], pa.string()), pa.array([h.tobytes() for h in found], pa.binary())], ["digest", "hashes"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    ids = sets.join(ends, "digest").select(F.col("least").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(counted(durable(ids)), "doc_id", "left_semi")
    return map_batches(texts.select("text"), hashed, "digest string, hashes binary").groupBy("digest").agg(F.first("hashes").alias("hashes"))


def verified(held: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of all shingles are similar enough."""

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= similarity * (len(a) + len(b) - both))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        return pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    left, right = held.select(F.col("digest").alias("a"), F.col("hashes").alias("left")), held.select(F.col("digest").alias("b"), F.col("hashes").alias("right"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), judged, "a string, b string")


def rarity(held: DataFrame) -> np.ndarray:
    """How many shingles fall to each counter; a table of fixed size."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for own in batch.column("hashes").to_pylist():
                np.add.at(n, (np.frombuffer(own, np.uint64) % COUNTERS).astype(np.int64), 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["counter", "n"])

    found = held.select("hashes").mapInArrow(tally, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.uint32)
    counts[found.column("counter").to_numpy()] = np.minimum(found.column("n").to_numpy(), (1 << 32) - 1)
    del found
    give_back()
    return counts


def prefixes(held: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, root, size, at): the rarest shingles of each text; two similar texts share one of them at least."""
    counts = held.sparkSession.sparkContext.broadcast(rarity(held))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
        first = [h[np.lexsort((h, counts.value[(h % COUNTERS).astype(np.int64)]))][: len(h) - math.ceil(similarity * len(h) - 1e-6) + 1] for h in sets]
        lengths = np.array([len(x) for x in first], np.int64)
        columns = [
            pa.array(np.concatenate([*first, np.empty(0, np.uint64)]).view(np.int64)),
            pa.array(np.repeat(batch.column("node").to_numpy(), lengths)),
            pa.array(np.repeat(batch.column("root").to_numpy(), lengths)),
            pa.array(np.repeat(np.array([len(h) for h in sets], np.int32), lengths)),
            pa.array(np.concatenate([*(np.arange(n, dtype=np.int32) for n in lengths), np.empty(0, np.int32)])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shingle", "node", "root", "size", "at"])

    return map_batches(held.select("hashes", "node", "root"), work, "shingle long, node long, root long, size int, at int")


def length_class(size: Column) -> Column:
    return F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.lit(math.log(STEP))).cast("int")


def crowded_pairs(held: DataFrame, crowded: DataFrame, roots: DataFrame, similarity: float) -> DataFrame | None:
    """(a, b): digests in different components that may be similar, among all texts of crowded cells; roots: (digest, node, root).

    Texts a and b with |b| <= |a| that share their first shingle at the places i and j have at most |a| - i and |b| - j in
    common, and need the part similarity / (1 + similarity) of |a| + |b|. So a looks only for length classes that
    can suffice, and pairs within the largest component of a shingle's texts, which are linked already, are never made.
    """
    placed = crowded.join(roots, "digest")
    mixed = placed.groupBy("view", "cell").agg((F.min("root") < F.max("root")).alias("mixed")).filter("mixed")
    rest = durable(placed.join(mixed, ["view", "cell"], "left_semi").select("digest", "node", "root").distinct())
    if rest.isEmpty():
        return None
    part = similarity / (1 + similarity)
    rows = durable(prefixes(held.join(rest, "digest"), similarity))
    own = rows.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    heads = own.groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("major"), (F.sum("n") - F.max("n")).alias("minors")).filter("minors > 0")
    heads = counted(durable(heads.withColumn("parts", (F.col("minors") / PART).cast("int") + 1).drop("minors")))
    met = durable(rows.join(heads, "shingle").withColumn("major", F.col("root") == F.col("major")))
    size, at = F.col("size"), F.col("at")
    longest = F.least(size.cast("double"), (size - at) / part - size + 1e-6)
    classes = F.sequence(length_class(size * similarity - 1e-6), length_class(longest))
    left = met.filter(longest >= size * similarity - 1e-6).select(
        "shingle",
        F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.when(F.col("major"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("other"),
        *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "size", "at")],
        classes.alias("classes"),
    )
    left = left.withColumn("class", F.explode("classes")).drop("classes")
    right = met.filter(size - at >= 2 * part * size - 1e-6).select(
        "shingle",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.col("major").alias("other"),
        *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "size", "at")],
        length_class(size.cast("double")).alias("class"),
    )
    a, b = F.col("size_a"), F.col("size_b")
    enough = F.least(a - F.col("at_a"), b - F.col("at_b")) >= part * (a + b) - 1e-6
    once = (a > b) | ((a == b) & (F.col("node_a") < F.col("node_b")))
    found = left.join(right, ["shingle", "part", "other", "class"]).filter(enough & once & (F.col("root_a") != F.col("root_b"))).select("node_a", "node_b").distinct()
    names = rest.select("digest", "node")
    found = found.join(names.select(F.col("node").alias("node_a"), F.col("digest").alias("a")), "node_a")
    return found.join(names.select(F.col("node").alias("node_b"), F.col("digest").alias("b")), "node_b").select("a", "b")


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): the pairs of digests as pairs of their components."""
    left, right = roots.select(F.col("digest").alias("a"), F.col("root").alias("x")), roots.select(F.col("digest").alias("b"), F.col("root").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(digest, node, least, root) after components that edges link have become one."""
    found = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return durable(roots.join(found, "root", "left").select("digest", "node", "least", F.coalesce("to", "root").alias("root")))


def find_similar(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id, text_sha256): the least doc_id that verified links reach; equal sets of shingles link, rows without doc_id don't."""
    rows = durable(described(docs.filter("doc_id is not null"), words))
    sets = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("print").alias("print"), F.first("views").alias("views"))
    sets = durable(sets.withColumn("node", F.monotonically_increasing_id()))  # node numbers must not change
    pairs, crowded = candidates(sets)
    pairs = durable(pairs)
    held = durable(held_sets(docs, sets, pairs, words))
    roots = sets.select("digest", "node", "least", F.col("node").alias("root"))
    roots = joined(roots, between(verified(held, pairs, similarity), roots))
    more = crowded_pairs(held, crowded, roots.select("digest", "node", "root"), similarity)
    if more is not None:
        roots = joined(roots, between(verified(held, more, similarity), roots))
    placed = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    return rows.join(placed, "digest").select("doc_id", "component_id", "text_sha256")


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, all columns, without those whose component has a smaller doc_id; rows without doc_id stay.

    Rows that share a doc_id are told apart by their texts if ``found`` has text_sha256.
    """
    id_, mark = fresh("id"), fresh("digest")
    marked = "text_sha256" in found.columns
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_), *[F.col("text_sha256").alias(mark)] * marked).distinct()
    on = [F.col("doc_id") == F.col(id_), *[text_digest(F.col("text")) == F.col(mark) for _ in range(marked)]]
    return docs.join(counted(durable(gone)), on, "left_anti").select(docs.columns)


def written(p: Column) -> Column:
    """Sixteen lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(p), 16, "0"))
