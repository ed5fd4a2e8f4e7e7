"""Pairs of texts a few edits apart, found by equi-joins on keys in place of a comparison of all pairs.

Longer texts: a text is cut into one piece more than there may be edits, so the edits leave one piece whole, and the
longer text of a pair holds it at a place that the other edits bound. The shorter text gives its pieces, the longer one
the few stretches that could be one. Short texts, whose pieces would tell nothing, meet by what is left of them when up
to as many letters are deleted as there may be edits: two texts within the edits have such a rest in common. Texts with
a piece that very many share (a template) meet in the same way, so that a template's lines are never compared with each
other for the template's sake; only texts of more than ``LONGEST_REST`` characters have too many rests for that and are
compared. What meets is compared with a threshold, on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Edits that a pair may have, and characters from which a text is cut into pieces; keys grow with the square of the edits.
EDITS, SHORTEST = 2, 24
#: Texts that share a piece from which they meet by their rests, and the longest text that does.
SHARED, LONGEST_REST = 256, 128
#: Rows of slim keys that are broadcast at most.
BROADCAST_ROWS = 1 << 17


def piece(size: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Place, from 0, and length of the i-th piece of a text of this size; the last pieces take what is left over."""
    base, longer = F.floor(size / (edits + 1)), size % (edits + 1)
    before = F.greatest(F.lit(0), F.lit(i - edits - 1) + longer)
    return base * i + before, base + (longer > edits - i).cast("long")


def key(text: Column, size: Column, i: int, place: Column, length: Column) -> Column:
    """A number for the block, the shorter text's size, the piece and the cut: rows of keys are many, and are kept slim. What meets by chance is compared and dropped."""
    cut = F.substring(text, (place + 1).cast("int"), length.cast("int"))
    return F.xxhash64(F.col("block"), size.cast("long"), F.lit(i), cut)


def pieces(text: Column, edits: int) -> Column:
    """The pieces of a text, as keys."""
    size = F.length(text)
    return F.array(*[key(text, size, i, *piece(size, i, edits)) for i in range(edits + 1)])


def stretches(text: Column, edits: int) -> Column:
    """For each shorter size within the edits and each piece, the stretches of a text that can be that piece of one of that size.

    Left of piece i lie at most i of the edits if an earlier piece isn't whole, right of it at most as many as pieces follow.
    """
    made = []
    for less in range(edits + 1):
        size = F.length(text) - less
        for i in range(edits + 1):
            place, length = piece(size, i, edits)
            after = edits - i
            made += [F.struct(key(text, size, i, place + by, length).alias("k"), F.lit(less > 0).alias("longer")) for by in range(max(-i, less - after), min(i, less + after) + 1)]
    return F.array(*made)


def rests(text: Column, edits: int) -> Column:
    """What is left of a text without up to ``edits`` of its letters, as hashes."""
    last = every = F.array(text)
    for _ in range(edits):
        one_less = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array())
        last = F.array_distinct(F.flatten(F.transform(last, one_less)))
        every = F.concat(every, last)
    return F.array_distinct(F.transform(every, lambda t: F.xxhash64(t)))


def by_rests(texts: DataFrame, edits: int) -> DataFrame:
    """(x, y) of texts (block, id, text) that have a rest in common; block isn't null."""
    own = texts.select("id", F.explode(rests(F.col("text"), edits)).alias("k"), "block").select("id", F.xxhash64("block", "k").alias("k"))
    left, right = own.select("k", F.col("id").alias("x")), own.select("k", F.col("id").alias("y"))
    return left.join(right, "k").filter("x < y").select("x", "y").distinct()


def slim(keys: DataFrame) -> DataFrame:
    """Few keys are broadcast, so that what they are joined with isn't shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def by_pieces(texts: DataFrame, edits: int, shared: int) -> DataFrame:
    """(x, y) of texts (block, id, text) of which the longer one has a piece of the shorter one.

    Keys are made anew where they are needed, which takes less than to write them.
    """
    size = F.length("text")
    short = texts.select("id", (size <= LONGEST_REST - edits).alias("meets"), F.explode(pieces(F.col("text"), edits)).alias("k"))
    long = texts.select("id", F.explode(stretches(F.col("text"), edits)).alias("s")).select("id", "s.k", "s.longer")
    common = stored(short.filter("meets").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shared).select("k"))
    few = slim(common)
    left = short.join(few.withColumn("meets", F.lit(True)), ["k", "meets"], "left_anti").select("k", F.col("id").alias("x"))
    right = long.select("k", F.col("id").alias("y"), "longer")
    once = F.col("longer") | (F.col("x") < F.col("y"))
    found = left.join(right, "k").filter(once & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    if common.isEmpty():
        return found.distinct()
    hot = short.select("id", "k").unionByName(long.select("id", "k")).join(few, "k", "left_semi").select("id").distinct()
    hot = texts.filter(size <= LONGEST_REST).join(slim(stored(hot)), "id", "left_semi")
    return found.unionByName(by_rests(hot, edits)).distinct()


def near_pairs(texts: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, shared: int = SHARED) -> DataFrame:
    """(block, a, b, edits): distinct texts of a block, of whatever length, that are 1 to ``edits`` edits apart; a < b.

    texts: (block, text). A null block is one like any other; null texts have no pairs; repeated rows count once.
    ``shortest`` and ``shared`` decide by which keys texts meet, not which pairs are found.
    """
    assert shortest > edits * (edits + 2)
    named = F.coalesce(F.concat(F.lit("="), F.col("block").cast("string")), F.lit(""))
    own = stored(texts.filter("text is not null").select("block", "text").distinct().select(named.alias("name"), F.xxhash64(named, F.md5("text")).alias("id"), "block", "text"))
    keyed = own.select(F.col("name").alias("block"), "id", "text")
    few = by_rests(keyed.filter(F.length("text") < shortest + edits), edits)
    found = stored(few.unionByName(by_pieces(keyed.filter(F.length("text") >= shortest), edits, shared)).distinct())
    # Texts come back by their ids, as they would otherwise travel with every key; those that met nothing aren't shuffled.
    met = own.join(slim(found.select(F.explode(F.array("x", "y")).alias("id")).distinct()), "id", "left_semi")
    left, right = (met.select("name", F.col("id").alias(i), *own_block, F.col("text").alias(t)) for i, t, own_block in (("x", "t", ["block"]), ("y", "u", [])))
    both = found.join(left, "x").join(right.withColumnRenamed("name", "other"), "y").filter("name = other")
    judged = both.withColumn("edits", F.levenshtein("t", "u", edits)).filter("edits >= 0")
    return judged.select("block", F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), "edits")
