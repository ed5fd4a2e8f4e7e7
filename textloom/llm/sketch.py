"""Bottom-k sketches of word shingles, with built-in functions alone.

A sketch is the ascending array of the k least distinct hashes of a text's shingles of five words. Sketches of
parts merge by union; from sketches come estimates of resemblance, containment and of the number of distinct
shingles, exact while the sets have fewer than k members.

Defined results: null text counts as empty; white space splits words; a text of one to four words is one
shingle; no words give the empty sketch; two empty sketches have likeness 1, an empty and another one 0. Where
documents share a doc_id, they share the next document, and the one of them whose first half sorts first serves
as the next of the document before; rows without doc_id have no next document, and their edited text is their
own first half. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

WORDS, K, SALTS = 5, 64, 16
#: Rows of the id order that are sorted together, about.
IDS_A_RANGE = 1 << 14


def with_sketch(df: DataFrame, text: str, name: str, words: int = WORDS, k: int = K) -> DataFrame:
    """Adds the sketch of a column without nulls. Word hashes are a column of their own on the way, so they are computed once."""
    hashes = f"__{name}_hashes"
    split = F.array_remove(F.split(F.col(text), r"[ \t-\r]+"), "")
    df = df.withColumn(hashes, F.transform(split, lambda w: F.xxhash64(w)))
    size, h = F.size(hashes), F.col(hashes)
    rolled = F.transform(F.sequence(F.lit(0), size - words), lambda i: F.xxhash64(*[h[i + j] for j in range(words)]))
    short = F.when(size > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    every = F.when(size >= words, rolled).otherwise(short)
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(every)), 1, k)).drop(hashes)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(df: DataFrame, keys: list[str], name: str, k: int = K) -> DataFrame:
    """(keys, name): the sketch of all rows of a key together, in two levels; however many rows, a task holds k hashes of a key.

    Equal hashes meet before the shuffle; of each salted part only the k least go on, and of these the k least of the key.
    """
    hashes = df.select(*keys, F.explode_outer(F.col(name)).alias("__h")).distinct().withColumn("__salt", F.pmod(F.xxhash64("__h"), F.lit(SALTS)))
    for parts in ([*keys, "__salt"], keys):
        turn = F.row_number().over(Window.partitionBy(*parts).orderBy(F.col("__h").asc_nulls_last()))  # a limit of ranks is applied before the shuffle, too
        hashes = hashes.withColumn("__turn", turn).filter(F.col("__turn") <= k).drop("__turn")
    return hashes.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(name))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the union's k least hashes that both sketches hold."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """From the k-th least hash's place in the range of hashes; exact if there are fewer than k."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has too; 1 if a has none."""
    union = merged(a, b, k)
    shared = resemblance(a, b, k) * distinct_shingles(union, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def written(a: Column) -> Column:
    """Base 64 of the hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def next_ids(ids: DataFrame) -> DataFrame:
    """(next_id, for_id, for_chars) from (doc_id, n_chars): the next smaller doc_id; after the smallest, the largest.

    Ids are dealt to ranges and only looked up within their range; the ends of the ranges, one row each, are
    chained separately, so nothing is ordered in a single task.
    """
    distinct = ids.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    ranges = max(1, distinct.count() // IDS_A_RANGE)
    placed = durable(distinct.repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id()))  # parts must not change
    ends = placed.groupBy("part").agg(F.max("doc_id").alias("top"))
    chain = Window.orderBy("part")
    largest = F.max("top").over(Window.partitionBy())
    ends = ends.select("part", F.coalesce(F.lag("top").over(chain), largest).alias("below"))
    inside = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return placed.withColumn("lower", inside).join(ends, "part").select(F.coalesce("lower", "below").alias("next_id"), F.col("doc_id").alias("for_id"), F.col("n_chars").alias("for_chars"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Sketches of every text and of its edited text, whose second half is the next document's beginning."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    order = next_ids(texts.select("doc_id", "n_chars"))
    own = with_sketch(texts, "text", "sketch")
    # Both uses of the joined rows read the same columns of the texts, so that one exchange of them serves both.
    linked = own.filter("doc_id is not null").join(order, own.doc_id == order.next_id).select("doc_id", "text", "n_chars", "sketch", "for_id", "for_chars")
    first = F.row_number().over(Window.partitionBy("for_id").orderBy("head", "next_chars"))
    following = (
        linked.select("for_id", F.expr("substring(text, 1, cast(for_chars div 2 as int))").alias("head"), F.col("sketch").alias("next_sketch"), F.col("n_chars").alias("next_chars"))
        .withColumn("turn", first)
        .filter("turn = 1")
        .drop("turn")
    )
    named = linked.select("doc_id", "text", "n_chars", "sketch").join(following, F.col("doc_id") == F.col("for_id"))
    pairs = named.unionByName(own.filter("doc_id is null"), allowMissingColumns=True)
    edited = pairs.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), coalesce(substring(head, 1, cast(n_chars div 2 as int)), ''))")).drop("text", "head")
    out = with_sketch(edited.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch")
    own, other = F.col("sketch"), F.coalesce("next_sketch", F.array().cast("array<bigint>"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(own, F.col("edited_sketch")).alias("near_edited"),
        resemblance(own, other).alias("near_next"),
        containment(own, F.col("edited_sketch")).alias("contained_in_edited"),
        containment(own, other).alias("contained_in_next"),
        distinct_shingles(own).alias("n_shingles"),
        distinct_shingles(merged(own, other)).alias("n_shingles_with_next"),
    )
