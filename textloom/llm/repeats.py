"""Removal of every byte that lies in a string of ``WIDTH`` bytes which also starts earlier in the corpus, by suffix order.

Equal strings have to meet in one shard. The gram of least hash among the ``GRAM``-byte grams of a string depends on
the string alone, so consecutive strings of a document with the same least gram make a stretch (``WIDTH`` - 1 bytes
and one for each string), and a gram's stretches meet by the gram. Stretches that are equal as a whole are counted
first: in each chunk of a task, then by gram; all but the first repeat it, and only the first goes on. A string
reaches beyond its gram by half of the rest on one side at least; where a gram is left with several different stretches,
those that have such a side in common with another (by 16 bits, so a few more) are cut out of the texts and laid behind one another in shards, in the
order of the documents. The suffixes of a shard are sorted by external induced sorting, which carries their common
prefixes (module ``induced``); neighbours with a common prefix of ``WIDTH`` bytes are equal strings, of which the one
at the least place stays. A gram with more than ``HOT`` different stretches is split: each of its strings becomes a
stretch of its own and is dealt by its own hash, so no shard grows with a gram.

Grams and whole stretches are compared by 64-bit hashes each (128 bits together); strings within a shard by their bytes.

Defined results: a null text counts as empty; texts of fewer than ``WIDTH`` bytes stay whole; matches never cross
documents; documents are ordered by doc_id, those without one first, and where a doc_id repeats by a hash of the text; of
rows equal in both, one counts as the first and the others repeat it; texts of any length are read whole, in segments
that overlap by ``WIDTH`` - 1 bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import induced
from .common import counted, durable, map_batches, written

WIDTH, GRAM = 100, 48
#: Bytes that a task scans together, and bytes of text whose grams share a bucket, about.
CHUNK, BUCKET = 1 << 21, 1 << 21
#: Buckets whose stretches are sorted together.
BUCKETS_A_SHARD = 4
#: Different stretches of a gram from which it is split.
HOT = 1 << 14
#: Chunks whose records of a bucket meet in one task; more are combined in rounds.
FAN = 1 << 12
#: Stands for a missing doc_id; before all others.
FIRST = -(1 << 63)
#: What a record holds.
RECORD = [("gram", np.uint64), ("digest", np.uint64), ("key", np.int64), ("sub", np.int64), ("start", np.uint32), ("n", np.uint32), ("at", np.uint32), ("left", np.uint16), ("right", np.uint16)]
MARK, REQUEST, SPLIT = range(3)
FOUND = "key long, sub long, start long, n long, gram long, kind int"
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))  # odd multipliers

Records = dict[str, np.ndarray]


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes in a row, by doubling the length that the hashes cover."""

    def mixed(left: np.ndarray, right: np.ndarray, by: np.uint64) -> np.ndarray:
        out = left * by
        out ^= right
        out ^= out >> np.uint64(29)
        out *= M3
        out ^= out >> np.uint64(32)
        return out

    single = mixed(data.astype(np.uint64) + np.uint64(1), np.uint64(0), M1)
    out, n = single, 1
    for bit in bin(width)[3:]:
        out, n = mixed(out[: len(out) - n], out[n:], M2), 2 * n
        if bit == "1":
            out, n = mixed(out[: len(single) - n], single[n:], M1), n + 1
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    out, n = values, 1
    while 2 * n <= width:
        out, n = np.minimum(out[:-n], out[n:]), 2 * n
    rest = width - n
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(pieces: list[tuple[int, int, int, bytes]], width: int, gram: int) -> Records:
    """Records of all stretches of the pieces (key, sub, offset, bytes), in their order; pieces of at least ``width`` bytes."""
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    sizes = np.array([len(p[3]) for p in pieces])
    begins = np.cumsum(sizes) - sizes
    hashes = gram_hashes(data, gram)
    place = (1 << 24) - 1  # the hash decides by its upper 40 bits, then the leftmost place
    least = window_minima((hashes & ~np.uint64(place)) | np.arange(len(hashes), dtype=np.uint64), width - gram + 1)
    valid = np.flatnonzero(np.arange(len(least)) + width <= np.repeat(begins + sizes, sizes)[: len(least)])
    at = (least[valid] & np.uint64(place)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    start, n = valid[first], np.diff(np.append(first, len(valid)))
    last = start + n + width - 1 - gram
    digest = n.astype(np.uint64) * M1
    for j in range(-(-2 * width // gram)):  # enough grams to cover the longest stretch
        digest = (digest ^ hashes[np.minimum(start + j * gram, last)]) * M2
        digest ^= digest >> np.uint64(31)
    gram_at, half = at[first], (width - gram) // 2
    beside = lambda place_, inside: np.where(inside, (hashes[np.clip(place_, 0, len(hashes) - 1)] % np.uint64(65535)).astype(np.uint16) + 1, 0)
    left, right = beside(gram_at - half, gram_at - half >= start), beside(gram_at + half, gram_at + half <= last)
    piece = np.searchsorted(begins, start, "right") - 1
    column = lambda k: np.array([p[k] for p in pieces], np.int64)[piece]
    offset = start - begins[piece] + column(2)
    return {"gram": hashes[at[first]], "digest": digest, "key": column(0), "sub": column(1), "start": offset.astype(np.uint32), "n": n.astype(np.uint32), "at": (gram_at - start).astype(np.uint32), "left": left, "right": right}


def side_shared(records: Records, side: str) -> np.ndarray:
    """Whether another record of the same gram has the same bytes on the side, by their hash; 0 stands for a side that is too short."""
    order = np.lexsort((records[side], records["gram"]))
    gram, beside = records["gram"][order], records[side][order]
    same = (gram[1:] == gram[:-1]) & (beside[1:] == beside[:-1]) & (beside[1:] > 0)
    out = np.zeros(len(order), bool)
    out[order] = np.append(same, False) | np.append(False, same) if len(order) else out
    return out


def firsts(records: Records) -> tuple[Records, Records]:
    """The first record of each whole stretch, and all others."""
    order = np.lexsort([records[c] for c in ("start", "sub", "key", "digest", "gram")])
    records = {c: v[order] for c, v in records.items()}
    new = np.ones(len(order), bool)
    new[1:] = (records["gram"][1:] != records["gram"][:-1]) | (records["digest"][1:] != records["digest"][:-1])
    return {c: v[new] for c, v in records.items()}, {c: v[~new] for c, v in records.items()}


def marks_of(records: Records) -> pd.DataFrame:
    """Strings to remove, runs of consecutive ones as one row."""
    order = np.lexsort([records[c] for c in ("start", "sub", "key")])
    key, sub, start, n = (records[c][order].astype(np.int64) for c in ("key", "sub", "start", "n"))
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] != start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(n, at) if len(at) else n
    return pd.DataFrame({"key": key[at], "sub": sub[at], "start": start[at], "n": sums, "gram": 0, "kind": MARK})


def packed(records: Records) -> bytes:
    return pa.compress(b"".join(records[c].astype(kind).tobytes() for c, kind in RECORD), "zstd", asbytes=True)


def unpacked(n: int, blob: bytes) -> Records:
    sizes = [n * np.dtype(kind).itemsize for _, kind in RECORD]
    data, out, at = pa.decompress(blob, sum(sizes), "zstd", asbytes=True), {}, 0
    for (c, kind), size in zip(RECORD, sizes, strict=True):
        out[c] = np.frombuffer(data, kind, n, at)
        at += size
    return out


def joined(parts: list[Records]) -> Records:
    return {c: np.concatenate([p[c] for p in parts]) for c, _ in RECORD}


BLOBS = "bucket int, salt int, n int, marks int, records binary"


def blobs(records: Records, buckets: int, salts: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that the chunk's first stretches fall into; the strings that repeat them here travel along."""
    own, others = firsts(records)
    bucket = (own["gram"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(bucket[order]) != 0, True)) + 1 if len(order) else order
    salt = int(own["digest"][0] % np.uint64(salts)) if len(order) else 0
    rows, at = [], 0
    for end in ends.tolist():
        part = order[at:end]
        rows.append((int(bucket[part[0]]), salt, len(part), 0, packed({c: v[part] for c, v in own.items()})))
        at = end
    marks = marks_of(others)
    if len(marks):
        zero = np.zeros(len(marks), np.uint64)
        rows.append((int(own["digest"][0] % np.uint64(buckets)), salt, len(marks), 1, packed({c: marks[c].to_numpy() if c in marks and c != "gram" else zero for c, _ in RECORD})))
    names = ["bucket", "salt", "n", "marks", "records"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def scanned(docs: DataFrame, buckets: int, salts: int, width: int) -> DataFrame:
    """Blobs of the records of all texts; a text longer than a chunk is read in segments."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = [], 0
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
            for key, sub, text in zip(batch.column("key").to_pylist(), batch.column("sub").to_pylist(), texts, strict=True):
                data = text.as_py()
                for at in range(0, max(1, len(data) - width + 1), CHUNK):
                    piece = data[at : at + CHUNK + width - 1]
                    if len(piece) < width:
                        continue
                    if held and held + len(piece) > 2 * CHUNK:
                        yield from blobs(stretches(pieces, width, GRAM), buckets, salts)
                        pieces, held = [], 0
                    pieces.append((key, sub, at, piece))
                    held += len(piece)
        if pieces:
            yield from blobs(stretches(pieces, width, GRAM), buckets, salts)

    ship(docs.sparkSession)
    return docs.select("key", "sub", "text").mapInArrow(work, BLOBS)


def opened(frame: pd.DataFrame) -> tuple[Records, list[pd.DataFrame]]:
    """The records of a bucket's blobs, and the marks that came with them."""
    parts, marks = [unpacked(0, packed({c: np.zeros(0, kind) for c, kind in RECORD}))], []
    for row in frame.itertuples():
        found = unpacked(row.n, row.records)
        if row.marks:
            marks.append(pd.DataFrame({c: found[c].astype(np.int64) for c in ("key", "sub", "start", "n")} | {"gram": 0, "kind": MARK}))
        else:
            parts.append(found)
    return joined(parts), marks


def combined(rows: DataFrame, buckets: int, salts: int) -> DataFrame:
    """Rounds over blobs until at most FAN of a bucket are left, so that a stretch in every chunk makes no task large."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        bucket, salt = int(frame["bucket"].iloc[0]), int(frame["salt"].iloc[0]) // FAN
        records, marks = opened(frame)
        own, others = firsts(records)
        kept = pd.concat([marks_of(others), *marks])
        zero = np.zeros(len(kept), np.uint64)
        as_records = {c: kept[c].to_numpy() if c != "gram" and c in kept else zero for c, _ in RECORD}
        out = [(bucket, salt, len(own["gram"]), 0, packed(own))] + ([(bucket, salt, len(kept), 1, packed(as_records))] if len(kept) else [])
        return pd.DataFrame(out, columns=["bucket", "salt", "n", "marks", "records"])

    while salts > 1:
        rows = rows.groupBy("bucket", "salt").applyInPandas(work, BLOBS)
        salts = -(-salts // FAN)
    return rows


def met(rows: DataFrame, hot: int, width: int) -> DataFrame:
    """(key, sub, start, n, gram, kind): strings that repeat an earlier stretch as a whole, and stretches whose bytes have to be compared."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        records, marks = opened(frame)
        own, others = firsts(records)
        left, right = side_shared(own, "left"), side_shared(own, "right")
        asked = {c: own[c].astype(np.int64) for c in ("key", "sub", "start", "n", "gram", "at")}
        # strings with a side that no other has reach to the other side
        half = (width - GRAM) // 2
        first = np.where(left, 0, np.maximum(asked["at"] - half + 1, 0))
        stop = np.where(right, asked["n"], np.minimum(asked["n"], asked["at"] - half))
        wanted = (left | right) & (stop > first)
        asked["start"] += first
        asked["n"] = stop - first
        asked = {c: v[wanted] for c, v in asked.items()}
        gram = asked["gram"]
        group = np.cumsum(np.append(True, gram[1:] != gram[:-1])[: len(gram)]) - 1
        kind = np.where(np.bincount(group)[group] > hot, SPLIT, REQUEST) if len(group) else group
        asked = pd.DataFrame({c: asked[c] for c in ("key", "sub", "start", "n", "gram")} | {"kind": kind})
        return pd.concat([marks_of(others), asked, *marks])

    return rows.groupBy("bucket").applyInPandas(work, FOUND)


def asked_of(docs: DataFrame, found: DataFrame, kind: int) -> DataFrame:
    """(key, sub, text, starts, ns, grams) of the documents of which something is asked."""
    lists = found.filter(F.col("kind") == kind).groupBy("key", "sub").agg(F.collect_list(F.struct("start", "n", "gram")).alias("x"))
    return docs.join(lists, ["key", "sub"]).select("key", "sub", "text", *(F.col(f"x.{c}").alias(f"{c}s") for c in ("start", "n", "gram")))


def cut(docs: DataFrame, found: DataFrame, shards: int, width: int) -> DataFrame:
    """(shard, key, sub, start, n, bytes): the stretches to be compared."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
        for text, key, sub, *asked in zip(texts, *(batch.column(c).to_pylist() for c in ("key", "sub", "starts", "ns", "grams")), strict=True):
            data = text.as_py()
            out += [(int(np.uint64(g % (1 << 64)) % np.uint64(shards)), key, sub, s, n, data[s : s + n + width - 1]) for s, n, g in zip(*asked, strict=True)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["shard", "key", "sub", "start", "n", "bytes"])

    return map_batches(asked_of(docs, found, REQUEST), work, "shard int, key long, sub long, start long, n long, bytes binary")


def repeated_in(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """The strings of a shard that occur earlier in it."""
    frame = frame.sort_values(["key", "sub", "start"])
    parts, n = list(frame["bytes"]), frame["n"].to_numpy()
    sizes = np.array([len(p) + 1 for p in parts])
    begins = np.cumsum(sizes) - sizes
    text = np.append(np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int32) + 2, 0)
    text[begins + sizes - 1] = 1  # between stretches
    owner = np.repeat(np.arange(len(parts)), sizes)
    order, common = induced.suffixes(text, width)
    group = np.cumsum(common < width)
    place = np.asarray(order, np.int64)
    inside = np.flatnonzero(place < len(owner))
    inside = inside[place[inside] - begins[owner[place[inside]]] < n[owner[place[inside]]]]
    group, place = group[inside], place[inside]
    least = np.full(int(group.max(initial=0)) + 1, len(text), np.int64)
    np.minimum.at(least, group, place)
    again = np.sort(place[place > least[group]])
    own = owner[again]
    column = lambda c: frame[c].to_numpy()[own]
    return marks_of({"key": column("key"), "sub": column("sub"), "start": column("start") + again - begins[own], "n": np.ones(len(again), np.int64)})


def compared(pieces: DataFrame, shards: int, width: int) -> DataFrame:
    """The strings of all shards that occur earlier; a task for each shard, as their rows are few for the work they make."""
    ship(pieces.sparkSession)
    return pieces.repartition(shards, "shard").groupBy("shard").applyInPandas(lambda frame: repeated_in(frame, width), FOUND)


def split(docs: DataFrame, found: DataFrame, buckets: int, salts: int, width: int) -> DataFrame:
    """The strings of split grams, each a stretch of its own, met by their own hashes."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [{c: np.zeros(0, kind) for c, kind in RECORD}]
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
        for text, key, sub, starts, ns in zip(texts, *(batch.column(c).to_pylist() for c in ("key", "sub", "starts", "ns")), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for s, n in zip(starts, ns, strict=True):
                own = data[s : s + n + width - 1]
                parts.append({"gram": gram_hashes(own, width), "digest": gram_hashes(own[::-1], width)[::-1], "key": np.full(n, key), "sub": np.full(n, sub), "start": np.arange(s, s + n), "n": np.ones(n, np.int64), "at": np.zeros(n, np.uint32), "left": np.zeros(n, np.uint16), "right": np.zeros(n, np.uint16)})
        yield from blobs(joined(parts), buckets, salts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    return met(combined(asked_of(docs, found, SPLIT).mapInArrow(run, BLOBS), buckets, salts), HOT, width).filter(F.col("kind") == MARK)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, sub, text) without rows equal in id and text, and (key, sub, copies) of those that occur several times.

    ``sub`` tells apart rows that share a doc_id, by a hash of the text, and is 0 for all others; it is odd for a row
    without doc_id.
    """
    own = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("key"), F.col("doc_id").isNull().cast("long").alias("none"), "text")
    shared = durable(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit(True).alias("twice")))
    if shared.isEmpty():
        return own.select("key", F.col("none").alias("sub"), "text"), None
    sub = F.when(F.col("twice"), F.shiftleft(F.xxhash64(F.coalesce("text", F.lit(""))), 1)).otherwise(F.lit(0).cast("long")).bitwiseOR(F.col("none"))
    own = own.join(counted(shared), "key", "left").withColumn("sub", sub)
    copies = durable(own.filter("twice").groupBy("key", "sub").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    own = own.select("key", "sub", "text")
    if copies.isEmpty():
        return own, None
    few = counted(copies.select("key", "sub"))
    return own.join(few, ["key", "sub"], "left_anti").unionByName(own.join(few, ["key", "sub"], "left_semi").dropDuplicates(["key", "sub"])), copies


def doc_id_of(key: str, sub: str) -> Column:
    return F.when(F.col(sub) % 2 == 0, F.col(key)).alias("doc_id")


def find_repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(key, sub, start, n): from ``start`` on, ``n`` strings in a row repeat an earlier one; docs: (key, sub, text)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 + size // BUCKET
    salts = -(-(1 + size // CHUNK) // FAN)
    found = written(met(combined(scanned(docs, buckets, salts, width), buckets, salts), hot, width), "repeats")
    shards = -(-buckets // BUCKETS_A_SHARD)
    marks = [found.filter(F.col("kind") == MARK), compared(cut(docs, found, shards, width), shards, width)]
    if not found.filter(F.col("kind") == SPLIT).isEmpty():
        marks.append(split(docs, found, buckets, salts, width))
    out = marks[0]
    for more in marks[1:]:
        out = out.unionByName(more)
    return out.select("key", "sub", "start", "n")


def spans_of(starts: list[int] | None, ns: list[int] | None, width: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the marked strings cover."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(zip(starts or [], ns or [], strict=True)):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], start + n + width - 1)
        else:
            out.append((start, start + n + width - 1))
    return out


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(end for _, end in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(start for start, _ in spans), len(data)], strict=True))


def remove_repeats(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """A row for each document: doc_id, its number of bytes, the removed spans, and the bytes that stay."""
    own, copies = keyed(docs)
    marks = find_repeats(own, width, hot)  # of the same columns as below, so that the texts are shuffled once
    lists = marks.groupBy("key", "sub").agg(F.collect_list(F.struct("start", "n")).alias("x")).select("key", "sub", F.col("x.start").alias("starts"), F.col("x.n").alias("ns"))
    asked = own.join(lists, ["key", "sub"], "left")
    if copies is None:
        asked = asked.withColumn("copy", F.lit(1))
    else:
        asked = asked.join(counted(copies), ["key", "sub"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.as_py() for t in pc.fill_null(batch.column("text"), "").cast(pa.large_binary())]
        spans = []
        for data, starts, ns, copy in zip(texts, *(batch.column(c).to_pylist() for c in ("starts", "ns", "copy")), strict=True):
            spans.append([(0, len(data))] if copy > 1 and len(data) >= width else spans_of(starts, ns, width))
        bounds = lambda k: pa.array([[s[k] for s in own_] for own_ in spans], pa.list_(pa.int64()))
        columns = [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), bounds(0), bounds(1), pa.array([kept(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "starts", "ends", "kept"])

    schema = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
    return map_batches(asked.select(doc_id_of("key", "sub"), "text", "starts", "ns", "copy"), work, schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Numbers of bytes, removed bytes and removed runs of each document, and the digest of what stays."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
