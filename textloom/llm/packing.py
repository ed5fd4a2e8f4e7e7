"""Packing token sequences by cutting-stock column generation.

Texts become ids through a worker cache of white-space-delimited chunks (no token crosses white space, so a
text's ids are its chunks' ids in order), filled by the library. A document's ids are cut into full sequences and
one remainder. The histogram of remainders by length class is the demand of a cutting-stock problem: its linear
program is solved by column generation, where a knapsack dynamic program over the class widths prices patterns
by the duals; patterns are rounded down and the few pieces left over are packed by best fit. Pieces get their
gapless rank in their length class, and the intervals of ranks that each pattern takes give every piece its
sequence. The histogram and the patterns have ``CLASSES`` entries and a few hundred, whatever the input.

Defined results: null text counts as empty and is the end id alone; a document of any length is packed whole;
repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import ship
from .common import durable, fresh, numbered, once, texts_of
from .words import Words

CAPACITY, END_ID = 2048, 1
#: Length classes of remainders; the last is a full sequence.
CLASSES = 256
#: Chunks that a worker remembers, and the longest that it does.
CACHE_ENTRIES, CACHE_CHARS = 3 << 18, 64
MOST_COLUMNS, GAP = 4_000, 0.001
ROWS_A_BUCKET = 1 << 12
TOGETHER = 128

# Str.split() also splits at these, which Unicode doesn't call white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_CHUNKS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of texts as bytes, four for each id, lowest first.

    Unseen chunks that are a word with punctuation after it take the ids of both; unseen words are encoded in one
    call, and every other chunk by the library.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        self.tokenizer, self.words = Tokenizer.from_str(vocabulary), Words(vocabulary)
        self.cache: dict[str, bytes] = {"": b""}

    def library(self, chunks: list[str]) -> dict[str, bytes]:
        encoded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, encoded, strict=True)}

    def lower_words(self, words: list[str]) -> dict[str, bytes]:
        found = self.words.encode(words) if words else None
        if found is None:
            return self.library(words)
        raw, ends = found[0].astype("<u4").tobytes(), (4 * found[1]).tolist()
        return {w: raw[a:b] for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}

    def learn(self, chunks: set[str]) -> None:
        cache = self.cache
        plain = [c for c in chunks if c.isalpha() and c.isascii() and c.islower()]
        cache |= self.lower_words(plain)
        parted, words, others = [], set(), set()
        for c in chunks.difference(plain):
            core = c.rstrip(string.punctuation)
            if core.isalpha() and (core.isascii() or core.islower() and unicodedata.is_normalized("NFC", core)):
                word, tail = core.lower(), c[len(core) :]
                parted.append((c, word, tail))
                if word not in cache:
                    words.add(word)
                if tail not in cache:
                    others.add(tail)
            else:
                others.add(c)
        if others:
            cache |= self.library(list(others))
        if words:
            cache |= self.lower_words(list(words))
        for c, word, tail in parted:
            cache[c] = cache[word] + cache[tail]

    def of(self, texts: list[str]) -> list[bytes]:
        chunks = [_CHUNKS.findall(t) if _SEPARATORS.search(t) else t.split() for t in texts]
        wanted = set().union(*chunks).difference(self.cache)
        if len(self.cache) + len(wanted) > CACHE_ENTRIES:
            self.cache = {"": b""}
            wanted = set().union(*chunks)
        self.learn(wanted)
        out = [b"".join(map(self.cache.__getitem__, own)) for own in chunks]
        for c in wanted:
            if len(c) > CACHE_CHARS:
                del self.cache[c]
        return out


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Full sequences and one remainder for each document, with the CRC-32 of their ids."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())  # bounded by the vocabulary file
    key, end = fresh("encoder"), np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ship(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(key, lambda: Encoder(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.of(texts_of(part)), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc_id, a, min(CAPACITY, n - a), zlib.crc32(ids[4 * a : 4 * (a + CAPACITY)]), n) for a in range(0, n, CAPACITY)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(work, PIECES)


def best_pattern(duals: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of widths that fit the capacity and are worth most."""
    worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(widths, np.arange(capacity + 1), "right").tolist()
    for room in range(1, capacity + 1):
        best, chosen = worth[room - 1], -1
        if n := fits[room]:
            gains = worth[room - widths[:n]] + duals[:n]
            if gains[i := gains.argmax()] > best + 1e-12:
                best, chosen = gains[i], i
        worth[room], choice[room] = best, chosen
    counts, room = np.zeros(len(widths), int), capacity
    while room > 0:
        if (i := choice[room]) < 0:
            room -= 1
        else:
            counts[i] += 1
            room -= widths[i]
    return float(worth[capacity]), counts


def dot(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product without the linear algebra library, whose threads cost more than such small matrices gain."""
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, likewise."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        factors = both[:, i].copy()
        factors[i] = 0
        rows = np.flatnonzero(factors)
        both[rows] -= np.outer(factors[rows], both[i])
    return both[:, n:]


def cutting_stock(demand: np.ndarray, widths: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts of each width) and how often each is used; together they hold the demand exactly.

    demand: pieces of each width, all above zero; widths: ascending. The basis of the linear program has one
    pattern for each width and starts with patterns of one width. Patterns are priced at duals drawn towards
    those of the best lower bound so far, and at the duals themselves where that finds nothing. Within ``GAP`` of
    the bound, it ends.
    """
    demand = demand.astype(np.int64)
    need = demand * (1 + 1e-4 * np.modf(0.6180339887 * np.arange(1, len(widths) + 1))[0]) + 1e-3  # no ties, so steps don't cycle
    basis = np.diag(capacity // widths).astype(float)
    inverse = np.diag(1.0 / (capacity // widths))
    bound, centre, costs = 0.0, None, np.ones(len(widths))
    for turn in range(1, MOST_COLUMNS):
        duals, use = (costs[:, None] * inverse).sum(axis=0), dot(inverse, need)
        if duals.min() < -1e-9:  # holding more of a width than is needed costs nothing
            counts, cost = -1.0 * (np.arange(len(widths)) == duals.argmin()), 0.0
        else:
            cost = 1.0
            duals = np.maximum(duals, 0)
            for prices in (duals if centre is None else 0.8 * centre + 0.2 * duals, duals):
                value, counts = best_pattern(prices, widths, capacity)
                if (low := float((prices * need).sum()) / max(value, 1)) > bound:
                    bound, centre = low, prices / max(value, 1)
                if (duals * counts).sum() > 1 + 1e-9:
                    break
            else:
                break
            if (costs * use).sum() <= bound * (1 + GAP):
                break
        change = dot(inverse, counts)
        steps = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        leaving = int(steps.argmin())
        basis[:, leaving], costs[leaving] = counts, cost
        if turn % 50 == 0:
            inverse = inverted(basis)
        else:
            row = inverse[leaving] / change[leaving]
            inverse -= np.outer(change, row)
            inverse[leaving] = row
    use = np.maximum(dot(inverted(basis), demand.astype(float)), 0)
    found, left = [], demand.copy()
    for column in np.argsort(-use, kind="stable"):
        if not costs[column]:
            continue
        counts = basis[:, column].round().astype(np.int64)
        held = counts > 0
        times = min(int(use[column] + 1e-6), int((left[held] // counts[held]).min()))
        if times > 0:
            found.append((counts, times))
            left -= counts * times
    return found + best_fit(left, widths, capacity)


def best_fit(left: np.ndarray, widths: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Packs what rounding left over, widest first, each into the fullest pattern that has room."""
    rooms: list[int] = []
    patterns: list[np.ndarray] = []
    for i in range(len(widths) - 1, -1, -1):
        for _ in range(int(left[i])):
            able = [j for j, room in enumerate(rooms) if room >= widths[i]]
            j = min(able, key=lambda j: rooms[j], default=-1)
            if j < 0:
                rooms.append(capacity)
                patterns.append(np.zeros(len(widths), np.int64))
            rooms[j] -= int(widths[i])
            patterns[j][i] += 1
    return [(p, 1) for p in patterns]


class Layout:
    """Where the piece of a given class and rank goes."""

    def __init__(self, histogram: dict[int, int]) -> None:
        widths = np.array(sorted(histogram), np.int64)
        demand = np.array([histogram[w] for w in widths], np.int64)
        plan = cutting_stock(demand, widths, CLASSES) if len(widths) else []
        filled, base, rows = np.zeros(len(widths), np.int64), 0, []
        for counts, times in plan:
            for i in np.flatnonzero(counts):
                rows.append((int(widths[i]), int(filled[i]), int(counts[i]), base))
                filled[i] += counts[i] * times
            base += times
        if (filled != demand).any():
            raise AssertionError("patterns don't hold the demand")
        rows.sort()
        self.sequences = base
        self.keys = np.array([(w << 48) + first for w, first, _, _ in rows], np.int64)
        self.first, self.each, self.base = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))

    def sequence(self, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, (kind.astype(np.int64) << 48) + rank, "right") - 1
        return self.base[at] + (rank - self.first[at]) // self.each[at]


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """A row for each piece: where it lies in its document, its digest, its sequence and offset there."""
    step = CAPACITY // CLASSES
    # Rows equal in all else are told apart by a row number, which must not change.
    cut = durable(pieces(docs, path).withColumn("kind", F.ceil(F.col("length") / step).cast("int")).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["kind"]: r["n"] for r in cut.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # CLASSES rows at most
    layout = Layout(histogram)
    shared = docs.sparkSession.sparkContext.broadcast(layout)  # a few hundred patterns of a few classes each
    each = [F.lit(x) for kind, n in histogram.items() for x in (kind, 1 + n // ROWS_A_BUCKET)]  # CLASSES entries at most
    spread = F.create_map(*each)[F.col("kind")] if each else 1
    ranked = numbered(cut, ["kind"], ["length", "doc_id", "start", "row"], "rank", spread)
    schema = f"{PIECES}, sequence_id long"

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.sequence(batch.column("kind").to_numpy(), batch.column("rank").to_numpy())
            names = batch.schema.names[:5]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.int64())], [*names, "sequence_id"])

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank").mapInArrow(place, schema)
    # A sequence has CAPACITY pieces at most.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
