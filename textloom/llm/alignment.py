"""Alignment of two tokenizers over the same bytes, and which token of B stands for which of A.

A is a byte-level vocabulary with the pattern of its pre-tokenisation, B a sentence-piece model.

The tokens of B tile a text, so the ends of their byte ranges are a static interval index. Two bisections for each
token of A (where it begins, where its last byte lies) stab the index and give the tokens of B that it overlaps; a
gap between two tokens of B that no token of A spans is the boundary of a group. All texts of a batch lie in one
index, one behind the other.

How often an id pair is linked is counted in documents over the whole corpus. Counts come back to the documents in
two tiers: the ``FREQUENT`` pairs with the highest counts are broadcast, all others meet their count in a join by
pair. A pair of the second tier can't be hot: at least ``FREQUENT`` pairs occur in as many documents as it does.

Defined results: a text that is null, empty or whose tokens don't give its bytes back (with a space before it) has no
tokens and counts zero; special strings inside texts are ordinary text; texts of any length are aligned whole;
repeated rows are documents of their own, with or without doc_id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, map_batches, once, texts_of, written
from .words import Words

#: Pairs whose counts are broadcast.
FREQUENT = 1 << 17
#: How a byte without a piece of its own and a space are written in B's vocabulary (fixed values).
BYTE, SPACE = "<0x{:02X}>", "▁"


class Aligned:
    """A batch in flat arrays: ids of both sides, ends of each text in them, the overlaps, the groups' ends."""

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, a_texts: np.ndarray, b: np.ndarray, b_ends: np.ndarray, b_texts: np.ndarray) -> None:
        """a_ends, b_ends: byte offsets where tokens end; a_texts, b_texts: tokens up to each text's end."""
        self.a, self.a_texts, self.b, self.b_texts = a, a_texts, b, b_texts
        starts = np.concatenate([np.zeros(1, np.int64), a_ends[:-1]])[: len(a)]
        first = np.searchsorted(b_ends, starts, "right")
        last = np.searchsorted(b_ends, a_ends, "left")
        n = last - first + 1
        self.links = n
        self.link_a = np.repeat(np.arange(len(a)), n)
        self.link_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
        opened = np.bincount(first, minlength=len(b) + 1) - np.bincount(last, minlength=len(b) + 1)
        self.group_b = np.flatnonzero(np.cumsum(opened)[: len(b)] == 0) + 1
        self.group_a = np.searchsorted(a_ends, b_ends[self.group_b - 1]) + 1

    def bounds(self, ends: np.ndarray, texts: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, texts, "right")


class Aligner:
    """A worker's two tokenizers, with the bytes of every id."""

    def __init__(self, a_vocabulary: str, pattern: str, b_model: bytes) -> None:
        words = Words(a_vocabulary)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        ranks = words.codec._mergeable_ranks
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})  # the tokenizer's own library takes four times as long
        self.a_ids, self.a_bytes = words.ids, sorted(ranks, key=ranks.__getitem__)
        single = {BYTE.format(b): bytes([b]) for b in range(256)}
        pieces = map(self.b.id_to_piece, range(self.b.vocab_size()))
        self.b_bytes = [single[p] if p in single else p.replace(SPACE, " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(max(int(self.a_ids.max()) + 1, len(self.b_bytes)))]

    def of(self, texts: list[str]) -> tuple[list[int], Aligned]:
        """Which of the texts have tokens, and their alignment."""
        found_a = [self.a.encode_ordinary(f" {t}") for t in texts]
        found_b = self.b.encode(texts, num_threads=1) if texts else []
        held, a, b = [], [], []
        for k, (text, own_a, own_b) in enumerate(zip(texts, found_a, found_b, strict=True)):
            want = f" {text}".encode()
            if text and b"".join(map(self.a_bytes.__getitem__, own_a)) == want and b"".join(map(self.b_bytes.__getitem__, own_b)) == want:
                held.append(k)
                a.append(own_a)
                b.append(own_b)
        flat = lambda side: np.fromiter(chain.from_iterable(side), np.int64, sum(map(len, side)))
        ends = lambda side: np.cumsum([len(own) for own in side], dtype=np.int64)
        ranks_a, ids_b = flat(a), flat(b)
        return held, Aligned(self.a_ids[ranks_a], np.cumsum(self.a_sizes[ranks_a]), ends(a), ids_b, np.cumsum(self.b_sizes[ids_b]), ends(b))

    def groups_written(self, x: Aligned) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``: all tokens in the order in which they are written, each with the mark behind it."""
        size = len(self.written) // 3
        group_sizes = lambda ends: np.diff(ends, prepend=0)
        n_a, n_b = group_sizes(x.group_a), group_sizes(x.group_b)
        codes_a, codes_b = x.a.copy(), x.b.copy()
        codes_a[x.group_a - 1] += size
        codes_b[x.group_b - 1] += 2 * size
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        codes[np.arange(len(x.a)) + np.repeat(x.group_b - n_b, n_a)] = codes_a
        codes[np.arange(len(x.b)) + np.repeat(x.group_a, n_b)] = codes_b
        texts = np.concatenate([np.zeros(1, np.int64), x.a_texts + x.b_texts]).tolist()
        return ["".join(map(self.written.__getitem__, codes[i:j].tolist()))[:-1] for i, j in pairwise(texts)]


def shared_aligner(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> Callable[[], Aligner]:
    """How a worker gets its tokenizers; both files are bounded by their vocabularies."""
    shared = docs.sparkSession.sparkContext.broadcast((Path(a_path).read_text(), pattern, Path(b_path).read_bytes()))
    key = fresh("aligner")
    return lambda: once(key, lambda: Aligner(*shared.value))


def lists(ends: np.ndarray, values: np.ndarray, held: list[int], rows: int, kind: pa.DataType) -> pa.ListArray:
    """A list for each row, empty for those that aren't held; ends: of each held row's values."""
    sizes = np.zeros(rows, np.int64)
    sizes[held] = np.diff(ends, prepend=0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """A row for each document: the ids of both sides, behind which tokens of either side a group ends, and the links.

    ``link_a`` and ``link_b`` are places in ``a_ids`` and ``b_ids`` of all tokens that share a byte.
    """
    aligner = shared_aligner(docs, a_path, pattern, b_path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        held, x = aligner().of(texts)
        a_from, b_from = (np.concatenate([np.zeros(1, np.int64), t[:-1]])[: len(t)] for t in (x.a_texts, x.b_texts))
        ends = np.searchsorted(x.group_b, x.b_texts, "right")
        linked = np.searchsorted(x.link_a, x.a_texts, "left")
        local = lambda values, stops, base: values - np.repeat(base, np.diff(stops, prepend=0))
        made = [(x.a_texts, x.a), (x.b_texts, x.b), (ends, local(x.group_a, ends, a_from)), (ends, local(x.group_b, ends, b_from)), (linked, local(x.link_a, linked, a_from)), (linked, local(x.link_b, linked, b_from))]
        columns = [batch.column("doc_id"), *(lists(stops, values, held, len(texts), pa.int32()) for stops, values in made)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "group_a", "group_b", "link_a", "link_b"])

    kinds = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "group_a", "group_b", "link_a", "link_b"))
    return map_batches(docs.select("doc_id", "text"), work, f"doc_id long, {kinds}")


def linked_pairs(docs: DataFrame, row: str, a_path: str, pattern: str, b_path: str) -> DataFrame:
    """A row for each document: counts, the digest of its groups, its distinct linked id pairs (``a * stride + b``) and how often each is linked."""
    aligner, stride = shared_aligner(docs, a_path, pattern, b_path), sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    small = (int(Words(Path(a_path).read_text()).ids.max()) + 1) * stride < 1 << 31

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        held, x = aligner().of(texts)
        counts = np.zeros((4, len(texts)), np.int64)
        linked = np.searchsorted(x.link_a, x.a_texts, "left")
        for own, stops in zip(counts, (x.a_texts, x.b_texts, np.searchsorted(x.group_b, x.b_texts, "right"), linked), strict=True):
            own[held] = np.diff(stops, prepend=0)
        digests = [""] * len(texts)
        for k, written_ in zip(held, aligner().groups_written(x), strict=True):
            digests[k] = hashlib.sha256(written_.encode()).hexdigest()
        text = np.repeat(np.arange(len(held)), np.diff(linked, prepend=0))
        pairs, times = np.unique((text << 40) | (x.a[x.link_a] * stride + x.b[x.link_b]), return_counts=True)
        ends = np.searchsorted(pairs >> 40, np.arange(len(held)), "right")
        kind = pa.int32() if small else pa.int64()
        columns = [
            *(batch.column(c) for c in (row, "doc_id")),
            *(pa.array(own, pa.int64()) for own in counts),
            pa.array(digests, pa.string()),
            lists(ends, pairs & ((1 << 40) - 1), held, len(texts), kind),
            lists(ends, times, held, len(texts), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, [row, "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    schema = f"{row} long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{'int' if small else 'bigint'}>, times array<int>"
    return map_batches(docs.select(row, "doc_id", "text"), work, schema)


def pair_counts(linked: DataFrame, stride: int) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether that is the highest count of its A id."""
    counts = durable(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.expr(f"pair div {stride}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(highest), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_counts(docs: DataFrame, a_path: str, pattern: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """A row for each document: tokens, groups, links, links to the best partner of their A id, sum of the links' counts."""
    row, stride = fresh("row"), sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    linked = written(linked_pairs(docs.select("doc_id", "text").withColumn(row, F.monotonically_increasing_id()), row, a_path, pattern, b_path), "aligned")
    scored = durable(pair_counts(linked, stride))
    first = durable(scored.orderBy(F.desc("n"), "pair").limit(frequent))
    links = linked.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    near = links.join(F.broadcast(first), "pair")
    far = links.join(F.broadcast(first.select("pair")), "pair", "left_anti").join(scored, "pair")
    sums = lambda x: x.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    both = sums(near).unionByName(sums(far)).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return linked.drop("pairs", "times").join(both, row, "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
