"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The split that the pattern ``public_tokenizers.PATTERN`` makes is found without a regular expression: every
code point gets a class, neighbouring classes give a symbol, and each symbol is a transition function of a
small automaton. Functions compose associatively, and all compositions that can occur are few, so the states
at all positions come from a blocked prefix scan over function numbers with one table lookup a step. The
slices between boundaries go through pair merging, cached by slice; the offsets of vocabulary entries in one
byte string serve decoding.

Defined results: null text counts as empty; an empty text has no tokens; texts are encoded whole, whatever
their length (long slices merge with a heap, in n log n); other input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import fresh, map_batches, once, texts_of

#: Slices that a worker remembers, and the longest that it does.
CACHE_ENTRIES, CACHE_CHARS = 1 << 18, 64
#: Characters scanned together.
SCAN_CHARS = 1 << 19
#: Positions in a block of the scan.
BLOCK = 64
HEAP_FROM = 48

LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_IN, WHITE_LAST, SHORT, LONG = range(8)
STATES = IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE, CLOSED = range(8)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after the symbol, and whether a slice begins before it.

    SHORT and LONG are apostrophes before s, t, m, d and before re, ve, ll. They begin a slice of their own
    unless a run of other characters or a single space is open. SPACE_LAST is a space before a character
    that isn't white; it joins what follows.
    """
    if symbol == LETTER:
        return {ONE_MORE: CLOSED, TWO_MORE: ONE_MORE}.get(state, IN_LETTER), state not in (IN_LETTER, AFTER_SPACE, ONE_MORE, TWO_MORE)
    if symbol == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, AFTER_SPACE)
    if symbol == OTHER or symbol in (SHORT, LONG) and state in (IN_OTHER, AFTER_SPACE):
        return IN_OTHER, state not in (IN_OTHER, AFTER_SPACE)
    if symbol in (SHORT, LONG):
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == SPACE_LAST:
        return AFTER_SPACE, True
    return IN_WHITE, symbol == WHITE_LAST or state != IN_WHITE


class Scanner:
    """Boundaries of many texts at once."""

    def __init__(self, classes: np.ndarray) -> None:
        self.classes = classes
        symbols = range(8)
        # A text's first symbol forgets the state before it: symbol + 8.
        basic = [tuple(step(s, x)[0] for s in STATES) for x in symbols] + [tuple(step(CLOSED, x)[0] for _ in STATES) for x in symbols]
        known = {f: i for i, f in enumerate(dict.fromkeys(basic))}
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in basic:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        functions = list(known)
        self.number = np.array([known[f] for f in basic], np.uint8)
        self.size = len(functions)
        if self.size > 256:
            raise AssertionError("the automaton has more compositions than a byte numbers")
        self.compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8).ravel()
        self.state = np.array([f[CLOSED] for f in functions], np.uint8)
        self.cuts = np.array([[step(s, x)[1] for x in symbols] for s in STATES])

    def scanned(self, f: np.ndarray) -> np.ndarray:
        """Prefix compositions: position i holds the function of symbols 0 to i."""
        if len(f) <= BLOCK:
            out = f.copy()
            for i in range(1, len(f)):
                out[i] = self.compose[int(out[i - 1]) * self.size + int(f[i])]
            return out
        n = -(-len(f) // BLOCK)
        padded = np.zeros(n * BLOCK, np.uint8)
        padded[: len(f)] = f
        grid = np.ascontiguousarray(padded.reshape(n, BLOCK).T)
        for i in range(1, BLOCK):
            grid[i] = self.compose[grid[i - 1].astype(np.intp) * self.size + grid[i]]
        ahead = self.scanned(grid[-1])[:-1].astype(np.intp) * self.size
        grid[:, 1:] = self.compose[ahead[None, :] + grid[:, 1:]]
        return grid.T.reshape(-1)[: len(f)]

    def boundaries(self, texts: list[str]) -> list[list[int]]:
        """For each text the offsets at which slices begin, and its length at the end."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return [[0] for _ in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        raw = self.classes[points]
        starts = (ends - sizes)[sizes > 0]
        last = np.zeros(len(raw), bool)
        last[ends[sizes > 0] - 1] = True
        white = raw >= SPACE_LAST
        before_solid = np.zeros(len(raw), bool)
        before_solid[:-1] = ~white[1:]
        before_solid &= ~last
        symbols = raw.copy()
        symbols[white] = WHITE_IN
        symbols[before_solid & white] = WHITE_LAST
        symbols[before_solid & (points == 32)] = SPACE_LAST
        if len(at := np.flatnonzero(points == 39)):
            self.apostrophes(symbols, points, at, np.repeat(ends, sizes)[at])
        moves = symbols.copy()
        moves[starts] += 8
        states = self.state[self.scanned(self.number[moves])]
        before = np.empty_like(states)
        before[1:] = states[:-1]
        before[starts] = CLOSED
        cut = np.flatnonzero(self.cuts[before, symbols])
        first = np.searchsorted(cut, ends - sizes)
        upto = np.searchsorted(cut, ends)
        return [[*(cut[a:b] - (e - n)).tolist(), int(n)] if n else [0] for a, b, e, n in zip(first, upto, ends, sizes, strict=True)]

    def apostrophes(self, symbols: np.ndarray, points: np.ndarray, at: np.ndarray, ends: np.ndarray) -> None:
        nexts = np.where(at + 1 < ends, points[np.minimum(at + 1, len(points) - 1)], 0)
        after = np.where(at + 2 < ends, points[np.minimum(at + 2, len(points) - 1)], 0)
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        symbols[at[np.isin(nexts, [ord(c) for c in "stmd"])]] = SHORT
        symbols[at[np.logical_or.reduce([(nexts == a) & (after == b) for a, b in pairs])]] = LONG


def classes() -> np.ndarray:
    """The class of every code point, asked of the library's own regular-expression engine so that its Unicode version holds."""
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    one = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE_IN, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=one, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Codec:
    """Encodes and decodes by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], kinds: np.ndarray) -> None:
        self.ranks, self.scanner = ranks, Scanner(kinds)
        self.known: dict[str, tuple[int, ...]] = {}
        size = max(ranks.values(), default=-1) + 1
        entries = [b""] * size
        for piece, rank in ranks.items():
            entries[rank] = piece
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Joins the neighbouring pair of least rank, leftmost first, until none has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) >= HEAP_FROM:
            return self.merged_long(piece)
        parts, get = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get
        pairs = [get(a + b, 1 << 60) for a, b in itertools.pairwise(parts)]
        while pairs and (least := min(pairs)) < 1 << 60:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
        return tuple(self.ranks[p] for p in parts)

    def merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list of spans."""
        n, get = len(piece), self.ranks.get
        end, prior, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                prior[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := prior[i]) >= 0 and (r := get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        at = 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) <= SCAN_CHARS):
                held += len(texts[upto])
                upto += 1
            part = texts[at:upto]
            out += [self.slices(t, b) for t, b in zip(part, self.scanner.boundaries(part), strict=True)]
            at = upto
        return out

    def slices(self, text: str, bounds: list[int]) -> list[int]:
        ids: list[int] = []
        known, add = self.known.get, ids.extend
        for a, b in itertools.pairwise(bounds):
            piece = text[a:b]
            found = known(piece)
            if found is None:
                found = self.merged(piece.encode())
                if b - a <= CACHE_CHARS:
                    if len(self.known) >= CACHE_ENTRIES:
                        self.known.clear()
                    self.known[piece] = found
            add(found)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Gathers the bytes of all ids from the vocabulary's one byte string by its offsets."""
        numbers = np.array(ids, np.int64)
        sizes = self.lengths[numbers]
        shift = self.offsets[numbers] - (np.cumsum(sizes) - sizes)
        return self.bytes[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes()


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text: number of ids, and digests of the ids and of the bytes that they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(path), classes()))  # bounded by the vocabulary file
    key = fresh("codec")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = once(key, lambda: Codec(*shared.value))
        every = codec.encode(texts_of(batch))
        digest = lambda x: hashlib.sha256(x).hexdigest()
        columns = [
            batch.column("doc_id"),
            pa.array([len(ids) for ids in every], pa.int64()),
            pa.array([digest(",".join(map(str, ids)).encode()) for ids in every], pa.string()),
            pa.array([digest(codec.decode(ids)) for ids in every], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
