"""Suffix order and common prefixes of a shard by induced sorting, with what doesn't fit in memory on disk.

Every suffix is larger (L) or smaller (S) than the one that follows it; an S suffix behind an L suffix is a seed. The
pieces between seeds get names in their order; the suffixes of the string of names, sorted by recursion, put the seeds
in order. From these, a queue of tuples (symbol, rank of the following suffix, place) gives the order of all L
suffixes, and from those, downwards, that of all S suffixes. The common prefix of neighbours is carried along: one
more than the least common prefix between the ranks of their followers. Tuples are taken in bulk: a range of symbols
leaves the queue at once if nothing that it induces falls into the range itself.

Order and prefixes are exact up to ``depth`` symbols; suffixes that share so many are in any order. The recursion
halves the depth, so it ends after log2(depth) levels whatever the text.

The queue keeps sorted runs and merges runs of like size; arrays of more than ``IN_MEMORY`` bytes, runs and minima
among them, are mapped from files without a name in the task's temporary folder, which vanish with the task as Spark's
own spills do; nothing else ever reads them.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Larger arrays are mapped from files.
IN_MEMORY = 1 << 25
#: Tuples that are taken from the queue at once, about.
BULK = 1 << 15
NONE = np.iinfo(np.int64).max


def spool(shape: int | tuple[int, ...], kind: type) -> np.ndarray:
    """An array in memory, or in a file without a name if it is large."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    if size <= IN_MEMORY:
        return np.empty(shape, kind)
    with tempfile.TemporaryFile() as file:  # the mapping holds the file until the array goes
        file.truncate(size)
        return np.memmap(file, kind, "r+", shape=shape)


class Minima:
    """Least common prefix over ranges of ranks: a table of powers of two that grows by appending."""

    def __init__(self, size: int) -> None:
        self.size = 0
        self.table = spool((max(1, size.bit_length()), max(1, size)), np.uint8)

    def append(self, values: np.ndarray) -> None:
        low, high = self.size, self.size + len(values)
        self.table[0, low:high] = values
        k = 1
        while (1 << k) <= high:
            start, half = max(low, (1 << k) - 1), 1 << (k - 1)
            np.minimum(self.table[k - 1, start:high], self.table[k - 1, start - half : high - half], out=self.table[k, start:high])
            k += 1
        self.size = high

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least over the ranks a + 1 to b."""
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, b], self.table[k, a + (1 << k)])


class Queue:
    """Tuples by (symbol, rank), packed in one number, with their places: sorted runs, merged when of like size."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def push(self, keys: np.ndarray, places: np.ndarray) -> None:
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        self.runs.append((keys[order], places[order]))
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            (a, pa), (b, pb) = self.runs.pop(), self.runs.pop()
            order = np.argsort(np.concatenate([a, b]), kind="stable")
            keys, places = spool(len(order), np.int64), spool(len(order), np.int32)
            keys[:], places[:] = np.concatenate([a, b])[order], np.concatenate([pa, pb])[order]
            self.runs.append((keys, places))

    def back(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Puts back the end of what was taken; it is in order."""
        if len(keys):
            self.runs.append((keys, places))

    def lowest(self) -> int:
        """The least symbol."""
        return min((int(keys[0]) >> 32 for keys, _ in self.runs), default=NONE)

    def width(self, most: int) -> int:
        """A bound of symbols below which there are about so many tuples at most."""
        return min((int(keys[most]) >> 32 for keys, _ in self.runs if len(keys) > most), default=NONE)

    def take(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Removes all tuples with a symbol below the bound, in order."""
        keys, places, rest = [], [], []
        for k, p in self.runs:
            n = len(k) if bound == NONE else int(np.searchsorted(k, bound << 32))
            if n:
                keys.append(k[:n])
                places.append(p[:n])
            if n < len(k):
                rest.append((k[n:], p[n:]))
        self.runs = rest
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        found, at = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(found, kind="stable")
        return found[order], at[order]


def kinds_and_runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next, and how often its first symbol comes in a row; the last symbol is the least."""
    change = np.flatnonzero(text[1:] != text[:-1])
    if not len(change):
        return np.ones(1, bool), np.ones(1, np.int64)
    lengths = np.diff(np.concatenate([[-1], change]))
    upcoming = np.repeat(change, lengths)
    smaller = np.append(text[upcoming + 1] > text[upcoming], True)
    return smaller, np.append(upcoming - np.arange(len(text) - 1) + 1, 1)


def names_of(text: np.ndarray, seeds: np.ndarray, depth: int) -> np.ndarray:
    """Names of the pieces from each seed up to and with the next, in their order; pieces that share ``depth`` symbols are equal."""
    pad = int(text.max()) + 1
    bits = pad.bit_length()
    step = 62 // bits
    sizes = np.minimum(np.append(np.diff(seeds), 0) + 1, depth)
    rank, open_, at = np.zeros(len(seeds), np.int64), np.arange(len(seeds)), 0
    while len(open_):
        key = np.zeros(len(open_), np.int64)
        for t in range(at, at + step):
            inside = t < sizes[open_]
            key = (key << bits) | np.where(inside, text[np.minimum(seeds[open_] + t, len(text) - 1)], pad)  # a piece that ends is the larger
        order = np.lexsort((key, rank[open_]))
        ranks, keys = rank[open_][order], key[order]
        new_rank = np.concatenate([[True], ranks[1:] != ranks[:-1]])
        new = new_rank | np.concatenate([[True], keys[1:] != keys[:-1]])
        places = np.arange(len(order))
        first = np.maximum.accumulate(np.where(new, places, 0))
        rank[open_[order]] = ranks + first - np.maximum.accumulate(np.where(new_rank, places, 0))
        several = np.zeros(len(order), bool)
        several[order] = ~new | np.append(~new[1:], False)
        at += step
        open_ = open_[several & (sizes[open_] >= at)]  # a piece that ends just here still has to differ from longer ones
    return np.unique(rank, return_inverse=True)[1]


def induce(symbols: np.ndarray, taken: np.ndarray, runs: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All seeds and taken suffixes in order, with the prefix that each shares with the one before.

    Seeds come in order, behind the taken suffixes of their symbol. A taken suffix's symbol is no less than that of
    the suffix that follows it.
    """
    total = int(np.count_nonzero(taken)) + len(seeds)
    order, common = spool(total, np.int32), Minima(total)
    seed_symbols, queue = symbols[seeds], Queue()
    ahead_of = spool(len(symbols), np.int64)  # the symbol of what each suffix induces, or none
    ahead_of[0] = NONE
    ahead_of[1:] = np.where(taken[:-1], symbols[:-1].astype(np.int64), NONE)
    last: tuple[int, bool, int, int] = (-1, False, 0, 0)  # symbol, seed, rank of the follower, place
    done = begun = 0

    def emit(places: np.ndarray, own: np.ndarray, seeded: np.ndarray, followers: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Appends suffixes; gives what they induce: symbols, ranks and places. followers: ranks, or numbers of seeds; ahead: symbols of what they induce."""
        nonlocal last, done
        if not len(places):
            return places, places, places
        before = [np.concatenate([[v], x[:-1]]) for v, x in zip(last, (own, seeded, followers, places), strict=True)]
        same = before[0] == own
        shared = np.zeros(len(places), np.uint8)
        induced = np.flatnonzero(same & ~seeded)  # what comes before in its symbol is induced too
        shared[induced] = np.minimum(common.between(before[2][induced], followers[induced]), depth - 1) + 1
        if seeded.any():
            joint = np.flatnonzero(same & seeded & before[1])
            shared[joint] = seed_common[followers[joint]]
            edge = np.flatnonzero(same & seeded & ~before[1])
            shared[edge] = np.minimum(runs[before[3][edge]], runs[places[edge]])
        common.append(shared)
        order[done : done + len(places)] = places
        last = int(own[-1]), bool(seeded[-1]), int(followers[-1]), int(places[-1])
        gives = np.flatnonzero(ahead != NONE)
        done += len(places)
        return ahead[gives], gives + (done - len(places)), places[gives] - 1

    def push(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        queue.push((found[0] << 32) | found[1], found[2].astype(np.int32))

    bulk = BULK
    while done < total:
        low = min(queue.lowest(), int(seed_symbols[begun]) if begun < len(seeds) else NONE)
        bound = min(queue.width(bulk), int(seed_symbols[begun + bulk]) if begun + bulk < len(seeds) else NONE)
        bound = max(bound, low + 1)
        keys, places = queue.take(bound)
        stop = len(seeds) if bound == NONE else int(np.searchsorted(seed_symbols, bound))
        ahead, seed_ahead = ahead_of[places], ahead_of[seeds[begun:stop]]
        least = min(int(x.min()) for x in (ahead, seed_ahead) if len(x))
        if least < bound:  # what these suffixes induce would fall among them
            bound = max(least, low + 1)
            kept = int(np.searchsorted(keys, bound << 32))
            bulk = max(1 << 6, min(bulk, 2 * (kept + 1)))
            queue.back(keys[kept:], places[kept:])
            keys, places, ahead = keys[:kept], places[:kept], ahead[:kept]
            stop = int(np.searchsorted(seed_symbols, bound))
            seed_ahead = seed_ahead[: stop - begun]
        else:
            bulk = min(BULK, 2 * bulk)
        own_seeds = seeds[begun:stop].astype(np.int64)
        numbers = np.arange(begun, stop)
        begun = stop
        if least <= low:  # the symbol repeats: one step of the repetition at a time, its seeds last
            while len(places):
                found = emit(places.astype(np.int64), np.full(len(places), low), np.zeros(len(places), bool), keys & 0xFFFFFFFF, ahead)
                again = found[0] == low
                push(tuple(x[~again] for x in found))
                keys, places = found[1][again], found[2][again]
                ahead = ahead_of[places]
            push(emit(own_seeds, np.full(len(own_seeds), low), np.ones(len(own_seeds), bool), numbers, seed_ahead))
            continue
        if not len(numbers):
            push(emit(places.astype(np.int64), keys >> 32, np.zeros(len(keys), bool), keys & 0xFFFFFFFF, ahead))
            continue
        own = np.concatenate([keys >> 32, seed_symbols[begun - len(numbers) : begun]]).astype(np.int64)
        seeded = np.concatenate([np.zeros(len(keys), bool), np.ones(len(numbers), bool)])
        merged = np.argsort(own * 2 + seeded, kind="stable")
        followers = np.concatenate([keys & 0xFFFFFFFF, numbers])
        push(emit(np.concatenate([places.astype(np.int64), own_seeds])[merged], own[merged], seeded[merged], followers[merged], np.concatenate([ahead, seed_ahead])[merged]))
    return order, common.table[0, :total]


def seeds_in_order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in their order, with the prefix that each shares with the one before."""
    names, half = names_of(text, starts, depth), -(-depth // 2)
    if half <= 1 or names.max() + 1 == len(names):
        order = np.argsort(names, kind="stable")
        shared = np.append(0, names[order][1:] == names[order][:-1]).astype(np.int64)
        half = min(half, 1) if half <= 1 else half
    else:
        order, shared = suffixes(names, half)
        shared = shared.astype(np.int64)
    common = np.full(len(starts), depth, np.int64)
    common[0] = 0
    differ = np.flatnonzero(shared < half)
    differ = differ[differ > 0]
    i, j, n = order[differ - 1].astype(np.int64), order[differ].astype(np.int64), shared[differ]
    length = starts[j + n] - starts[j]
    a, b = starts[i + n], starts[j + n]
    live = np.arange(len(differ))
    while len(live := live[(text[a[live] + 0] == text[b[live]]) & (length[live] < depth)]):
        length[live] += 1
        a[live] += 1
        b[live] += 1
    common[differ] = np.minimum(length, depth)
    return starts[order], common


def suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, and the prefix that each shares with the one before, both up to depth (255 at most).

    The last symbol has to be 0 and the only 0.
    """
    if len(text) == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    smaller, runs = kinds_and_runs(text)
    runs = np.minimum(runs, depth)
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    seeds, seed_common = seeds_in_order(text, starts, depth)
    order, common = induce(text, ~smaller, runs, seeds, seed_common, depth)
    large = ~smaller[order]
    downward = order[large][::-1].astype(np.int64)
    shared = common[large].astype(np.int64)  # a larger suffix is first of its symbol or stands right behind another larger one
    shared_down = np.append(0, shared[::-1][:-1])
    taken = smaller.copy()
    taken[-1] = False
    down, down_common = induce(int(text.max()) - text, taken, runs, downward, shared_down, depth)
    return np.append(np.int32(len(text) - 1), down[::-1]), np.concatenate([[0, 0], down_common[::-1][:-1]]).astype(np.uint8)
