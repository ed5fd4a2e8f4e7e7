"""Static binary fuse filters with 8-bit fingerprints, built and asked with numpy.

A filter of n keys takes about 9 n bits, never misses a key that it holds, and lets about one in 256 others
pass. Keys are unsigned 64-bit numbers that are already well mixed, such as digests.
"""

from __future__ import annotations

import struct

import numpy as np

ARITY = 3


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The finaliser of splitmix64 over keys and a seed."""
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shape(n: int) -> tuple[int, int]:
    """Length of a segment, a power of two, and number of segments at which a key may start."""
    length = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, -(-int(n * factor) // length) - (ARITY - 1))


def places(keys: np.ndarray, seed: int, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells in neighbouring segments, and the fingerprint, of each key."""
    h = mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(starts) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(length - 1)
    inside = [(h & mask), (h >> np.uint64(18)) & mask, mix(h, 1) & mask]
    cells = np.stack([(first + i) * length + inside[i].astype(np.int64) for i in range(ARITY)])
    return cells, (mix(h, 2) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of distinct keys; peels cells that a single key holds, and tries another seed if some remain."""
    keys = np.unique(keys.astype(np.uint64))
    n, (length, starts) = len(keys), shape(len(keys))
    size = (starts + ARITY - 1) * length
    for seed in range(1, 200):
        cells, prints = places(keys, seed, length, starts)
        degree = np.bincount(cells.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # the xor of the numbers of all keys in a cell: at degree 1, the key
        for row in cells:
            np.bitwise_xor.at(held, row, np.arange(n))
        rounds, left = [], n
        alone = np.flatnonzero(degree == 1)
        while len(alone):
            own, at = np.unique(held[alone], return_index=True)  # a key that is alone in two cells is taken once
            rounds.append((own, alone[at]))
            left -= len(own)
            touched = cells[:, own].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(own, ARITY))
            touched = np.unique(touched)
            alone = touched[degree[touched] == 1]
        if not left:
            table = np.zeros(size, np.uint8)
            for own, at in reversed(rounds):
                table[at] = 0
                table[at] = prints[own] ^ table[cells[0, own]] ^ table[cells[1, own]] ^ table[cells[2, own]]
            return struct.pack("<III", seed, length, starts) + table.tobytes()
        length, starts = (length, starts + 1 + starts // 16) if seed % 8 == 0 else (length, starts)
        size = (starts + ARITY - 1) * length
    raise RuntimeError(f"no binary fuse filter for {n} keys")


def holds(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    seed, length, starts = struct.unpack_from("<III", filter_)
    table = np.frombuffer(filter_, np.uint8, offset=12)
    cells, prints = places(keys.astype(np.uint64), seed, length, starts)
    return (table[cells[0]] ^ table[cells[1]] ^ table[cells[2]]) == prints
