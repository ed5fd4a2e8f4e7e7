"""Encodes many unseen words in one call, by ranks made from a tokenizer file's merges.

A pair of neighbours is joined by the least rank of what it gives. That equals joining by the list of merges as
long as every entry of the vocabulary encodes to itself: a pair that gives an entry and isn't the entry's own
last pair could only stand there if the entry, alone, ended in that pair too. A test asserts this of the files.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken

#: Ends a word where the vocabulary marks word ends; words have letters only, so it can't occur in one.
END = b"\0"


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words:
    """Words of letters; each with a space before it if the vocabulary doesn't mark word ends."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        suffix, known, letters = model["end_of_word_suffix"] or "", model["vocab"], byte_letters()
        self.marked = bool(suffix)

        def raw(entry: str) -> bytes:
            ends = self.marked and entry.endswith(suffix)
            return bytes(letters[c] for c in (entry[: -len(suffix)] if ends else entry)) + END * ends

        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        single = [e for e in known if len(e.removesuffix(suffix)) == 1]
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        for entry in [*single, *merged]:
            ranks.setdefault(raw(entry), len(ranks))
        by_bytes = {raw(e): i for e, i in known.items()}
        self.ids = np.array([by_bytes.get(b, -1) for b in ranks], np.int64)
        self.edge = np.array([b.endswith(END) if self.marked else b.startswith(b" ") for b in ranks])
        self.codec = tiktoken.Encoding("words", pat_str=r"[^ ]+" if self.marked else r" ?[^ ]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids, and for each word the index behind its last; None if some word isn't a single slice."""
        line = "\0 ".join([*words, ""]) if self.marked else "".join(words)
        found = np.array(self.codec.encode_ordinary(line), np.int64)
        at = np.flatnonzero(self.edge[found]) if len(found) else np.zeros(0, np.int64)
        if len(at) != len(words) or len(found) and self.ids[found].min() < 0:
            return None
        return self.ids[found], (at + 1 if self.marked else np.append(at[1:], len(found)))
