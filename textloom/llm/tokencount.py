"""Token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

A text is cut into units, each a run of white space with the run of other characters after it. No slice of
the tokenizer's pre-tokenisation crosses from one unit into the next, and none looks behind its unit, so the
count of a text is the sum over its units. Tier one is a broadcast table of the counts of frequent units;
tier two is a cache in each worker, filled by encoding the misses of a batch.

The frequent units come from all documents: each task sends only those that make up at least ``LEAST_SHARE``
of its units (so at most 1 / LEAST_SHARE rows a task, whatever its size), and the ``TABLE_ENTRIES`` most
frequent are kept. What the table holds never changes a count.

Defined results: null text counts as empty and has no tokens; texts are counted whole; special strings inside
texts are one token each, as the library takes them by default; other input columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import ship
from .common import fresh, map_batches, once, texts_of
from .words import Words

TABLE_ENTRIES = 1 << 14
LEAST_SHARE = 1 / 4096
#: A task's counter is pruned beyond this many units.
COUNTER_ENTRIES = 1 << 17
#: Units that a worker remembers, and the longest that it does.
CACHE_ENTRIES, CACHE_CHARS = 1 << 19, 64

# The characters that Unicode calls white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


class Counts:
    """A worker's two tiers.

    An unseen unit that is a space, a word and punctuation counts as the word's and the punctuation's tokens;
    unseen words are encoded in one call, and every other unit by the library.
    """

    def __init__(self, vocabulary: str, frequent: dict[str, int]) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        self.tokenizer, self.words = Tokenizer.from_str(vocabulary), Words(vocabulary)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, special))) if special else None
        self.frequent: dict[str, int] = frequent
        self.cache: dict[str, int] = {"": 0}

    def library(self, units: list[str]) -> dict[str, int]:
        return {u: len(e.ids) for u, e in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False), strict=True)}

    def spaced_words(self, words: list[str]) -> dict[str, int]:
        found = self.words.encode(words) if words else None
        return self.library(words) if found is None else dict(zip(words, np.diff(found[1], prepend=0).tolist(), strict=True))

    def learn(self, units: set[str]) -> None:
        cache = self.cache
        plain = [u for u in units if u[:1] == " " and u[1:].isalpha()]
        cache |= self.spaced_words(plain)
        parted, words, others = [], set(), set()
        for u in units.difference(plain):
            core = u.rstrip(string.punctuation)
            if core[:1] == " " and core[1:].isalpha():
                tail = u[len(core) :]
                parted.append((u, core, tail))
                if core not in cache and core not in self.frequent:
                    words.add(core)
                if tail not in cache:
                    others.add(tail)
            else:
                others.add(u)
        if others:
            cache |= self.library(list(others))
        if words:
            cache |= self.spaced_words(list(words))
        for u, word, tail in parted:
            cache[u] = (self.frequent.get(word) or cache[word]) + cache[tail]

    def of(self, texts: list[str]) -> list[int]:
        units, extra = [], []
        for text in texts:
            parts = self.marks.split(text) if self.marks else [text]
            extra.append(len(parts) - 1)
            units.append([u for p in parts for u in UNITS.findall(p)])
        wanted = set().union(*units).difference(self.frequent, self.cache)
        if len(self.cache) + len(wanted) > CACHE_ENTRIES:
            self.cache = {"": 0}
            wanted = set().union(*units).difference(self.frequent)
        self.learn(wanted)
        first, second = self.frequent.get, self.cache.get
        out = [n + sum(first(u) or second(u, 0) for u in own) for n, own in zip(extra, units, strict=True)]
        for u in wanted:
            if len(u) > CACHE_CHARS:
                del self.cache[u]
        return out


def frequent_units(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(unit, n) of every unit that is frequent in some task; n counts those tasks only."""

    ship(docs.sparkSession)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for batch in batches:
            for text in texts_of(batch):
                units = UNITS.findall(text)
                total += len(units)
                seen.update(units)
                if len(seen) > COUNTER_ENTRIES:
                    floor = total * least_share / 16
                    seen = Counter({u: n for u, n in seen.items() if n > floor and len(u) <= CACHE_CHARS})
        kept = [(u, n) for u, n in seen.items() if n >= max(2, total * least_share) and len(u) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["unit", "n"])

    return docs.select("text").mapInArrow(work, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, entries: int = TABLE_ENTRIES) -> DataFrame:
    """A row for each document: UTF-8 bytes, tokens, and whether these exceed the limit."""
    vocabulary = Path(path).read_text()
    top = [r.unit for r in frequent_units(docs).orderBy(F.desc("n"), "unit").limit(entries).collect()]  # bounded by entries
    lengths = Counts(vocabulary, {}).library(top)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, lengths))
    key = fresh("counts")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        counts = once(key, lambda: Counts(*shared.value)).of(texts)
        columns = [
            batch.column("doc_id"),
            pa.array([len(t.encode()) for t in texts], pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([n > limit for n in counts], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
