"""Language identification by nearest centroid over normalised TF-IDF vectors of byte trigrams.

Training: a bounded sample of labelled rows, ``SAMPLE`` for each language (whole texts), fewer where that makes more than
``MOST_ROWS`` in all but not under ``LEAST_ROWS``, gives trigram document frequencies and, by spherical k-means,
``CENTROIDS`` centroids for each language; every label is learnt. Prediction: every whole text's vector is compared with all centroids by cosine; the
nearest centroid's language wins. A text is rejected if its best cosine lies below the floor of its length class,
which is half of what all but a two-hundredth of the sample reach. As few sampled texts are short, each also gives a
stretch of every short length class for the floors, and a class without samples takes the floor of the class below.

Defined results: null, empty or letterless text gives ``und`` with score 0 and counts as rejected; so does
every text if there are no labelled rows to learn from. Equal cosines take the language that sorts first.
Repeated rows give repeated results, and enter the sample once; other input columns, case variants included, are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted as held
from .common import durable, fresh, give_back, map_batches, once, texts_of

UNKNOWN = "und"
#: Labelled rows that a language's training reads about at most, dimensions, centroids for each language.
SAMPLE, DIMENSIONS, CENTROIDS, ROUNDS = 300, 1 << 13, 4, 12
#: Rows of the sample of all languages together, about, and of each where they are many; all of them are learnt.
MOST_ROWS, LEAST_ROWS = 4800, 24
#: Length classes of which every sampled text gives a stretch; a length class is the logarithm of the trigrams to base 2.
SHORT_CLASSES = range(1, 8)
#: Texts are counted in stretches of so many bytes, and so many texts at once.
STRETCH, TOGETHER = 1 << 20, 48
LENGTH_CLASSES = 24
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"

_LETTERS = re.compile(r"[^\W\d_]+")
_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m.group())) for m in _LETTERS.finditer(text))


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Hashed trigram counts, a row for each text; what isn't a letter counts as a space."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    group: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if group:
            codes = np.concatenate([c for _, c in group])
            rows = np.repeat(np.arange(len(group), dtype=np.int64), [len(c) for _, c in group])
            found = np.bincount(rows * DIMENSIONS + codes, minlength=len(group) * DIMENSIONS).reshape(len(group), DIMENSIONS)
            np.add.at(out, [i for i, _ in group], found)
            group.clear()

    held = 0
    for i, text in enumerate(texts):
        raw = f" {text.lower()} ".encode()
        for at in range(0, max(1, len(raw) - 2), STRETCH):
            b = _FOLD[np.frombuffer(raw, np.uint8, min(STRETCH + 2, len(raw) - at), at)]
            mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
            inside = ~((b[:-2] == 32) & (b[1:-1] == 32) | (b[1:-1] == 32) & (b[2:] == 32))
            mixed = mixed[inside]
            mixed ^= mixed >> np.uint32(15)
            group.append((i, ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13)).astype(np.int64)))
            held += len(b)
        if held >= STRETCH or len(group) >= TOGETHER:
            flush()
            held = 0
    flush()
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: index of the language, cosine, whether it is too far from all centroids."""
        counts = trigram_counts(texts)
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return self.owner[best], score, score < self.floors[length_class(counts)]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + counts.sum(axis=1)).astype(int), LENGTH_CLASSES - 1)


def clustered(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are the row nearest the mean and then those farthest from all before."""
    centres = [int((rows @ unit(rows.mean(axis=0, keepdims=True)).T).argmax())]
    while len(centres) < min(k, len(rows)):
        centres.append(int((rows @ rows[centres].T).max(axis=1).argmin()))
    means = rows[centres]
    for _ in range(ROUNDS):
        near = (rows @ means.T).argmax(axis=1)
        means = unit(np.stack([rows[near == i].mean(axis=0) if (near == i).any() else means[i] for i in range(len(means))]))
    return means


def stretches(text: str) -> list[str]:
    """Cuts of the text about as long as each short class, from places that depend on the text alone."""
    at = zlib.crc32(text.encode())
    return [text[(at >> c) % (len(text) - (1 << c)) :][: 1 << c] if len(text) > 1 << c else "" for c in SHORT_CLASSES]


def sparse(counts: np.ndarray) -> bytes:
    """Places and counts of what isn't zero."""
    at = np.flatnonzero(counts)
    return at.astype("<u4").tobytes() + counts[at].astype("<f4").tobytes()


def dense(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMENSIONS), np.float32)
    for own, raw in zip(out, rows, strict=True):
        half = len(raw) // 2
        own[np.frombuffer(raw, "<u4", half // 4)] = np.frombuffer(raw, "<f4", half // 4, half)
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Learns from columns doc_id, text, lang; None if there is nothing to learn from.

    Languages are counted over all rows, and all are learnt. Rows enter by a hash of doc_id and text against sample / count,
    so about ``sample`` of each language do, fewer where many languages share ``MOST_ROWS``, but not under ``LEAST_ROWS``.
    The sample and the centroids grow with the number of languages alone; texts are dense only a language at a time.
    """
    counts = durable(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    many = counts.count()
    if not many:
        return None
    each = min(sample, max(LEAST_ROWS, MOST_ROWS // many))
    part = F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")) * (1 << 20)
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 20)) < part

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        cuts = [c for t in texts for c in stretches(t)]
        k = len(SHORT_CLASSES)
        short = [sparse(c) for c in trigram_counts(cuts)]
        columns = [batch.column("lang"), pa.array([sparse(c) for c in trigram_counts(texts)], pa.binary()), pa.array([short[i * k : (i + 1) * k] for i in range(len(texts))], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "counts", "short"])

    once_each = labelled.join(held(counts), "lang").filter(drawn).dropDuplicates(["doc_id", "text", "lang"]).select("text", "lang")
    rows = map_batches(once_each, work, "lang string, counts binary, short array<binary>").collect()  # about MOST_ROWS, or LEAST_ROWS a language
    rows.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    texts_with = np.zeros(DIMENSIONS, np.int64)
    for r in rows:
        texts_with[np.frombuffer(bytes(r["counts"]), "<u4", len(r["counts"]) // 8)] += 1
    model = Model(langs, np.log((1 + len(rows)) / (1 + texts_with)).astype(np.float32) + 0.1, np.zeros(0), np.zeros(0, int), np.zeros(LENGTH_CLASSES))
    means = [clustered(model.vectors(dense([bytes(r["counts"]) for r in own])), centroids) for _, own in itertools.groupby(rows, key=lambda r: r["lang"])]
    model.centroids = np.concatenate(means).astype(np.float32)
    model.owner = np.repeat(np.arange(len(langs)), [len(m) for m in means])
    best, classes = [], []
    for at in range(0, len(rows), TOGETHER):
        some = rows[at : at + TOGETHER]
        cuts = dense([*(bytes(r["counts"]) for r in some), *(bytes(s) for r in some for s in r["short"] if s)])
        if len(cuts):
            best.append((model.vectors(cuts) @ model.centroids.T).max(axis=1))
            classes.append(length_class(cuts))
    reached, kind = np.concatenate(best), np.concatenate(classes)
    for c in range(1, LENGTH_CLASSES):
        near = reached[kind == c]
        model.floors[c] = 0.5 * np.quantile(near, 0.005) if len(near) >= 20 else model.floors[c - 1]
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    give_back()  # what fitting took of the driver's memory
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dimensions
    key = fresh("centroids")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        nearest = once(key, lambda: shared.value)
        texts = texts_of(batch)
        langs, scores, far = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if nearest is not None:
            able = [i for i, t in enumerate(texts) if has_letter(t)]
            for at in range(0, len(able), TOGETHER):
                some = able[at : at + TOGETHER]
                for i, lang, score, off in zip(some, *nearest.nearest([texts[j] for j in some]), strict=True):
                    langs[i], scores[i], far[i] = nearest.langs[lang], float(score), bool(off)
        columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    return map_batches(docs.select("doc_id", "text"), work, SCHEMA)


def held_out() -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out())


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, all columns, that are not rejected."""
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = fresh("centroids")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        nearest = once(key, lambda: shared.value)
        texts = texts_of(batch)
        kept = np.zeros(len(texts), bool)
        if nearest is not None:
            able = [i for i, t in enumerate(texts) if has_letter(t)]
            for at in range(0, len(able), TOGETHER):
                some = able[at : at + TOGETHER]
                kept[some] = ~nearest.nearest([texts[j] for j in some])[2]
        return batch.filter(pa.array(kept))

    return map_batches(docs, work, docs.schema)
