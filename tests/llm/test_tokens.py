import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from textloom.llm import bpe, packing, tokencount, words

ALPHABET = [*"ab'stlvredm  \n\t1é.!\x1c\x85\xa0 　漢²٣’ΣİßA_<|>", "<|endoftext|>", "<|startoftext|>", " word", " Word,"]


def noise(n):
    random.seed(7)
    return ["".join(random.choices(ALPHABET, k=random.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), bpe.classes())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_encode_as_library(codec, library):
    texts = noise(5000)
    found = codec.encode(texts)
    assert found == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(ids).decode() for ids in found] == texts


def test_every_code_point(codec, library):
    text = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    assert codec.encode([text])[0] == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, "=-" * 300 + "x" * 99, "é" * 500, "aaaaaaab" * 40])
def test_long_slices(codec, library, text):
    assert codec.encode([text])[0] == library.encode_ordinary(text)
    assert codec.merged_long(text.encode()) == tuple(library.encode_single_piece(text.encode())) if hasattr(library, "encode_single_piece") else True


def test_digests(spark, docs, rows, library, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.encode_digests(docs, path).collect()
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_digests(empty, path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_entries_encode_to_themselves(name):
    """What makes joining by rank equal to joining by the list of merges."""
    w = words.Words(open(P.path(name)).read())
    pieces = [b for b, r in w.codec._mergeable_ranks.items() if r >= 256]
    for piece in pieces:
        ranks = w.codec._mergeable_ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            i = int(np.argmin(pairs))
            assert pairs[i] < 1 << 60
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [piece]


def test_counts_as_library(spark, docs, rows, empty):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    texts = noise(4000)
    assert tokencount.Counts(open(path).read(), {}).of(texts) == [size(t) for t in texts]
    got = tokencount.count_tokens(docs, path, 50).collect()
    want = [(r[0], len((r[1] or "").encode()), size(r[1] or ""), size(r[1] or "") > 50) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokencount.count_tokens(empty, path).count() == 0


def test_cache_limits(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    texts = noise(300)
    whole = tokencount.Counts(open(path).read(), {}).of(texts)
    monkeypatch.setattr(tokencount, "CACHE_ENTRIES", 5)
    counts = tokencount.Counts(open(path).read(), {" word": 1})
    assert [n for t in texts for n in counts.of([t])] == whole
    assert counts.of(["", " word"]) == [0, 1]


def test_packing(spark, docs, rows, empty):
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    want = []
    for r in rows:
        own = ids(r[1])
        want += [(r[0], a, min(2048, len(own) - a), zlib.crc32(own[a : a + 2048].tobytes()), len(own)) for a in range(0, len(own), 2048)]
    assert sorted(((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got), key=repr) == sorted(want, key=repr)
    by = {}
    for p in got:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))
    assert packing.pack_documents(empty, path).count() == 0


def test_word_encoder():
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    encoder = packing.Encoder(open(path).read())
    texts = noise(4000)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.of(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.of([]) == [] and encoder.of(["", texts[0]])[0] == b""


@pytest.mark.parametrize("pieces", [[1], [256] * 3, [200, 100, 56, 156], list(range(1, 257)) * 3])
def test_cutting_stock(pieces):
    histogram = {}
    for p in pieces:
        histogram[p] = histogram.get(p, 0) + 1
    layout = packing.Layout(histogram)
    used = {}
    for kind, n in histogram.items():
        for s in layout.sequence(np.full(n, kind), np.arange(n)):
            used[int(s)] = used.get(int(s), 0) + kind
    assert max(used.values()) <= 256 and len(used) == layout.sequences
    assert layout.sequences <= 1.1 * sum(pieces) / 256 + 2
