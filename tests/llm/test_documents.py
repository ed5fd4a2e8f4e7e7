import base64
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import common, components, exactdedup, fuse, language, licenses, secrets, sharding, simhash, sketch

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_spans():
    random.seed(5)
    parts = ["token", "password", "api_key", "apikey", "secret", "PASSWD", " = ", ":", '"', "'", "=", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "x", "İ", "ß", "K", "ſecret", " ", "abc123XYZ+/_", "é", "-"]
    for _ in range(20_000):
        text = "".join(random.choices(parts, k=random.randint(0, 30)))
        assert secrets.find(text) == brute_spans(text)


def test_checksum():
    body = "a1B2" * 7 + "xy"
    good = f"ghp_{body}{secrets.checksum62(body)}"
    assert [s[1] for s in secrets.find(f"x {good} y")] == [3]
    assert secrets.find(good[:-1] + ("0" if good[-1] != "0" else "1")) == []
    assert secrets.redacted(f"x {good} y", secrets.find(f"x {good} y")) == "x [SECRET] y"


def test_scan(docs, rows, empty):
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs).collect()}
    want = set()
    for r in rows:
        spans = brute_spans(r[1] or "")
        by = [sum(k == i for _, k, _ in spans) for i in range(3)]
        want.add((r[0], *by, hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()))
    assert got == want
    assert secrets.scan(empty).count() == 0 == secrets.redact(empty).count()
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.filter("text is null").count() == docs.filter("text is null").count()
    assert not any(r.n_assign + r.n_access + r.n_hex for r in secrets.scan(clean).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 50, 3000])
def test_fuse(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    built = fuse.build(keys)
    assert fuse.holds(built, keys).all()
    assert fuse.holds(built, rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.01


def normal(text):
    return (text or "").encode().translate(LOWER)


@pytest.mark.parametrize("keys", [1 << 13, 4])
def test_exact_dedup(docs, rows, empty, monkeypatch, keys):
    monkeypatch.setattr(exactdedup, "KEYS", keys)
    monkeypatch.setattr(common, "ROWS_A_PART", 2 if keys == 4 else 1 << 10)
    got = exactdedup.find_groups(docs, exactdedup.newer_half(F.col("doc_id"))).collect()
    groups = {}
    for r in rows:
        groups.setdefault(hashlib.sha256(normal(r[1])).hexdigest(), []).append(r[0])
    assert len(got) == len(rows)
    for r in got:
        own = groups[r.digest]
        assert r.group_size == len(own)
        assert r.keep_id == max((i for i in own if i is not None), default=None)
    for digest in groups:
        kept = [r for r in got if r.digest == digest and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    stay = exactdedup.keep_first(docs, exactdedup.find_groups(docs, exactdedup.newer_half(F.col("doc_id"))))
    assert stay.columns == docs.columns
    assert sorted(hashlib.sha256(normal(r.text)).hexdigest() for r in stay.collect()) == sorted(groups)
    assert exactdedup.find_groups(empty, exactdedup.newer_half(F.col("doc_id"))).count() == 0


@pytest.mark.parametrize("keys", [1 << 13, 4])
def test_later_batches_meet_a_saved_snapshot(spark, docs, rows, empty, monkeypatch, tmp_path, keys):
    """The snapshot is saved once and serves two batches; nothing of it is built again."""
    monkeypatch.setattr(exactdedup, "KEYS", keys)
    old = docs.select("doc_id", "text")
    exactdedup.save_snapshot(old, str(tmp_path / "kept"))
    held = {hashlib.sha256(normal(r[1])).hexdigest() for r in rows}
    monkeypatch.setattr(exactdedup, "build_filters", None)
    first = [(1000, "never seen"), (1001, "NEVER SEEN"), (1002, rows[12][1].upper()), (1003, None), (None, "no id either")]
    for batch in (first, [(2000, "never seen"), (2001, rows[15][1]), (2002, "x" * 200_000)]):
        got = exactdedup.screen_batch(spark.createDataFrame(batch, "doc_id long, text string"), str(tmp_path / "kept"), old).collect()
        assert len(got) == len(batch)
        for r in got:
            text = next(t for i, t in batch if i == r.doc_id)
            same = [i for i, t in batch if normal(t) == normal(text)]
            before = [x[0] for x in rows if normal(x[1]) == normal(text)]
            assert r.held == (r.digest in held) and r.group_size == len(same) + len(before)
            assert r.kept == (not before and r.doc_id == max((i for i in same if i is not None), default=None))
            assert r.keep_id == max((i for i in (before or same) if i is not None), default=None)
    assert exactdedup.screen_batch(empty, str(tmp_path / "kept"), old).count() == 0
    monkeypatch.undo()
    exactdedup.save_snapshot(empty, str(tmp_path / "nothing"))
    got = exactdedup.screen_batch(spark.createDataFrame(first, "doc_id long, text string"), str(tmp_path / "nothing"), empty).collect()
    assert sorted(r.doc_id or 0 for r in got if r.kept) == [0, 1001, 1002, 1003]


def brute_fingerprint(text, n=3):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", normal(text)) if w]
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        counts += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("cell", [48, 1])
def test_simhash(docs, rows, empty, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    got = simhash.find_components(docs).select("doc_id", simhash.written(F.col("print")), "component_id").collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components(prints, [r[0] for r in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.find_components(empty).count() == 0
    assert simhash.keep_least(docs, simhash.find_components(docs)).columns == docs.columns


@pytest.mark.parametrize("cell", [48, 2])
def test_links_of_dense_prints(spark, monkeypatch, cell):
    """Many prints within few bits, and pairs at every distance up to four, the sign bit included."""
    monkeypatch.setattr(simhash, "CELL", cell)
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in random.sample(range(64), k)) for b in base for k in range(5) for _ in range(12)} | {0, 1, 3, 7, 1 << 63, (1 << 63) + 1, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"))
    found = {r.node: r.root for r in components.components(edges).collect()}
    want = brute_components(prints, list(range(len(prints))))
    classes = {}
    for p, c in zip(signed, want, strict=True):
        classes.setdefault(c, set()).add(p)
    for own in classes.values():
        assert {found.get(p, p) for p in own} == {min(own)}


@pytest.mark.parametrize("cell", [48, 3])
def test_similar(spark, docs, empty, monkeypatch, cell):
    """All pairs of similarity 0.8 on five-word shingles, among copies, edits, a hot group and a shared passage."""
    monkeypatch.setattr(simhash, "CELL", cell)
    random.seed(9)
    words = ["".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: random.choices(words, k=n)
    passage = prose(60)
    texts = [prose(random.randint(1, 250)) for _ in range(120)] + [[*prose(100), *passage] for _ in range(30)]
    for own in [prose(300) for _ in range(12)] + [passage]:
        texts.append(own)
        for k in (0, 0, 1, 2, 4, 6):
            copy = list(own)
            for i in random.sample(range(len(copy)), k):
                copy[i] = random.choice(words)
            texts.append(copy)
    hot = prose(400)
    for _ in range(60):
        texts.append([random.choice(words) if i == random.randrange(400) else w for i, w in enumerate(hot)])
    sets = [shingles(" ".join(t)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.find_similar(table).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert simhash.find_similar(empty).count() == 0
    kept = simhash.keep_least(docs, simhash.find_similar(docs))
    assert kept.filter("doc_id is null").count() == docs.filter("doc_id is null").count() and kept.columns == docs.columns


def test_similar_in_crowded_cells(spark):
    """Texts that share 88 % of their shingles, below the bound, with planted pairs above it that no third text links."""
    random.seed(12)
    fresh = iter(range(1 << 30))
    own = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    passage = own(180)  # 176 shingles
    texts = [[*passage, *own(24)] for _ in range(600)]  # 200 shingles, 24 of them no other text's
    planted = {}
    for i, common in enumerate([2, 4, 6, 8, 10, 12] * 40):  # similarity of 178 to 188 of 222 to 212
        a, b = 2 * i, 2 * i + 1
        tail = own(24)
        texts[a], texts[b] = [*passage, *tail], [*passage, *tail[:common], *own(24 - common)]
        x, y = shingles(" ".join(texts[a])), shingles(" ".join(texts[b]))
        if len(x & y) >= 0.8 * len(x | y):
            planted[b] = a
    assert len(planted) == 240
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.find_similar(table).collect()}
    assert got == {i: planted.get(i, i) for i in range(len(texts))}


def test_similar_with_a_shared_doc_id(spark):
    """A row stays though another of its doc_id is a near copy of a smaller one."""
    random.seed(13)
    a, clean = ([str(random.random()) for _ in range(100)] for _ in range(2))
    rows = [(1, " ".join(a)), (2, " ".join(["changed", *a[1:]])), (2, " ".join(clean))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_least(table, simhash.find_similar(table)).collect())) == [rows[0], rows[2]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_language(spark, data, docs, rows, empty):
    table = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(language.training_rows(table))
    found = language.predict(table, model).join(table.select("doc_id", "lang", language.held_out().alias("held_out")), "doc_id").filter("held_out and lang is not null")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count() > 20
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for r in rows:
        if not any(map(str.isalpha, r[1] or "")):
            assert (got[r[0]].lang_pred, got[r[0]].score) == ("und", 0.0) or r[0] is None
        elif r[0] is not None:
            assert got[r[0]].lang_pred in model.langs and 0 <= got[r[0]].score <= 1
    assert language.fit(language.training_rows(empty)) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0
    assert language.keep_known(table, model).count() >= 0.98 * table.count()
    assert language.keep_known(docs, model).columns == docs.columns


FOREIGN = ["это русский текст", "日本語のテキストです", "Zażółć gęślą jaźń dzień dobry", "ελληνικό κείμενο εδώ", "kjsdhf kjhsdf qwpoeiur zmxncb", "Это довольно длинный русский текст о языке. " * 40, "qzx wvk jjq " * 100]


def test_language_rejects_foreign_and_garbled_texts(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(language.training_rows(table))
    assert all(model.nearest(FOREIGN)[2])
    assert (np.diff(model.floors[:8]) >= -0.1).all() and (model.floors[4:] > 0).all()
    short = [r.text.split(".")[0][:60] for r in table.filter("lang is not null and n_chars > 200").limit(100).collect()]
    assert sum(model.nearest(short)[2]) <= 2


def test_language_is_the_nearest_centroid(spark, data):
    """Against cosines from plain counts of trigrams, one text at a time."""
    table = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(language.training_rows(table))
    some = table.filter("n_chars < 3000").limit(40).collect()
    got = {r.doc_id: r for r in language.predict(table, model).collect()}
    for r in some:
        counts = np.zeros(language.DIMENSIONS)
        raw = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in f" {r.text.lower()} ".encode())
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            if not (a == b == 32 or b == c == 32):
                h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
                counts[((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 19] += 1
        vector = np.log1p(counts) * model.idf
        cosines = [vector @ c / np.linalg.norm(vector) for c in model.centroids]
        best = int(np.argmax(cosines))
        assert got[r.doc_id].lang_pred == model.langs[model.owner[best]] and got[r.doc_id].score == pytest.approx(cosines[best], abs=1e-5)


def test_language_learns_every_label(spark, monkeypatch):
    """Very many labels share the sample's rows, and all are learnt; a row repeated very often counts once."""
    monkeypatch.setattr(language, "MOST_ROWS", 50)
    monkeypatch.setattr(language, "LEAST_ROWS", 3)
    rows = [(i, f"text {i} of l{i % 300} " + chr(97 + i % 300 % 26) * 9, f"l{i % 300:03}") for i in range(3000)] + [(7, "again and again", "l007")] * 500
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert set(model.langs) <= {f"l{i:03}" for i in range(300)} and len(model.langs) > 280  # a label is missed only if its hashes draw none of its ten rows
    assert len(model.centroids) <= 300 * language.CENTROIDS


def test_long_texts_count_whole(monkeypatch):
    text = "abc déf ghi " * 300
    whole = language.trigram_counts([text])
    monkeypatch.setattr(language, "STRETCH", 100)
    assert (language.trigram_counts([text]) == whole).all()


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, 8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.shard_documents(empty, 8).count() == 0


def test_sharding_keeps_groups_and_balance(spark):
    random.seed(2)
    texts = [random.choice("abcdefgh") * random.randint(300, 900) for _ in range(600)]
    texts += [t for t in ("g" * 500, "h" * 700, "k" * 300) for _ in range(20)] + ["hot" * 200] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_documents(docs, 8).collect()
    sums, groups = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert max(sums.values()) - min(sums.values()) <= 0.02 * sum(sums.values()) / 8
    assert sum(len(groups[t]) == 1 for t in ("g" * 500, "h" * 700, "k" * 300)) >= 2


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch_estimates(spark, monkeypatch):
    random.seed(4)
    words = [str(i) for i in range(3000)]
    texts = [" ".join(random.choices(words, k=n)) for n in (0, 3, 5, 60, 900, 4000)]
    texts.append(texts[-1] + " " + texts[-2])
    df = sketch.with_sketch(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "s")
    rows = {r.i: r.s for r in df.collect()}
    pairs = df.alias("a").crossJoin(df.alias("b")).select("a.i", F.col("b.i").alias("j"), sketch.resemblance(F.col("a.s"), F.col("b.s")).alias("r"), sketch.containment(F.col("a.s"), F.col("b.s")).alias("c"), sketch.distinct_shingles(F.col("a.s")).alias("n"))
    for r in pairs.collect():
        a, b = shingles(texts[r.i]), shingles(texts[r.j])
        assert abs(r.r - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
        assert abs(r.c - (len(a & b) / len(a) if a else 1)) < 0.45
        assert abs(r.n - len(a)) <= 0.4 * len(a)
    parts = df.filter("i > 0").withColumn("k", F.when(F.col("i") < 3, "x").when(F.col("i") < 5, F.lit(None)).otherwise("y")).unionByName(df.filter("i = 0").withColumn("k", F.lit("z")))
    whole = {r.k: r.s for r in sketch.merged_by(parts, ["k"], "s").collect()}
    wanted = {"x": (1, 2), None: (3, 4), "y": (5, 6), "z": ()}
    assert whole == {k: sorted({h for i in of for h in rows[i]})[: sketch.K] for k, of in wanted.items()}


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_sketch(text):
    words = [xxhash.xxh64_intdigest(w, 42) for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    return sorted({chained(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else ())[: sketch.K]


def brute_likeness(a, b):
    union = sorted({*a, *b})[: sketch.K]
    return sum(h in a and h in b for h in union) / len(union) if union else 1


@pytest.mark.parametrize("size", [1 << 14, 9])
def test_edited_fingerprints(docs, rows, empty, monkeypatch, size):
    monkeypatch.setattr(sketch, "IDS_A_RANGE", size)
    got = sketch.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    order = sorted(by, reverse=True)
    following = {a: by[b] for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    same = {}
    for r in got:
        if r.doc_id is None:
            continue
        text = by[r.doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[r.doc_id][:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
        own, other, after = brute_sketch(text), brute_sketch(edited), brute_sketch(following[r.doc_id])
        assert base64.b64decode(r.fingerprint) == b"".join(h.to_bytes(8, "big", signed=True) for h in own)
        assert r.near_edited == pytest.approx(brute_likeness(own, other)) and r.near_next == pytest.approx(brute_likeness(own, after))
        assert 0 <= r.contained_in_edited <= 1 and 0 <= r.contained_in_next <= 1
        if len(own) < sketch.K and len(after) < sketch.K:
            union = len({*own, *after})
            assert r.n_shingles == len(own) and (union >= sketch.K or r.n_shingles_with_next == union)
            assert union >= sketch.K or r.contained_in_next == pytest.approx(len({*own} & {*after}) / len(own) if own else 1)
    assert sketch.edited_fingerprints(empty).count() == 0


def test_licenses(spark, docs, rows, empty):
    files = [
        ("a/LICENSE", "MIT License\nReleased under the MIT License."),
        ("a/b/x.py", "code"),
        ("a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0"),
        ("a/b/c/d/y.py", None),
        ("a/b/z.py", "// SPDX-License-Identifier: BSD-3-Clause\ncode"),
        ("top.py", "the license of a hunter"),
        ("e/COPYING", "nothing here"),
        ("e/f.py", ""),
    ]
    table = spark.createDataFrame([(p, p, t) for p, t in files], "file string, path string, text string")
    got = {r.path: (r.origin, r.license, r.from_dir) for r in licenses.scan(table).collect()}
    assert got["a/LICENSE"][:2] == ("own", "MIT") and got["a/b/x.py"] == ("inherited", "MIT", "a")
    assert got["a/b/c/LICENSE.txt"][:2] == ("own", "Apache-2.0") and got["a/b/c/d/y.py"] == ("inherited", "Apache-2.0", "a/b/c")
    assert got["a/b/z.py"][:2] == ("own", "BSD-3-Clause")
    assert got["top.py"] == got["e/f.py"] == got["e/COPYING"] == ("none", None, None)
    found = licenses.scan_documents(docs).collect()
    assert len(found) == len(rows)
    assert {r.license for r in found if r.doc_id is not None and "Released under the MIT" in (rows[r.doc_id][1] or "")} == {"MIT"}
    assert licenses.scan_documents(empty).count() == 0


GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify it under
 * the terms of the GNU General Public License as published by the Free Software
 * Foundation, either version 3 of the License, or (at your option) any later version.
 */
int main() { return 0; }"""
ISC_TEXT = """ISC-style text without its name

Copyright (c) 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER."""


def licence_text(name):
    """The longest template of a license, wrapped at 70 characters, with a copyright line before it."""
    words = max((t for n, t in licenses.TEMPLATES if n == name), key=len).split()
    return "Copyright (c) 2021 The Authors\nAll rights reserved.\n\n" + textwrap.fill(" ".join(words), 70)


NOTICES = [
    (GPL_HEADER, "GPL-3.0"),
    (ISC_TEXT, "ISC"),
    *[(licence_text(name), name) for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "Apache-2.0", "MPL-2.0", "LGPL-2.1", "AGPL-3.0", "GPL-2.0", "Unlicense")],
    *[("\n".join(f"int a{i};" for i in range(57)) + "\n" + licence_text(name) + "\n" + "more code here\n" * 60, name) for name in ("BSD-3-Clause", "Apache-2.0")],
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("MIT License", "MIT"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("the license of a hunter", None),
    ("licence-free text with license", None),
]


# Licence texts as projects carry them: numbered clauses, holders named, other wrapping than any template's.
CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY JANE DOE AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL JANE DOE OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
PROJECTS = {
    "BSD-2-Clause": CLAUSES.format(third=""),
    "BSD-3-Clause": CLAUSES.format(third="3. Neither the name of Jane Doe nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions.
THE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL JANE DOE BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and distribute this program for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND JANE DOE DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL JANE DOE BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION.""",
}


@pytest.mark.parametrize("width", [58, 76])
def test_license_texts_at_any_place(spark, width):
    """As a comment in a file of code, at every offset from 0 to 31, each licence text is found under its own name."""
    code = [f"    total{i} = combine(first[{i}], second[{i + 1}])" for i in range(70)]
    rows = []
    for name, text in PROJECTS.items():
        body = [f" * {line}" for part in text.split("\n") for line in textwrap.wrap(part, width)]
        for at in range(32):
            lines = [*code[:at], "/*", " * Copyright (c) 2019, Jane Doe", *body, " */", *code[at:]]
            rows.append((f"{name}/{at}", f"{name}/{at}.c", "\n".join(lines)))
    got = licenses.scan(spark.createDataFrame(rows, "file string, path string, text string").repartition(4)).collect()
    assert [(r.file, r.license) for r in got if r.license != r.file.split("/")[0]] == [] and len(got) == len(rows)


def test_license_notices(spark):
    """Every kind of licence line that the documents hold, and common notices beside them."""
    table = spark.createDataFrame([(str(i), f"{i}/x.py", t) for i, (t, _) in enumerate(NOTICES)], "file string, path string, text string")
    got = {NOTICES[int(r.file)][0]: r.license for r in licenses.scan(table).collect()}
    assert got == dict(NOTICES)


def plain_license(text):
    """The best (score, license) over all windows and templates, without any bound."""
    rows, idf, other = licenses.weights()
    templates = {}
    for i, name, term, share, long in rows:
        templates.setdefault((i, name, long), {})[term] = share
    lines, best, shorter = [re.findall(licenses.TERM, x) for x in text.lower().split("\n")], [], 0
    for size, step in licenses.WINDOWS:
        for start in range(0, -(-max(0, len(lines) - size) // step) * step + 1, step) if len(lines) > shorter else ():
            held = {t: licenses.damped(n) * idf.get(t, other) for t, n in Counter(t for line in lines[start : start + size] for t in line).items()}
            norm = math.sqrt(sum(w * w for w in held.values())) or 1.0
            for (_, name, long), shares in templates.items():
                score = round(sum(w * shares.get(t, 0.0) for t, w in held.items()) / norm, 6)
                if score >= licenses.THRESHOLD and (long or size < licenses.LARGE):
                    best.append((-score, name))
        shorter = size
    return min(best, default=(None, None))


def test_licenses_equal_brute_force(spark):
    """Parts of templates among frequent words and code, cut into lines anywhere: no bound loses a window."""
    random.seed(9)
    texts = []
    for _ in range(120):
        words = []
        for _ in range(random.randint(1, 5)):
            own = random.choice(licenses.TEMPLATES)[1].split()
            first = random.randrange(len(own))
            words += [*random.choices(licenses.FREQUENT, k=random.choice([0, 3, 30])), *own[first if random.random() < 0.5 else 0 :], *(f"x{random.randrange(99)}" for _ in range(random.choice([0, 1, 2, 5, 40])))]
        often = random.choice([0.0, 0.1, 0.4, 1.0])
        texts.append("".join(w + ("\n" if random.random() < often else " ") for w in words))
    table = spark.createDataFrame([(str(i), text) for i, text in enumerate(texts)], "file string, text string").repartition(4)
    got = {int(r.file): (-r.score, r.license) for r in licenses.own_licenses(table).collect()}
    want = {i: best for i, text in enumerate(texts) if (best := plain_license(text))[0] is not None}
    assert {i: name for i, (_, name) in got.items()} == {i: name for i, (_, name) in want.items()}
    assert all(abs(got[i][0] - score) < 2e-6 for i, (score, _) in want.items()) and 20 < len(want) < 120


def test_windows_need_a_mark(spark):
    """Only lines with a term that some template can't do without, and few enough others, make windows; long numbers are one term."""
    rows, idf, other = licenses.weights()
    marks = set(licenses.marks(rows, licenses.THRESHOLD))
    unmarked = Counter()
    for template, _, term, share, _ in rows:
        unmarked[template] += 0.0 if term in marks else share**2
    assert max(unmarked.values()) < licenses.THRESHOLD**2 and not marks & {"the", "of", "and", "to", "in", "is"}
    prose = "the rest of it is in the house and to be for all that this was as with an\n" * 40
    texts = [prose, prose + "MIT License\n" + prose, "1" + ".1" * 20_000]
    n = F.size(licenses.windows(F.col("text"), rows, max(idf.values()), other, licenses.THRESHOLD))
    made = {r.i: r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", n.alias("n")).collect()}
    assert made[0] == 0 and 0 < made[1] < 40 and made[2] == 0


def test_licenses_of_deep_trees(spark):
    deep = "/".join(f"d{i}" for i in range(80))
    files = [("LICENSE", "Released under the MIT License."), (f"{deep}/LICENSE", "Licensed under the ISC license"), (f"{deep}/x/y.py", "code")]
    table = spark.createDataFrame([(p, p, t) for p, t in files], "file string, path string, text string")
    got = {r.path: (r.origin, r.license, r.from_dir) for r in licenses.scan(table).collect()}
    assert got[f"{deep}/x/y.py"] == ("inherited", "ISC", deep)


def test_licenses_keep_columns_of_any_name(spark):
    """Columns named like those of the scan's own tables pass through; those of its results are replaced."""
    table = spark.createDataFrame([("f", "a/x.py", "Released under the MIT License.", 1, 2, 3, "z")], "file string, path string, text string, dir int, own_score int, near int, license string")
    assert licenses.scan(table).first().asDict() == {"file": "f", "path": "a/x.py", "dir": 1, "own_score": 2, "near": 3, "origin": "own", "license": "MIT", "score": 1.0, "from_dir": None}


def test_components_with_a_heavy_node(spark, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_PART", 10)
    edges = [(5, i) for i in range(6, 300)] + [(299, 1), (400, 401), (400, 401), (401, 399)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, *range(5, 300))}, 399: 399, 400: 399, 401: 399}


def test_sharding_whatever_the_layout(spark):
    random.seed(6)
    rows = [(i, "t" * random.randint(1, 400)) for i in range(2000)]
    rows += [rows[5]] * 40 + [(None, "none")] * 3
    results = []
    for order, parts in ((rows, 3), (rows[::-1], 5)):
        results.append(sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(spark.createDataFrame(order, "doc_id long, text string").repartition(parts), 8).collect()), key=repr))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    assert sorted(r[:3] for r in results[0] if r[0] is not None) == sorted((i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows if i is not None)
