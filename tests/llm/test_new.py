import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import alignment, induced, merkle, repeats

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def plain_alignment(texts):
    """For each text the ids of both sides, its groups and its links, token by token."""
    ranks = {i: base64.b64decode(t) for t, i in (line.split() for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    ranks = {int(i): t for i, t in ranks.items()}
    a_library, b_library = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_library.encode_special_tokens = True

    def piece(i):
        p = b_library.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    out = []
    for text in texts:
        a = a_library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_library.encode(text or "")
        want = (" " + (text or "")).encode()
        if not text or b"".join(ranks[i] for i in a) != want or b"".join(map(piece, b)) != want:
            out.append(([], [], [], []))
            continue
        spans = lambda sizes: [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(len(sizes))]
        a_spans, b_spans = spans([len(ranks[i]) for i in a]), spans([len(piece(i)) for i in b])
        links = [(i, j) for i, x in enumerate(a_spans) for j, y in enumerate(b_spans) if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({y for _, y in a_spans} & {y for _, y in b_spans})
        groups, before = [], 0
        for end in ends:
            inside = lambda own, spans_: [own[k] for k, (x, y) in enumerate(spans_) if x >= before and y <= end]  # noqa: B023, E731
            groups.append((inside(a, a_spans), inside(b, b_spans)))
            before = end
        out.append((a, b, groups, links))
    return out


@pytest.fixture(scope="module")
def short(spark, rows):
    """The planted rows but for the longest, which a plain version can't do in useful time, and texts that don't survive."""
    own = [r for r in rows if len(r[1] or "") < 3000]
    more = ["▁ kept apart", "<|endoftext|> <s> </s> <unk>", "<0x41> A", "a\u0000b", "  two  spaces ", "é́ ﬁ Ａ", "\U0001f600 \U0001f468‍\U0001f469"]
    return own + [(1000 + i, t, "en", "s0", len(t), *["7"] * 11) for i, t in enumerate(more)]


def test_alignment(spark, docs, short, empty):
    frame = spark.createDataFrame(short, docs.schema).repartition(3)
    plain = plain_alignment([r[1] for r in short])
    held = Counter(p for a, b, _, links in plain for p in {(a[i], b[j]) for i, j in links})
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    want = []
    for r, (a, b, groups, links) in zip(short, plain, strict=True):
        counts = [(held[a[i], b[j]], top[a[i]]) for i, j in links]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        want.append((r[0], len(a), len(b), len(groups), len(links), sum(n == t for n, t in counts), sum(n for n, _ in counts), sha(text) if a else ""))
    for frequent in (10, alignment.FREQUENT):  # whatever tier a pair's count comes by
        got = alignment.align_counts(frame, A, P.PATTERN, B, frequent).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert alignment.align_counts(empty, A, P.PATTERN, B).count() == 0
    assert sum(not w[1] for w in want) >= 4 and any(w[5] < w[4] for w in want)


def test_vocabulary_by_ranks():
    """Every code point, alone and beside letters, digits, white space and apostrophes, encodes as by the library of A's file."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    mine = alignment.Aligner(open(A).read(), P.PATTERN, open(B, "rb").read())
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for beside in ("", "a", "1", " ", "!", "'"):
        text = "".join(c + beside for c in every)
        assert mine.a_ids[mine.a.encode_ordinary(text)].tolist() == library.encode(text, add_special_tokens=False).ids


def test_alignment_lists(spark, docs, short):
    frame = spark.createDataFrame(short, docs.schema).repartition(2)
    got = alignment.align(frame, A, P.PATTERN, B).collect()
    want = []
    for r, (a, b, groups, links) in zip(short, plain_alignment([r[1] for r in short]), strict=True):
        ends = lambda side: [sum(len(g[side]) for g in groups[: k + 1]) for k in range(len(groups))]  # noqa: B023, E731
        want.append((r[0], a, b, ends(0), ends(1), [i for i, _ in links], [j for _, j in links]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_alignment_of_long_texts(spark, docs, rows):
    """Where tokens tile the same bytes, links, groups and tokens have a fixed relation."""
    for r in alignment.align_counts(docs, A, P.PATTERN, B).filter("n_a > 1000").collect():
        assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_groups > 0


def plain_tree(leaves, fanout):
    """All levels of a tree, and the siblings of each leaf from below: (left, right) at each level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = i // fanout * fanout
            path.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
            i //= fanout
        paths.append(path)
    return levels, paths


def leaf_of(doc_id, text, lang, source, n_chars):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def test_merkle_manifest(spark, docs, rows, empty):
    def tampered(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 0

    runs = {}
    for r in rows:
        doc_id, text, lang, source, n = r[:5]
        seen = leaf_of(doc_id, text, lang, source, n + 1 if n is not None and tampered(doc_id) else n)
        runs.setdefault(lang, []).append((doc_id, leaf_of(doc_id, text, lang, source, n), seen))
    names = sorted(runs, key=lambda x: (x is not None, (x or "").encode()))
    for own in runs.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {name: plain_tree([leaf for _, leaf, _ in runs[name]], 2) for name in names}
    upper, upper_paths = plain_tree([trees[name][0][-1][0] for name in names], 2)
    want = []
    for k, name in enumerate(names):
        for (doc_id, leaf, seen), path in zip(runs[name], trees[name][1], strict=True):
            whole = [*path, *upper_paths[k]]
            back = seen
            for left, right in whole:
                back = sha(left + back + right)
            want.append((doc_id, leaf, trees[name][0][-1][0], upper[-1][0], sha("".join(a + b for a, b in whole)), back, back == upper[-1][0]))
    change = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)), F.col("n_chars") + 1
    for parts in (1, 7):
        got = merkle.verify_documents(docs.repartition(parts), *change)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert {w[-1] for w in want} == {True, False}
    assert merkle.verify_documents(empty, *change).count() == 0


@pytest.mark.parametrize(("fanout", "lift", "sizes"), [(2, 2, (1, 2, 3, 13, 64)), (3, 1, (5, 27, 28, 2)), (16, None, (300, 1, 17)), (2, 3, (200,))])
def test_trees_of_any_fanout(spark, fanout, lift, sizes):
    """Paths, roots and node records over several rounds, with runs that end anywhere."""
    random.seed(fanout)
    runs = {f"r{k}": [sha(str(random.random())) for _ in range(n)] for k, n in enumerate(sizes)}
    flat = [(run, i, leaf) for run, own in runs.items() for i, leaf in enumerate(own)]
    leaves = spark.createDataFrame(flat, "run string, i int, leaf string").repartition(5)
    trees = {run: plain_tree(own, fanout) for run, own in runs.items()}
    upper, upper_paths = plain_tree([trees[run][0][-1][0] for run in sorted(runs)], fanout)
    got = {(r.run, r.i): r for r in merkle.prove(leaves, ["i"], fanout, lift).collect()}
    assert len(got) == len(flat)
    for k, run in enumerate(sorted(runs)):
        for i, path in enumerate(trees[run][1]):
            r = got[run, i]
            assert list(zip(r.lefts, r.rights, strict=True)) == [*path, *upper_paths[k]]
            assert (r.leaf, r.subroot, r.root) == (runs[run][i], trees[run][0][-1][0], upper[-1][0])
    records = sorted(map(tuple, merkle.node_records(leaves, ["i"], fanout, lift).collect()))
    assert records == sorted((run, level, pos, d) for run, (levels, _) in trees.items() for level, own in enumerate(levels) for pos, d in enumerate(own))


@pytest.mark.parametrize(("fanout", "lift", "n"), [(2, 2, 103), (2, 1, 64), (3, 1, 100)])
def test_blocks_of_many_parts(spark, fanout, lift, n):
    """Blocks at the end of their parent's run, and peaks as high as the first round climbs, keep their own node."""
    own = [sha(str(i)) for i in range(n)]
    leaves = spark.createDataFrame([("r", i, leaf) for i, leaf in enumerate(own)], "run string, i int, leaf string").repartition(4)
    levels, paths = plain_tree(own, fanout)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.i: r for r in merkle.prove(leaves, ["i"], fanout, lift).collect()}
    records = sorted(map(tuple, merkle.node_records(leaves, ["i"], fanout, lift).collect()))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [list(zip(got[i].lefts, got[i].rights, strict=True)) for i in range(n)] == paths
    assert {(r.subroot, r.root) for r in got.values()} == {(levels[-1][0], levels[-1][0])}
    assert records == sorted(("r", level, pos, d) for level, own in enumerate(levels) for pos, d in enumerate(own))


def test_equal_rows_share_no_range(spark):
    """A third of all rows equal: they are dealt to many ranges, and each has the proof of its own place."""
    leaves = spark.range(3000).select(F.lit("x").alias("run"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("i"), F.sha2(F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id").cast("string")), 256).alias("leaf"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = merkle.indexed(leaves.repartition(4), ["i"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most = rows.groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < 3000 * 0.45 and rows.count() == 3000
    got = merkle.prove(leaves, ["i"]).select(merkle.proof_digest(F.col("lefts"), F.col("rights")).alias("p"), (merkle.folded(F.col("leaf"), F.col("lefts"), F.col("rights")) == F.col("root")).alias("ok"))
    assert got.filter("ok").count() == 3000 and got.select("p").distinct().count() > 2000


@pytest.mark.parametrize("bulk", [1, 3, 1 << 15])
def test_induced_sorting(monkeypatch, bulk):
    """Order and common prefixes up to the depth, as sorting all suffixes gives them."""
    monkeypatch.setattr(induced, "BULK", bulk)
    random.seed(bulk)
    for _ in range(300):
        text = [random.randint(1, random.choice([1, 2, 4, 9])) for _ in range(random.randint(0, 60))]
        text = [c for c in text for _ in range(random.choice([1, 1, 1, 4]))] + [0]
        depth = random.choice([1, 2, 3, 7, 100])
        order, common = induced.suffixes(np.array(text, random.choice([np.int32, np.int64])), depth)
        cut = lambda i: text[i : i + depth]  # noqa: B023, E731
        assert sorted(order) == list(range(len(text)))
        assert [cut(i) for i in order] == sorted(map(cut, range(len(text))))
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert list(common) == [0, *(shared(cut(i), cut(j)) for i, j in zip(order[:-1], order[1:], strict=True))]


def test_induced_sorting_of_prose():
    """Long common prefixes, and pieces between seeds of every length."""
    random.seed(9)
    words = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(1, 14))) for _ in range(60)]
    prose = [" ".join(random.choices(words, k=60)) for _ in range(4)]
    parts = [p[(a := random.randrange(len(p) - 150)) : a + random.randint(100, 150)] for p in random.choices(prose, k=250)]
    text = [ord(c) for c in "\1".join(parts)] + [0]
    order, common = induced.suffixes(np.array(text, np.int32), 100)
    cuts = [text[i : i + 100] for i in order]
    assert cuts == sorted(cuts) and sorted(order) == list(range(len(text)))
    shared = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert list(common) == [0, *shared] and max(shared) == 100


def test_induced_sorting_on_disk(monkeypatch):
    """With every array and run in files, the same."""
    random.seed(5)
    text = np.append(np.frombuffer("".join(random.choices("abc ", k=5000)).encode() * 3, np.uint8).astype(np.int32), 0)
    in_memory = induced.suffixes(text, 100)
    monkeypatch.setattr(induced, "IN_MEMORY", 64)
    assert isinstance(induced.spool(100, np.int64), np.memmap)
    on_disk = induced.suffixes(text, 100)
    assert all((a == b).all() for a, b in zip(in_memory, on_disk, strict=True))


def plain_repeats(rows, width):
    """Documents by doc_id, each byte covered by a string seen before; a repeated row repeats the first."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), [None] * len(rows)
    for i in order:
        data = (rows[i][1] or "").encode()
        covered = np.zeros(len(data) + 1, np.int64)
        for s in range(len(data) - width + 1):
            string = data[s : s + width]
            if string in seen:
                covered[s : s + width] = 1
            seen.add(string)
        runs = int((np.diff(np.append(0, covered)) == 1).sum())
        stays = bytes(b for b, c in zip(data, covered, strict=False) if not c)
        out[i] = (rows[i][0], len(data), int(covered.sum()), runs, sha(stays))
    return out


def passages():
    """Documents that share passages at any offset, copies, periodic texts, letters of several bytes, one very common passage."""
    random.seed(23)
    word = lambda: "".join(random.choices("abcdeé日 ", k=random.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(random.randint(15, 90)) for _ in range(12)]
    texts = [prose(random.randint(0, 40)) + random.choice(shared)[random.randint(0, 40) :] + prose(random.randint(0, 30)) for _ in range(150)]
    texts += ["ab" * 300, "x" * 700, "x" * 99, "x" * 100, "ab" * 40 + "x" * 300, None, "", shared[0], shared[0]]
    texts += [prose(5) + "the very common passage " * 8 + prose(5) for _ in range(60)]
    rows = [(i * 3 % 251, t) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[7]), (rows[9][0], shared[1])]


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats(spark, monkeypatch, hot):
    rows = passages()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    # of rows that share a doc_id, the order is that of their keys
    subs = {(r.doc_id, r.text): r.sub for r in repeats.keyed(frame)[0].withColumn("doc_id", repeats.doc_id_of("key", "sub")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, subs[r]))
    want = sorted(plain_repeats(ordered, repeats.WIDTH), key=repr)
    for parts in (1, 5):
        got = repeats.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)) if hot > 2 else repeats.remove_repeats(frame.repartition(parts), hot=hot)
        if hot == 2:  # grams with more than two stretches are split into single strings
            got = got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long"), F.size("starts").cast("long"), F.sha2("kept", 256))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(w[2] > 0 for w in want) > 60


def test_repeats_in_rounds(spark, monkeypatch):
    """Segments of long texts, many buckets and rounds of combining give the same strings."""
    rows = [*passages(), (5000, "z".join(t or "" for _, t in passages())[:9000])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    whole = sorted(map(tuple, repeats.remove_repeats(frame).collect()), key=repr)
    for name, value in (("CHUNK", 1500), ("BUCKET", 9000), ("FAN", 3)):
        monkeypatch.setattr(repeats, name, value)
    assert sorted(map(tuple, repeats.remove_repeats(frame).collect()), key=repr) == whole


def test_repeats_edges(spark, docs, rows, empty):
    got = repeats.repeat_digests(docs).collect()
    assert len(got) == len(rows) and repeats.repeat_digests(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[0].n_bytes == by[0].n_removed == 0 and by[0].kept_sha256 == sha("")
    twice = [r for r in got if r.doc_id == rows[12][0]]
    assert len(twice) == 3
