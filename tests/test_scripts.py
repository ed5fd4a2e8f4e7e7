import json
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SOURCES, old_catalog, texts  # noqa: E402
from plain_sync import merge_file  # noqa: E402

from textloom.functions import scanners as S  # noqa: E402
from textloom.operators import inject, match, ordering, scripts  # noqa: E402
from textloom.sources import files  # noqa: E402


def test_concat():
    assert S.concat_parts("'a' + f('x+y') + \"b\"") == ["'a'", "f('x+y')", '"b"']


def test_references():
    assert S.references("gt 'home', 'start'", "f").calls == [("gt", "home", "start")]
    assert S.references("gs $x", "f").calls == []
    assert S.references("if $args[0] = 'a''b'", "f").visits == ["a"]
    assert S.references("msg 'gt ''x'''\n!! gt 'y'", "f").calls == []


@pytest.mark.parametrize(
    ("kinds", "ok"),
    [("IF_BLOCK GENERIC ELSE_BLOCK GENERIC END", True), ("IF_BLOCK GENERIC", False), ("END", False), ("IF_BLOCK ELSE_BLOCK ELSEIF_BLOCK END", False)],
)
def test_structure(kinds, ok):
    assert (scripts.structure_error(["HEADER", *kinds.split(), "FOOTER"]) is None) == ok


def test_ignore_once():
    issues = scripts.check_text("# a\n!! qlint:ignore=ARGSCOUNT\n!! more\ngosub\ngosub\n-\n", "a", "a")
    assert [(i[0], i[1]) for i in issues] == [("ARGSCOUNT", 5)]


def test_lint_config():
    config = scripts.LintConfig.of({"disable": ["style"], "warning_as_error": True})
    assert config.disabled_rules == {"style"}
    assert scripts.check_text("# a\ngosub\n-\n", "a", "b", config) == [("ARGSCOUNT", 2, "error", "gosub has 0 arguments, takes 1 to 10")]
    assert scripts.LintConfig.of([1]) == scripts.LintConfig()


def test_best_match_prefers_translation():
    a, b = match.Entry("k|text|x", "Same text", "", 0, ""), match.Entry("k|text|y", " Same text", "Gleich", 1, "")
    merged, _ = merge_file([match.Entry("n|text|x", "Same text", "", 0, "")], [a, b])
    assert merged[0][0].translation == "Gleich" and merged[0][1] == "migrated"


def test_migration_of_expressions():
    old = match.Entry("a|var|x", "'Hi ' + $who", "'Hallo ' + $who", 1, "")
    new = match.Entry("a|var|x", "'Hi ' + $name", "", 0, "")
    assert match.migrated(old, new) == "'Hallo ' + $name"


def test_counts_add_up(spark):
    new = scripts.extract_entries(texts(spark, SOURCES))
    rows = match.sync(new, old_catalog(spark)).collect()
    live = [r for r in rows if r.status != "removed"]
    assert len(live) == new.count()
    assert {r.original for r in rows if r.status == "removed"} == {"This was cut from the script.", "Good bye to the old file."}
    assert {r.translation for r in live if r.status == "migrated"} == {"Geh ''raus''", "'Hallo ' + $name + ', willkommen!'", "Du siehst <b>es</b> dort."}


def test_ratios():
    assert match.common("kitten", "sitting") == 4
    assert match.ratio("abc", "abc") == 100 and match.ratio("", "") == 100
    assert match.partial_ratio("abc", "xxabcxx") == 100
    assert match.token_set_ratio("a b c", "c b a d") == 100
    assert match.edits("kitten", "sitting") == 3


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_ratio(a, b):
    return round(200 * plain_common(a, b) / (len(a) + len(b))) if a or b else 100


def plain_partial(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return 100 if not long else 0
    n = len(short)
    return max(plain_ratio(short, long[max(0, i) : min(len(long), i + n)]) for i in range(1 - n, len(long)))


def test_scores_against_plain_ones():
    random.seed(8)
    for _ in range(1500):
        a, b = ("".join(random.choices("abcdé ", k=random.randint(0, 14))) for _ in range(2))
        assert match.common(a, b) == plain_common(a, b) and match.edits(a, b) == plain_edits(a, b)
        assert match.ratio(a, b) == plain_ratio(a, b) and match.partial_ratio(a, b) == plain_partial(a, b)
        diff = 1 - plain_edits(a, b) / max(len(a), len(b), 1)
        assert match.near_enough(a, b) == (pytest.approx(diff) if diff >= match.LEAST_DIFF else 0)


def plain_score(old, new):
    """The score as defined, every part of it computed."""
    pairs = [(old.fuzzy, new.fuzzy)] + [(old.human, new.human)] * bool(old.human and new.human)
    scores = [s for a, b in pairs for s in (max(plain_ratio(a, b), plain_partial(a, b)), match.token_set_ratio(a, b))] + [0, 0]
    diff = max(0, 1 - plain_edits(*pairs[0]) / max(*map(len, pairs[0]), 1))
    total = sum(w * s for w, s in zip(match.WEIGHTS, (*scores[:4], diff * 100, 50), strict=True))
    return total if max(scores) >= match.LEAST_RATIO and diff >= match.LEAST_DIFF and total >= match.LEAST_SCORE else None


def test_fuzzy_pairs_of_a_file():
    """Old entries in order, each to the best new one left of its kind, by plain scores."""
    random.seed(10)
    words = ["".join(random.choices("abcdefg", k=random.randint(2, 6))) for _ in range(60)]
    for _ in range(15):
        olds, news = [], []
        for i in range(12):
            own = random.choices(words, k=random.randint(4, 9))
            kind = random.choice(["text", "msg"])
            olds.append(match.Entry(f"f|{kind}|{i}", " ".join(own), f"T{i}", 1, ""))
            for j in random.sample(range(len(own)), random.randint(1, 2)):
                own[j] = random.choice(words)
            news.append(match.Entry(f"n|{random.choice([kind, kind, 'msg'])}|{i}", " ".join(own), "", 0, ""))
        random.shuffle(news)
        merged, gone = merge_file(news, olds)
        open_, wanted = dict(enumerate(news)), {}
        for old in olds:
            scored = [(s, -j) for j, new in open_.items() if old.kind == new.kind and (s := plain_score(old, new)) is not None]
            if scored:
                wanted[-max(scored)[1]] = old
                del open_[-max(scored)[1]]
        if all(o.original != n.original for o in olds for n in news):
            assert [e.translation for e, _ in merged] == [wanted[j].translation if j in wanted else "" for j in range(len(news))]
            assert {o.translation for o in gone} == {o.translation for o in olds} - {o.translation for o in wanted.values()}


@pytest.mark.parametrize("position", [7, 6, 100])
def test_splice(position):
    text = "# a\nsay 'Hello' now\n-\n"
    out, applied, skipped, broken = inject.inject_file(text, [("Hello", "Hola", 1, f"<<POS:{position:08d}>>")], "a")
    assert out == text.replace("Hello", "Hola") and (applied, skipped, broken) == (1, 0, False)


def test_splice_skips_what_breaks():
    text = "# a\ngt 'Hello'\n-\n"
    assert inject.inject_file(text, [("Hello", "Hola", 1, "<<POS:00000008>>")], "a")[:2] == (text, 0)
    assert inject.inject_file("# a\nmsg 'x'\n-\n", [("x", "it's", 1, "<<POS:00000009>>")], "a")[1] == 0


def test_rebuilt():
    assert inject.rebuilt("Hi {{expr_1}}, it's", ["$x"]) == "'Hi ' + $x + ', it''s'"
    assert inject.rebuilt("Hi $x!", ["$x"]) == "'Hi ' + $x + '!'"
    assert inject.rebuilt("Hi", ["$x"]) is None and inject.rebuilt("{{expr_2}}", ["$x"]) is None


def test_scans_in_blocks(spark):
    """One key over many blocks, some of them without a value, against windows over the whole key."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.choice([None, None, rng.randrange(9)]), rng.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, v int, on boolean").repartition(4)
    block, up = F.expr("i div 7"), Window.partitionBy("k").orderBy("i")
    want = df.select(
        "i",
        F.last("v", ignorenulls=True).over(up).alias("carried"),
        F.first(F.when(F.col("on"), F.col("i")), ignorenulls=True).over(up.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
        F.sum("v").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("shift"),
    )
    begins = df.withColumn("b", 1 - F.coalesce(F.lag(F.col("on").cast("int")).over(up), F.lit(0)))
    want = want.join(begins.select("i", F.sum("b").over(up).alias("island")), "i").select("i", "carried", "next", "island", "shift")
    got = ordering.carried_forward(df, ["k"], ["i"], block, F.col("v"), "carried")
    got = ordering.next_where(got, ["k"], ["i"], block, F.col("i"), F.col("on"), "next")
    got = ordering.islands(got, ["k"], ["i"], block, F.col("on"), "island")
    got = ordering.scanned(got, ["k"], ["i"], block, F.col("v"), "shift", total=True, own=False)
    assert sorted(map(tuple, got.select("i", "carried", "next", "island", "shift").collect())) == sorted(map(tuple, want.collect()))


def test_greedy_batches(spark):
    sizes = spark.createDataFrame([("k", i, s) for i, s in enumerate([64, 64, 150, 64])], "k string, i int, cost long")
    rows = ordering.greedy_batches(sizes, ["k"], ["i"], sizes.cost, 200).orderBy("batch").collect()
    assert [r.n for r in rows] == [2, 1, 1]


def test_ordered_number(spark):
    rows = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(100)], "k string, i int")
    from pyspark.sql import functions as F

    got = ordering.ordered_number(rows, ["k"], ["i"], F.expr("i div 7"), "n").orderBy("i").collect()
    seen = {}
    for r in got:
        seen[r.k] = seen.get(r.k, 0) + 1
        assert r.n == seen[r.k]


def test_files(spark, tmp_path):
    from textloom.sources import files
    from textloom.streaming.validate import watch_scripts

    root = tmp_path / "src"
    (root / "sub dir").mkdir(parents=True)
    (root / "sub dir" / "home.qsrc").write_text(SOURCES["home.qsrc"].replace("\n", "\r\n"), newline="")
    (root / "a.txt").write_text("x")
    read = files.scripts(spark, str(root))
    assert [(r.path, r.text) for r in read.collect()] == [("sub dir/home.qsrc", SOURCES["home.qsrc"])]
    assert files.scripts(spark, str(tmp_path / "none")).count() == 0
    merged = match.sync(scripts.extract_entries(read), old_catalog(spark))
    report = files.write_sync(merged, str(tmp_path / "out"))
    assert report["stats"]["files_total"] == 1 and report["removed_files"] == ["gone.qsrc", "home.qsrc"]
    (tmp_path / "out" / "bad.json").write_text("[{")
    found, broken = files.entries(spark, str(tmp_path / "out"))
    assert {r.path for r in broken.collect()} >= {"bad"}
    old = files.old_entries(spark, str(tmp_path / "out"))
    assert old.filter("archived").count() == 5
    with pytest.raises(ValueError):
        files.put(str(root), "../x", "")
    (root / ".qsrclintrc").write_text(json.dumps({"max_line_length": 50}))
    assert files.lint_config(str(root / "sub dir")).max_line_length == 50
    query = watch_scripts(spark, str(root), str(tmp_path / "issues"), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert query.exception() is None and spark.read.parquet(str(tmp_path / "issues")).filter("severity = 'error'").count() == 0


def test_commands(spark, tmp_path, capsys):
    from textloom.__main__ import main

    src = tmp_path / "src"
    src.mkdir()
    for name, text in SOURCES.items():
        (src / name).write_text(text)
    run = lambda *a: (main(list(a)), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    code, out = run("extract", "--source", str(src), "--output", str(tmp_path / "entries"))
    assert code == 0 and out["entries"] == 8
    path = tmp_path / "entries" / "street.qsrc.json"
    rows = json.loads(path.read_text())
    rows[0] |= {"translation": "Die Straße ist lang.", "stage": 1}
    path.write_text(json.dumps(rows))
    assert run("sync", "--source", str(src), "--old", str(tmp_path / "entries"), "--output", str(tmp_path / "synced"))[1]["migrated_entries"] == 1
    assert run("precheck", "--entries", str(tmp_path / "entries"), "--output", str(tmp_path / "clean"))[1] == {"entries": 8, "kept": 8, "reported": 0, "broken_files": 0}
    out = run("inject", "--source", str(src), "--entries", str(tmp_path / "clean"), "--output", str(tmp_path / "done"))[1]
    assert out["applied"] == 1
    assert "Die Straße ist lang." in (tmp_path / "done" / "street.qsrc").read_text()
    assert (tmp_path / "done" / "home.qsrc").read_text() == SOURCES["home.qsrc"]
    code, out = run("check", "--source", str(src), "--translated", str(tmp_path / "done"))
    assert code == 1 and out["locked"] == 1 and out["issues"]["SYNTAX"] >= 1
    out = run("overlay", "--source", str(src), "--translated", str(tmp_path / "done"), "--output", str(tmp_path / "build"))[1]
    assert out == {"files": 4, "overlaid": 3}


def test_skips_tell_their_cause(spark):
    text = "# a\nmsg 'Hello'\n*pl 'Bye <<$x>>'\n-\n"
    payload = "<<POS:{}>> <<RANGE_END:{}>> <<TPL:{}>>"
    rows = [
        ("a.qsrc", 0, "k0", "Hello", "Hola", 1, "<<POS:00000010>>"),
        ("a.qsrc", 1, "k1", "Hello", "Hola", 1, ""),
        ("a.qsrc", 2, "k2", "Nowhere", "x", 1, "<<POS:00000010>>"),
        ("a.qsrc", 3, "k3", "Hello", "x", 0, "<<POS:00000010>>"),
        ("a.qsrc", 4, "k4", "Bye <<$x>>", "Adios", 1, "<<POS:00000022>>"),
        ("a.qsrc", 5, "k5", "Hola", "it's", 1, "<<POS:00000010>>"),
        ("a.qsrc", 6, "k6", "Hello", "x", 1, payload.format("00000010", "00000005", "eyJzb3VyY2UiOiAieCJ9")),
        ("none.qsrc", 0, "k7", "Hello", "x", 1, "<<POS:00000010>>"),
    ]
    entries = spark.createDataFrame(rows, "path string, entry_idx int, key string, original string, translation string, stage int, context string")
    done = inject.inject(spark.createDataFrame([("a.qsrc", text)], "path string, text string"), entries)
    told = {(r["key"], r["severity"], r["code"]) for r in inject.issues_of(done).collect()}
    assert told == {
        ("k1", "error", "NO_POSITION"),
        ("k2", "error", "NOT_FOUND"),
        ("k4", "warning", "SYMBOLS_DIFFER"),
        ("k5", "error", "BROKEN_LINES"),
        ("k6", "error", "INCOMPLETE_CONTEXT"),
        (None, "error", "SOURCE_MISSING"),
    }
    assert {r["path"]: r["applied"] for r in done.collect()} == {"a.qsrc": 2, "none.qsrc": 0}


def test_archive_of_issues(spark, tmp_path):
    rows = [("a/b.qsrc", 7, "SYNTAX", "error", "second"), ("a/b.qsrc", None, "SYNTAX", "warning", "first"), ("/else/where.qsrc", 1, "X", "error", "--- old"), ("../up.qsrc", 1, "X", "error", "m"), (None, 1, "X", "error", "m"), ("", 2, "X", "error", "m")]
    files.write_issues(spark.createDataFrame(rows, "path string, line int, code string, severity string, message string"), str(tmp_path), "check")
    found = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.diff")}
    assert found == {
        "check/a/b.qsrc.diff": "# warning SYNTAX\n#   first\n# error SYNTAX line 7\n#   second",
        "check/_external/where.qsrc.diff": "# error X line 1\n--- old",
        "check/_external/up.qsrc.diff": "# error X line 1\n#   m",
        "check/_misc/unknown.diff": "# error X line 1\n#   m\n# error X line 2\n#   m",
    }


class Unsplit(str):
    """A text that nobody may cut into all its lines."""

    def split(self, *args, **kwargs):
        raise AssertionError("all lines of a file were cut for one entry")


def test_lines_around_an_entry():
    text = Unsplit("a\nbc\nd\n\nef\ng")
    assert [inject.lines_around(text, *x) for x in ((2, 3, 0), (2, 3, 1), (8, 8, 1), (7, 9, 0), (-1, 30, 1))] == ["bc", "a\nbc\nd", "\nef", "\nef", str(text)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_scripts_are_extracted_and_injected_in_streams(spark):
    """An extraction has no shuffle; an injection has one for each side's rows and no frame for each file."""
    found = scripts.extract_entries(texts(spark, SOURCES))
    assert "Exchange" not in plan_of(found)
    assert "CoGroup" not in plan_of(inject.inject(texts(spark, SOURCES), found))


def test_injection_of_files_one_after_the_other(spark):
    """Files without entries, without a script, with an empty one, and without a path."""
    source = spark.createDataFrame([("a", "# a\n'one'\n-\n"), ("b", None), ("c", "# c\n-\n"), (None, "# d\n'two'\n-\n")], "path string, text string")
    entry = lambda path, i, original, position: (path, i, f"k{i}", original, "neu", 1, f"<<POS:{position:08d}>>")
    entries = spark.createDataFrame([entry("a", None, "none", 1), entry("a", 0, "one", 6), entry("b", 0, "x", 1), entry("e", 0, "x", 1), entry(None, 0, "two", 6)], "path string, entry_idx int, key string, original string, translation string, stage int, context string")
    got = {r.path: (r.text, r.applied, r.skipped, r.missing_source, [i.code for i in r.issues]) for r in inject.inject(source, entries).collect()}
    assert got == {"a": ("# a\n'neu'\n-\n", 1, 1, False, ["NOT_FOUND"]), "b": ("", 0, 1, False, ["NOT_FOUND"]), "e": ("", 0, 1, True, ["SOURCE_MISSING"]), None: ("# d\n'neu'\n-\n", 1, 0, False, [])}
