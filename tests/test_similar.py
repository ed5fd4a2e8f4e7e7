import random
from itertools import combinations

from pyspark.sql.functions import col, explode, md5

from textloom.operators.match import edits
from textloom.operators.similar import by_pieces, near_pairs, pieces, stretches


def changed(rng, text, times):
    for _ in range(times):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + "q" + text[at:], text[:at] + text[at + 1 :], text[:at] + "z" + text[at + 1 :]])
    return text


def expected(rows, most):
    distinct = sorted({r for r in rows if r[1] is not None}, key=str)
    return {(a[0], *sorted((a[1], b[1])), d) for a, b in combinations(distinct, 2) if a[0] == b[0] and 0 < (d := edits(a[1], b[1])) <= most}


def test_all_pairs_within_the_edits(spark):
    rng = random.Random(7)
    base = ["".join(rng.choices("abc ", k=rng.randrange(22, 60))) for _ in range(25)]
    rows = [(rng.choice(["x", None]), changed(rng, t, n)) for t in base for n in (0, 0, 1, 2, 2, 3, 4)]
    rows += [("x", None), (None, ""), ("x", "short"), *[("y", "one template, then a number: " + str(i)) for i in range(40)]]
    rows += [("x", changed(rng, "".join(rng.choices("aé日\U0001f600", k=k)), n)) for k in range(12) for n in (0, 1, 2)] + [("z", "étude à la carte, première version, n° " + c) for c in "éèêë12ab"]
    for most, shortest, shared in ((2, 24, 256), (1, 12, 256), (3, 18, 256), (2, 24, 5)):
        found = [tuple(r) for r in near_pairs(spark.createDataFrame(rows, "block string, text string"), most, shortest, shared).collect()]
        assert len(found) == len(set(found)) and set(found) == expected(rows, most)


def test_lines_of_one_template(spark):
    """Lines that share a template meet by their own part; the comparisons grow with the lines, not with their square."""
    rng = random.Random(3)
    rows = [("t", f"one template for every line, then a number that is random: {rng.getrandbits(60):016x}") for _ in range(2000)]
    near = [("t", t[:-3] + "q" + t[-2:]) for _, t in rows[:20]]
    texts = spark.createDataFrame(rows + near, "block string, text string")
    met = by_pieces(texts.select("block", md5("text").alias("id"), "text"), 2, 256)
    assert met.count() < 100
    assert near_pairs(texts).count() == 20


def test_no_rows(spark):
    assert near_pairs(spark.createDataFrame([], "block string, text string")).isEmpty()


def test_keys_are_slim(spark):
    """A text has 18 rows of keys, so a row is two numbers: a key that holds its block, and an id."""
    texts = spark.createDataFrame([("x", "a line of more than twenty-four letters")], "block string, text string")
    keys = texts.select(explode(pieces(col("text"), 2)).alias("k"))
    assert keys.schema["k"].dataType.simpleString() == "bigint" and keys.select("k").distinct().count() == 3
    assert texts.select(explode(stretches(col("text"), 2)).alias("s")).select("s.*").dtypes == [("k", "bigint"), ("longer", "boolean")]
