import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import scanners as S
from textloom.functions import text as T


def value(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} {'int' if isinstance(v, int) else 'string'}" for c, v in columns.items()))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("context", "expected"),
    [("<<POS:00000012>>", 11), ("<<POS:5>> <<POS:9>>", 8), ("<<POS:0>>", 0), ("", None), ("&lt;&lt;POS:3&gt;&gt;", 2)],
)
def test_position(spark, context, expected):
    assert value(spark, T.position(F.col("c")), c=context) == expected


def test_template_context(spark):
    made = value(spark, T.template_context(F.lit(1), F.lit(9), F.col("c"), F.array(F.lit("$x"))), c="'a' + $x")
    raw = made.split("TPL:")[1].removesuffix(">>")
    assert raw == "eyJraW5kIjoibGluZS10ZW1wbGF0ZSIsInNvdXJjZSI6IidhJyArICR4IiwiZXhwcmVzc2lvbnMiOlsiJHgiXX0="
    assert json.loads(base64.urlsafe_b64decode(raw))["expressions"] == ["$x"]
    back = value(spark, T.payload(F.lit(made)), c="")
    assert back["source"] == "'a' + $x"
    assert value(spark, T.payload(F.lit("<<TPL:!!>>")), c="") is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [("<b>Hi</b>&nbsp;<<$name>>, you", "Hi , you"), ("<img src='a.png'>", ""), ("<<x>>", ""), ("a &lt;&lt;v&gt;&gt; b", "a b")],
)
def test_visible(spark, text, expected):
    assert value(spark, T.visible_text(F.col("c")), c=text) == S.visible(text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("images/pc/a.jpg", True), ('"a.png"', True), ("a.txt", False), ("look at a.jpg", True), ("http://h/a.png", False)],
)
def test_asset(spark, text, expected):
    assert value(spark, T.is_asset_path(F.col("c")), c=text) == S.is_asset(text) == expected


@pytest.mark.parametrize(("text", "expected"), [("$args[0]", True), ("my_var other_var", True), ("hello world", False), ("hi $name!", False)])
def test_code_label(spark, text, expected):
    assert value(spark, T.is_code_label(F.col("c")), c=text) == S.is_code_label(text) == expected


def test_slug(spark):
    assert value(spark, T.slug(F.col("c"), F.lit(7)), c="Hello, <b>you</b>!") == "Hello_b_you_b"
    assert value(spark, T.slug(F.col("c"), F.lit(7)), c="中文") == "pos_00000007"


def test_tags(spark):
    assert value(spark, T.tags(F.col("c")), c='<B>x</b><br/><br /><a href="x">') == ["<b>", "</b>", "<br/>", "<br>", "<a>"]


def test_signatures_differ_in_order(spark):
    a, b = F.lit("<<a>><<b>>"), F.lit("<<b>><<a>>")
    assert not value(spark, T.symbol_drift(a, b), c="")
    assert value(spark, T.string_drift(a, b), c="")


@pytest.mark.parametrize(("a", "b", "expected"), [(None, 5, 50.0), (0, 6000, 0.0), (100, 160, 99.0)])
def test_position_similarity(spark, a, b, expected):
    assert value(spark, T.position_similarity(F.lit(a).cast("int"), F.lit(b)), c="") == expected


@pytest.mark.parametrize(("key", "expected"), [("start|act|Go", "act"), ("a|b", "")])
def test_entry_type(spark, key, expected):
    assert value(spark, T.entry_type(F.col("c")), c=key) == expected


@pytest.mark.parametrize(("stage", "text", "expected"), [(-1, "t", 1), (9, "t", 9), (-1, "", -1)])
def test_migrated_stage(spark, stage, text, expected):
    assert value(spark, T.migrated_stage(F.col("s"), F.col("c")), s=stage, c=text) == expected


LINES = [
    ("# start", "HEADER"), ("if a = 1:", "IF_BLOCK"), ("if a = 1: gt 'x'", "IF_INLINE"), ("act 'Go: now':", "ACT_BLOCK"), ("else", "ELSE_BLOCK"),
    ("!! c", "COMMENT"), (":lbl", "LABEL"), ("end", "END"), ("x = 1", "GENERIC"), ("-", "FOOTER"), ("--", "GENERIC"), ("--- x ---", "FOOTER"), ("", "BLANK"),
]


@pytest.mark.parametrize(("line", "kind"), LINES)
def test_line_kind(spark, line, kind):
    assert S.kind_of(line) == kind
    assert value(spark, T.line_kind(F.col("c"), F.lit(kind.endswith("INLINE"))), c=line) == kind


scripts = st.text(alphabet="ab'\" \n!{}_+(:&,)#-", max_size=60)


@settings(max_examples=300, deadline=None)
@given(scripts)
def test_mask_keeps_length(text):
    assert len(S.masked(text)) == len(text)
    assert not set(S.masked(text)) & set("'\"")


@settings(max_examples=300, deadline=None)
@given(scripts)
def test_strings_and_code_rebuild(text):
    parts = S.code_and_strings(text)
    assert parts is None or "".join(p for _, p in parts) == text
    assert "&".join(S.commands(text)) == text


def open_quote(text):
    """By hand, one character at a time: whether a string stays open."""
    quote, i = "", 0
    while i < len(text):
        if quote and text[i] == quote:
            if text[i + 1 : i + 2] == quote:
                i += 1
            else:
                quote = ""
        elif not quote and text[i] in "'\"":
            quote = text[i]
        i += 1
    return bool(quote)


@settings(max_examples=500, deadline=None)
@given(scripts)
def test_open_string(text):
    assert (S.code_and_strings(text) is None) == open_quote(text)
