"""Queries that compare texts and fold over tags."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scripts
from ..operators.ordering import spread
from ..operators.similar import EDITS, SHORTEST, near_pairs
from .catalog import read, registered


@registered()
def block_balance_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's tags nest: a fold over its tags with a stack, in SQL alone."""
    tags = read(spark, sf_dir, "pages").select("page_id", T.tags(F.col("html")).alias("tags"))
    fold = """aggregate(tags, named_struct('stack', cast(array() as array<string>), 'bad', 0), (s, t) -> case
      when t like '%/>' or t in ('<br>', '<hr>', '<img>', '<meta>', '<link>', '<input>') or t = '<!doctype>' then s
      when t like '</%' and try_element_at(s.stack, -1) = concat('<', substring(t, 3)) then named_struct('stack', slice(s.stack, 1, size(s.stack) - 1), 'bad', s.bad)
      when t like '</%' then named_struct('stack', s.stack, 'bad', s.bad + 1)
      else named_struct('stack', concat(s.stack, array(t)), 'bad', s.bad) end)"""
    return tags.select("page_id", F.expr(fold).alias("s")).select("page_id", F.col("s.bad").alias("unmatched"), F.size("s.stack").alias("left_open"))


def near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, a, b, edits): lines of all documents of a language that are two edits apart at most."""
    docs = spread(read(spark, sf_dir, "documents").select("lang", "text"))
    lines = docs.select(F.col("lang").alias("block"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return near_pairs(lines.select("block", F.col("line").alias("text")))


# The database counts edits in bytes: for each pair, the letters that occur in it are written by one byte each.
LETTERS = "array_to_string(list_distinct([substring(x || y, i, 1) for i in range(1, length(x || y) + 1)]), '')"
BYTES = "array_to_string([chr(i::int) for i in range(1, 128)], '')"


@registered(f"""with l as (select distinct lang, line from (select lang, unnest(string_split(text, chr(10))) as line from documents)),
  n as (select coalesce(lang, chr(0)) as lang, line, length(line) as n, length(line) // {EDITS + 1} as k from l),
  m as (select a.lang, a.line as x, b.line as y, a.n, [substring(a.line, i * a.k + 1, case when i = {EDITS} then a.n else a.k end) for i in range({EDITS + 1})] as cuts
    from (select *, unnest(range({EDITS + 1})) as more from n) a join n b on a.lang = b.lang and b.n = a.n + more and (more > 0 or a.line < b.line)),
  p as (select lang, least(x, y) as a, greatest(x, y) as b, x, y, {LETTERS} as letters from m where n < {SHORTEST} or len([c for c in cuts if contains(y, c)]) > 0),
  e as (select nullif(lang, chr(0)) as lang, a, b, levenshtein(translate(x, letters, left({BYTES}, length(letters))), translate(y, letters, left({BYTES}, length(letters)))) as edits from p)
  select lang, md5(a) as first, md5(b) as second, edits, round(1.0 - edits / greatest(length(a), length(b)), 6) as similarity from e where edits <= {EDITS}""")
def fuzzy_blocked_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit similarity of near lines; the block is the language, and pieces of lines of one length within it."""
    longest = F.greatest(F.length("a"), F.length("b"))
    return near_lines(spark, sf_dir).select(F.col("block").alias("lang"), F.md5("a").alias("first"), F.md5("b").alias("second"), F.col("edits").cast("long").alias("edits"), F.round(1.0 - F.col("edits") / longest, 6).alias("similarity"))


@registered()
def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of matching stretches of near lines, in Arrow batches."""
    pairs = near_lines(spark, sf_dir).select(F.concat_ws("|", F.coalesce("block", F.lit("")), F.md5("a"), F.md5("b")).alias("path"), "a", "b")
    return scripts.map_texts(pairs, lambda _, a, b: [(SequenceMatcher(None, a, b).ratio(),)], "path string, ratio double", ("path", "a", "b"))
