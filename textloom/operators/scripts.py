"""Extraction, syntax, lint and reference checks over DataFrames of scripts (path, text).

Scanning runs in Arrow batches and keeps the partitioning of its input; what relates rows (keys, drift, locks,
counters) is joins, windows and aggregates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from difflib import unified_diff

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scanners as S
from ..functions import text as T
from ..session import ship

# Statements with their aliases and least and most numbers of arguments.
STATEMENTS = (
    ("act", ("act",), 1, 2), ("if", ("if",), 1, 1), ("elseif", ("elseif",), 1, 1), ("else", ("else",), 0, 0), ("end", ("end",), 0, 0), ("for", ("for",), 0, 0),
    ("addobj", ("addobj", "add obj"), 1, 3), ("cla", ("cla",), 0, 0), ("closeall", ("close all",), 0, 0), ("close", ("close",), 0, 1), ("cls", ("cls",), 0, 0),
    ("cmdclear", ("cmdclear", "cmdclr"), 0, 0), ("copyarr", ("copyarr",), 2, 4), ("delact", ("delact", "del act"), 1, 1), ("delobj", ("delobj", "del obj"), 1, 1),
    ("dynamic", ("dynamic",), 1, 10), ("exec", ("exec",), 1, 1), ("exit", ("exit",), 0, 0), ("freelib", ("freelib", "dellib", "killqst"), 0, 0),
    ("gosub", ("gosub", "gs"), 1, 10), ("goto", ("goto", "gt"), 1, 10), ("inclib", ("inclib", "addlib", "addqst"), 1, 1), ("jump", ("jump",), 1, 1),
    ("killall", ("killall",), 0, 0), ("killobj", ("killobj",), 0, 1), ("killvar", ("killvar",), 0, 2), ("menu", ("menu",), 1, 3), ("msg", ("msg",), 1, 1),
    ("opengame", ("opengame",), 0, 1), ("openqst", ("openqst",), 1, 1), ("play", ("play",), 1, 2), ("refint", ("refint",), 0, 0), ("savegame", ("savegame",), 0, 1),
    ("settimer", ("settimer",), 1, 1), ("showacts", ("showacts",), 1, 1), ("showinput", ("showinput",), 1, 1), ("showobjs", ("showobjs",), 1, 1),
    ("showstat", ("showstat",), 1, 1), ("unselect", ("unselect", "unsel"), 0, 0), ("view", ("view",), 0, 1), ("wait", ("wait",), 1, 1),
    ("xgoto", ("xgoto", "xgt"), 1, 10), ("p", ("p", "*p"), 1, 1), ("pl", ("pl", "*pl"), 0, 1), ("nl", ("nl", "*nl"), 0, 1),
    ("clear", ("clear", "clr", "*clear", "*clr"), 0, 0),
)
BY_ALIAS = {alias: (name, least, most) for name, aliases, least, most in STATEMENTS for alias in aliases}
LONGEST_FIRST = sorted(BY_ALIAS, key=len, reverse=True)
ANY_NUMBER = {"clear", "p", "pl", "nl"}
NOT_LINTED = {"BLANK", "COMMENT", "LABEL", "HEADER", "FOOTER", "END"}
RULES = ("structure", "statement", "style")

ISSUES = "path string, code string, line int, severity string, message string"
ENTRIES = "path string, entry_idx int, base string, turn int, position int, range_end int, original string, expressions array<string>"


@dataclass(frozen=True)
class LintConfig:
    """What a lint configuration file can set."""

    disabled_rules: frozenset[str] = field(default_factory=frozenset)
    warning_as_error: bool = False
    max_line_length: int = 180
    style: bool = True

    @classmethod
    def of(cls, raw: object) -> LintConfig:
        """What a parsed file says, under its own names; what it leaves out keeps its default."""
        given = raw if isinstance(raw, dict) else {}
        kinds = {"warning_as_error": ("warning_as_error", bool), "max_line_length": ("max_line_length", int), "enable_project_style_passes": ("style", bool)}
        known = {field_: kind(given[name]) for name, (field_, kind) in kinds.items() if name in given}
        listed = given.get("disabled_rules", given.get("disable"))
        return cls(frozenset(filter(None, map(str.strip, map(str, listed if isinstance(listed, list) else ())))), **known)


Issue = tuple[str, int, str, str]


def map_texts(scripts: DataFrame, rows: Callable[[str, str], list[tuple]], schema: str, columns: tuple[str, ...] = ("path", "text")) -> DataFrame:
    """Rows (path, *values) of each script, in Arrow batches."""
    ship(scripts.sparkSession)
    made = scripts.select(*columns)
    kinds = scripts.sparkSession.createDataFrame([], schema).schema
    names = kinds.fieldNames()
    arrow = to_arrow_schema(kinds)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = [batch.column(c).to_pylist() for c in columns]
            out = [(path, *row) for path, *rest in zip(*inputs, strict=True) for row in rows(path or "", *[x or "" for x in rest])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(names))], names)

    return made.mapInArrow(work, schema)


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name.strip(".") else name


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def extracted(text: str) -> list[tuple]:
    """Entries of a script, with the part of the key that follows the script's name and how often it has come so far."""
    seen: Counter[str] = Counter()
    out = []
    for i, e in enumerate(S.extract(text)):
        base = f"{e.kind}|{S.slug(e.label, e.position)}"
        seen[base] += 1
        out.append((i, base, seen[base], e.position, e.end, e.original, e.expressions))
    return out


def extract_entries(scripts: DataFrame) -> DataFrame:
    """(path, entry_idx, key, original, translation, stage, context) of every script, in order of position.

    The first entry with a key keeps it; later ones get their position added. A script is scanned as a whole, so its
    entries are numbered and told apart where they are found, without a shuffle; each path has one row.
    """
    raw = map_texts(scripts, lambda _, text: extracted(text), ENTRIES)
    plain = F.format_string("<<POS:%08d>>", "position")
    context = F.when(F.col("expressions").isNull(), plain).otherwise(T.template_context(F.col("position"), F.col("range_end"), F.col("original"), F.col("expressions")))
    base = F.concat(stem_of(F.col("path")), F.lit("|"), "base")
    key = F.when(F.col("turn") > 1, F.concat(base, F.format_string("_%08d", "position"))).otherwise(base)
    return raw.select("path", "entry_idx", key.alias("key"), "original", F.lit("").alias("translation"), F.lit(0).alias("stage"), context.alias("context"))


def structure_error(kinds: list[str]) -> int | None:
    """Index of the first line that no passage can hold; the number of lines if the end comes too early.

    A stack holds open blocks; an if whose else has come is marked, as it takes neither elseif nor else again.
    """
    stack: list[str] = []
    for i, kind in enumerate(kinds):
        if not stack:
            if kind != "HEADER":
                return i
            stack.append("passage")
        elif kind == "HEADER":
            return i
        elif kind == "FOOTER":
            if len(stack) > 1:
                return i
            stack.pop()
        elif kind in ("IF_BLOCK", "ACT_BLOCK", "FOR_BLOCK"):
            stack.append(kind)
        elif kind == "ELSEIF_BLOCK" or kind == "ELSE_BLOCK":
            if stack[-1] != "IF_BLOCK":
                return i
            if kind == "ELSE_BLOCK":
                stack[-1] = "IF_ELSE"
        elif kind == "END":
            if len(stack) == 1:
                return i
            stack.pop()
    return len(kinds) if stack or not kinds else None


def ignored(lines: list[S.Logical]) -> Callable[[str, int], bool]:
    """Whether a comment has switched a code off for a line: from here on, until switched on, or for the next line of code."""
    def named(verb: str, text: str) -> set[str]:
        m = re.search(rf"qlint:{verb}\s*=\s*([A-Za-z0-9_,\- ]+)", text, re.IGNORECASE)
        return {x.strip() for x in m[1].split(",")} - {""} if m else set()

    off: set[str] = set()
    by_line: dict[int, set[str]] = {}
    once: set[str] = set()
    for line in lines:
        if line.kind == "COMMENT":
            once |= named("ignore", line.text)
            off = (off | named("disable", line.text)) - named("enable", line.text)
            by_line[line.start] = set(off)
        else:
            by_line[line.start] = off | once
            once = set()
    return lambda code, line: not ({code, "*"} & by_line.get(line, set()))


# What isn't a statement: nothing, text that is shown, markup, and assignments.
NO_STATEMENT = re.compile(r"""\Z|['"]|<<|\*nl|\*pl|(?!(?:if|elseif|act|for|set|let|local)\b)[^=]*=""", re.IGNORECASE)
LEADING_ALIAS = re.compile(rf"(?:{'|'.join(map(re.escape, LONGEST_FIRST))})(?!\S)", re.IGNORECASE)
OF_BLOCK = re.compile(r"([A-Z]+)_(?:INLINE|BLOCK)")
TAKES_EXPRESSION = {"if", "elseif", "for", "act"}


def lint_command(command: str, kind: str) -> str | None:
    """What is wrong with a command's arguments, if anything; in a line that opens a block, the block's word is the statement."""
    bare = command.strip()
    if NO_STATEMENT.match(bare):
        return None
    colon = S.code_colon(bare)
    head = bare[: len(bare) if colon < 0 else colon].strip()
    leading = OF_BLOCK.fullmatch(kind)
    if not leading and not (leading := LEADING_ALIAS.match(head)):
        return None
    alias = leading[leading.re.groups].casefold()
    name, least, most = BY_ALIAS[alias]
    if name in TAKES_EXPRESSION:
        return None if head[len(alias) :].strip() else f"{alias} without its expression"
    given = bare[len(alias) :].strip()
    n = len(S.arguments(given)) if given else 0
    return None if name in ANY_NUMBER or least <= n <= most else f"{alias} has {n} arguments, takes {least} to {most}"


Script = tuple[list[S.Logical], str, str, LintConfig]


def structure_issues(script: Script) -> Iterator[Issue]:
    marks = {kind: [x.start for x in script[0] if x.kind == kind] for kind in ("HEADER", "FOOTER")}
    if len(marks["HEADER"]) != len(marks["FOOTER"]):
        yield "ENDNOTFOUND", (marks["HEADER"] or marks["FOOTER"])[-1], "error", "headers and footers differ in number"


def statement_issues(script: Script) -> Iterator[Issue]:
    judged = ((x.start, lint_command(c, x.kind)) for x in script[0] if x.kind not in NOT_LINTED for c in S.commands(x.text))
    return (("ARGSCOUNT", line, "warning", why) for line, why in judged if why)


def style_issues(script: Script) -> Iterator[Issue]:
    lines, location, path, config = script
    if path and location and stem(path).casefold() != location.casefold():
        yield "LOCATION_NAME_DRIFT", 1, "warning", f"file {stem(path)} holds {location}"
    limit = max(40, config.max_line_length)
    for x in lines:
        if re.match(r" +\t|\t+ ", x.text):
            yield "SYNTAX", x.start, "warning", "spaces and tabs in one indent"
        width = max(map(len, x.text.splitlines()), default=0)
        if width > limit:
            yield "SYNTAX", x.start, "warning", f"line of {width}, limit {limit}"


ISSUES_BY_RULE = dict(zip(RULES, (structure_issues, statement_issues, style_issues), strict=True))


def lint(lines: list[S.Logical], location: str, path: str, config: LintConfig) -> list[Issue]:
    """Issues by the rules that are on, without those that comments switch off."""
    on = [r for r in RULES if r not in config.disabled_rules and (config.style or r != "style")]
    allowed = ignored(lines)
    found = [i for rule in on for i in ISSUES_BY_RULE[rule]((lines, location, path, config)) if allowed(i[0], i[1])]
    return [(code, line, "error", message) for code, line, _, message in found] if config.warning_as_error else found


def check_text(text: str, name: str = "", path: str = "", config: LintConfig = LintConfig()) -> list[Issue]:
    """Issues (code, line, severity, message) of a script; one without a header is taken as the body of a passage.

    Unbalanced quotes or brackets end the check, then broken block structure; lint comes last.
    """
    if not text.lstrip().startswith("#"):
        text = f"# {name or 'passage'}\n" + "\n".join(text.splitlines()).rstrip("\n") + "\n-\n"
    if broken := S.bracket_health(text):
        return [(code, line, "error", "open string" if code == "QUOTNOTFOUND" else "unbalanced bracket") for code, line in broken]
    lines = S.logical_lines(text)
    at = structure_error([x.kind for x in lines])
    if lines and at is not None:
        bad = lines[min(at, len(lines) - 1)]
        code = "ENDNOTFOUND" if at < len(lines) and bad.kind.startswith(("ELSE", "END")) else "SYNTAX"
        return [(code, bad.start if at < len(lines) else 1, "error", f"{bad.kind} out of place" if at < len(lines) else "a block or passage doesn't end")]
    header = S.HEADER.search(text)
    return lint(lines, header[1].strip() if header else name, path, config)


def syntax_issues(scripts: DataFrame, config: LintConfig = LintConfig()) -> DataFrame:
    return map_texts(scripts, lambda path, text: check_text(text, stem(path), path, config), ISSUES)


def reference_drift(source: DataFrame, translated: DataFrame, shown_visits: int = 20, shown_calls: int = 12) -> DataFrame:
    """Issues of translated scripts whose name, visits or calls differ from the source's, or that have no source."""
    snap = "path string, location string, visits array<string>, calls array<string>"

    def rows(path: str, text: str) -> list[tuple]:
        r = S.references(text, stem(path))
        return [(r.location, r.visits, [f"{c} {to}" + (f", {v}" if v else "") for c, to, v in r.calls])]

    a = map_texts(source, rows, snap).select("path", F.struct("location", "visits", "calls").alias("a"))
    b = map_texts(translated, rows, snap).select("path", F.struct("location", "visits", "calls").alias("b"))
    both = b.join(a, "path", "left")

    def drift(name: str, shown: int) -> Column:
        gone, came = F.array_except(f"a.{name}", f"b.{name}"), F.array_except(f"b.{name}", f"a.{name}")
        told = lambda label, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{label} {name}: "), F.array_join(F.slice(x, 1, shown), "; ")))
        return F.when((F.size(gone) > 0) | (F.size(came) > 0), F.concat_ws(" / ", told("missing", gone), told("added", came)))

    moved = F.when(F.col("a.location") != F.col("b.location"), F.concat(F.col("a.location"), F.lit(" became "), F.col("b.location")))
    kinds = {"SOURCE_MISSING": F.when(F.col("a").isNull(), F.lit("no source")), "LOCATION_NAME_DRIFT": moved, "VISIT_DRIFT": drift("visits", shown_visits), "REFERENCE_DRIFT": drift("calls", shown_calls)}
    found = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(1).alias("line"), F.lit("error").alias("severity"), message.alias("message")) for code, message in kinds.items()])
    return both.select("path", F.explode(F.filter(found, lambda i: i["message"].isNotNull())).alias("i")).select("path", "i.code", "i.line", "i.severity", "i.message")


def checked(source: DataFrame, translated: DataFrame, config: LintConfig = LintConfig()) -> tuple[DataFrame, DataFrame]:
    """(issues, locked paths): references first, syntax only of what passes them."""
    drift = reference_drift(source, translated)
    first = drift.filter("severity = 'error'").select("path").distinct()
    syntax = syntax_issues(translated.join(first, "path", "left_anti"), config)
    locked = first.union(syntax.filter("severity = 'error'").select("path")).distinct()
    return drift.unionByName(syntax), locked


def guard_drift(source: DataFrame, translated: DataFrame) -> DataFrame:
    """(path, reason): broken code of a translated script or, if sound, counts of structure words that changed; no source, too."""
    plan = "path string, health array<string>, code string"
    rows = lambda _, text: [([f"{what} at {line}" for what, line in S.code_health(text)], S.masked(text))]
    a = map_texts(source, rows, plan).select("path", T.structure_profile(F.col("code")).alias("a"))
    b = map_texts(translated, rows, plan).select("path", "health", T.structure_profile(F.col("code")).alias("b"))
    both = b.join(a, "path", "left")
    changed = lambda w: F.when(F.col(f"a.{w}") != F.col(f"b.{w}"), F.concat(F.lit(f"{w} "), F.col(f"a.{w}").cast("string"), F.lit(" became "), F.col(f"b.{w}").cast("string")))
    balance = lambda s: F.col(f"{s}.if") - F.col(f"{s}.end")
    uneven = F.when(balance("a") != balance("b"), F.concat(F.lit("if less end "), balance("a").cast("string"), F.lit(" became "), balance("b").cast("string")))
    counts = F.filter(F.array(*[changed(w) for w in T.STRUCTURE_WORDS], uneven), lambda x: x.isNotNull())
    reasons = F.when(F.col("a").isNull(), F.array(F.lit("no source"))).when(F.size("health") > 0, F.col("health")).otherwise(counts)
    return both.select("path", F.explode(reasons).alias("reason"))


def precheck(entries: DataFrame, symbols: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, reports): untranslatable ones go; a translation whose placeholders or tags drift is blanked."""
    judged = entries.withColumn("reason", T.filter_reason(F.col("key"), F.col("original")))
    worked = (F.col("translation") != "") | F.col("stage").isin(*T.TRANSLATED_STAGES)
    gone = judged.filter(F.col("reason").isNotNull() & worked)
    stay = judged.filter("reason is null").drop("reason")
    active = F.col("stage").isin(*T.TRANSLATED_STAGES) & (F.col("translation") != "")
    drift = active & T.symbol_drift(F.col("original"), F.col("translation")) if symbols else F.lit(False)
    marked = stay.withColumn("drift", drift)
    clean = marked.withColumn("translation", F.when(F.col("drift"), "").otherwise(F.col("translation"))).withColumn("stage", F.when(F.col("drift"), 0).otherwise(F.col("stage"))).drop("drift")
    blocked = marked.filter("drift").select("path", "key", F.lit("symbols differ").alias("reason"))
    return clean, gone.select("path", "key", "reason").unionByName(blocked)


def unified(before: DataFrame, after: DataFrame, context: int = 2) -> DataFrame:
    """(path, diff) of scripts that changed: unified diffs between two tables of (path, text)."""
    both = before.join(after.select("path", F.col("text").alias("after")), "path").filter(~F.col("text").eqNullSafe(F.col("after")))

    def rows(path: str, a: str, b: str) -> list[tuple]:
        return [("\n".join(unified_diff(a.splitlines(), b.splitlines(), "source", "translated", lineterm="", n=context)),)]

    return map_texts(both, rows, "path string, diff string", ("path", "text", "after"))
