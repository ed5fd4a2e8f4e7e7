"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One pass of an Aho-Corasick automaton over the lower-cased text finds keyword positions; the expensive
patterns are matched only at those positions. Hexadecimal runs have no keyword: every eighth character is
probed, and only stretches with two hexadecimal probes in a row are searched. Token formats that carry a
checksum (CRC-32 in base 62) are reported only if it holds.

Defined results: null text counts as empty; an empty text has no spans; a text of any length is scanned
whole; repeated rows give repeated results; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

# Kinds in the order of reports, keywords, patterns and least lengths.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = ("assign", "access", "hex")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CHECKED = {"github": re.compile(r"gh[opusr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
LEAST_VALUE, LEAST_ACCESS = 12, 18
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

STRIDE = 8
PROBES = re.compile(r"[0-9a-f]{2,}")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"
Span = tuple[int, int, int]


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum62(body: str) -> str:
    """The CRC-32 of a token's random part as six digits of base 62."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def hex_spans(text: str) -> list[tuple[int, int]]:
    """Runs of 16 or more; a run of 16 covers two neighbouring probes, and a stretch ends at probes that fail."""
    found = []
    for m in PROBES.finditer(text[::STRIDE]):
        low, high = m.start() * STRIDE - STRIDE + 1, m.end() * STRIDE
        found += [x.span() for x in HEX.finditer(text, max(0, low), min(len(text), high))]
    return found


def find(text: str) -> list[Span]:
    """Spans (start, index of kind, end) in order; leftmost and without overlap within each kind."""
    lower = text.lower()
    if len(lower) != len(text):  # some letter has a longer lower case; offsets must stay
        lower = text.translate(ASCII_LOWER)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton().iter(lower))
    spans, free = [], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[2]) >= LEAST_VALUE:
                    spans.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= LEAST_ACCESS:
                    spans.append((at, 1, m.end()))
        elif (m := CHECKED[kind].match(text, at)) and checksum62(m[1]) == m[2]:
            free[kind] = m.end()
            spans.append((at, KINDS.index(kind), m.end()))
    spans += [(a, 2, b) for a, b in hex_spans(text)]
    return sorted(spans)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch that any span covers replaced by the mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: counts by kind, the digest of the base spans, all spans."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch):
            spans = find(text)
            by = [sum(k == i for _, k, _ in spans) for i in range(len(KINDS))]
            base = written([s for s in spans if s[1] < len(BASE_KINDS)])
            rows.append((*by[:3], sum(by[3:]), hashlib.sha256(base.encode()).hexdigest(), written(spans)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return map_batches(docs.select("doc_id", "text"), work, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with their secrets replaced in the text and ``n_chars`` brought up to date; null texts stay null."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else redacted(t, find(t)) for t in batch.column("text").to_pylist()]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
        return pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return map_batches(docs, work, docs.schema)
