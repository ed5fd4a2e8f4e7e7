"""Column functions on entry texts, keys and contexts; all built-in expressions, so they stay in generated code.

White space and letters follow Unicode where the flag (?U) says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, kinds, stages and thresholds that results depend on.
PLACEHOLDER = r"<<[^>]+>>|&lt;&lt;.*?&gt;&gt;"
ENTITY = r"&(?:[A-Za-z]+|#[0-9]+);"
TAG = r"<[^>]+>"
MEDIA_TAG = r"(?i)<\s*/?\s*(?:img|video|audio|source)\b[^>]*>"
ASSET_PATH = r"(?i)^[A-Za-z0-9_./\\() \-]+\.(?:jpg|jpeg|png|gif|webp|bmp|svg|mp4|webm|avi|mov|mkv)$"
CODE_TOKEN = r"^[$A-Za-z_][A-Za-z0-9_$\[\]'.:\-]*$"
LEGACY_INLINE_ACT = r"(?i)':\s*(?:minut\s*\+=|gt\b|gs\b|msg\b|kla\b|cla\b|killvar\b|\*)"
TAG_PARTS = r"<\s*(/)?\s*([A-Za-z0-9]+)(?:\s+[^>]*)?\s*(/?)>"
ENTRY_TYPES = ("act", "text", "var", "msg")
STRUCTURE_WORDS = ("if", "elseif", "else", "end", "act", "loop", "while")
TRANSLATED_STAGES = (1, 3, 5)
HIDDEN_STAGE = -1
OBSOLETE_MARK = "[OBSOLETE]"
SLUG_LENGTH = 72

PAYLOAD = "struct<kind:string,source:string,expressions:array<string>>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def visible_text(c: Column) -> Column:
    """What a reader sees: placeholders, entities and tags, in this order, become spaces, and spaces fold."""
    for pattern in (PLACEHOLDER, ENTITY, TAG, r"(?U)\s+"):
        c = F.regexp_replace(c, pattern, " ")
    return strip(c)


def is_asset_path(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(c), '^"+|"+$', ""), "^'+|'+$", "")
    return bare.rlike(ASSET_PATH)


def is_media_only(c: Column, visible: Column | None = None) -> Column:
    """visible: the visible text of the same column, if there is one."""

    def nothing(seen: Column) -> Column:
        return (seen == "") | is_asset_path(seen) | is_asset_path(F.replace(seen, F.lit(" "), F.lit("")))

    media = c.rlike(MEDIA_TAG) | F.contains(F.lower(c), F.lit("src="))
    seen = visible_text(c) if visible is None else visible
    return media & F.transform(F.array(seen), nothing)[0]  # the array of one binds the visible text to a name, so it is made once


def is_code_label(visible: Column) -> Column:
    tokens = F.filter(F.split(visible, r"(?U)\s+"), lambda t: t != "")
    marked = visible.rlike(r"[$_\[\]]")
    return marked & (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(CODE_TOKEN))


def keeps_literal(content: Column) -> Column:
    """Whether a literal is worth an entry."""
    bare = strip(content)
    seen = visible_text(bare)
    trivial = (bare == "") | bare.isin("'", '"') | bare.startswith("<<POS:")
    return ~trivial & ~is_asset_path(bare) & ~is_media_only(bare) & (seen != "") & ~is_code_label(seen)


def keeps_entry(key: Column, original: Column) -> Column:
    bare = strip(original)
    legacy = F.contains(key, F.lit("|act|")) & bare.rlike(LEGACY_INLINE_ACT)
    return keeps_literal(bare) & ~legacy


def filter_reason(key: Column, original: Column) -> Column:
    """Why the pre-check drops an entry; null if it stays."""
    bare = strip(original)
    return (
        F.when(bare == "", F.lit(None))
        .when(keeps_entry(key, bare), F.lit(None))
        .when(is_asset_path(bare), F.lit("asset path"))
        .when(is_media_only(bare), F.lit("media markup"))
        .when(visible_text(bare) == "", F.lit("no visible text"))
        .otherwise(F.lit("not translatable"))
    )


def slug(content: Column, position: Column) -> Column:
    folded = F.regexp_replace(F.regexp_replace(content, r"[\r\n]|&lt;|&gt;", " "), "[^A-Za-z0-9]+", "_")
    bare = F.regexp_replace(folded, "^_+|_+$", "")
    return F.when(bare == "", F.format_string("pos_%08d", position)).otherwise(F.substring(bare, 1, SLUG_LENGTH))


def normalized(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\r\n"), F.lit("\n")))


def entry_type(key: Column) -> Column:
    """The first part of the key that is a known type; empty if none is."""
    known = F.filter(F.split(key, "[|]"), lambda p: p.isin(*ENTRY_TYPES))
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit(""))


def _last_number(context: Column, tag: str) -> Column:
    found = F.regexp_extract_all(context, F.lit(rf"(?:<<|&lt;&lt;){tag}:([0-9]+)(?:>>|&gt;&gt;)"))
    return F.greatest(F.try_element_at(found, F.lit(-1)).cast("int") - 1, F.lit(0))


def position(context: Column) -> Column:
    """The last position tag less one, not below zero; null without a tag."""
    return F.when(_has(context, "POS"), _last_number(context, "POS"))


def range_end(context: Column) -> Column:
    return F.when(_has(context, "RANGE_END"), _last_number(context, "RANGE_END"))


def _has(context: Column, tag: str) -> Column:
    return context.rlike(rf"(?:<<|&lt;&lt;){tag}:[0-9]+(?:>>|&gt;&gt;)")


def payload(context: Column) -> Column:
    """The last template tag, base 64 for URLs over JSON; null if missing or broken."""
    found = F.try_element_at(F.regexp_extract_all(context, F.lit(r"(?:<<|&lt;&lt;)TPL:([A-Za-z0-9_\-=]+)(?:>>|&gt;&gt;)")), F.lit(-1))
    raw = F.try_to_binary(F.translate(found, "-_", "+/"), F.lit("base64"))
    return F.from_json(raw.cast("string"), PAYLOAD)


def template_context(start: Column, end: Column, source: Column, expressions: Column) -> Column:
    body = F.to_json(F.struct(F.lit("line-template").alias("kind"), source.alias("source"), expressions.alias("expressions")))
    coded = F.translate(F.base64(F.encode(body, "utf-8")), "+/\r\n", "-_")  # base64 breaks lines
    return F.concat(F.format_string("<<POS:%08d>><<RANGE_END:%08d>>", start, end), F.lit("<<TPL:"), coded, F.lit(">>"))


def migrated_stage(stage: Column, translation: Column) -> Column:
    return F.when((stage == HIDDEN_STAGE) & (translation != ""), F.lit(1)).otherwise(stage)


def is_translated(stage: Column, original: Column, translation: Column) -> Column:
    return stage.isin(*TRANSLATED_STAGES) & (original != "") & (translation != "")


def obsolete_context(context: Column, reason: str) -> Column:
    bare, mark = strip(context), f"{OBSOLETE_MARK} {reason}"
    return F.when(bare == "", F.lit(mark)).otherwise(F.concat(bare, F.lit(f"\n{mark}")))


def placeholders(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"))


def tags(c: Column) -> Column:
    """Tags in order, without attributes: opening, closing, or closed in themselves."""
    found = F.regexp_extract_all(F.regexp_replace(c, PLACEHOLDER, ""), F.lit(f"({TAG_PARTS})"))

    def name(t: Column) -> Column:
        word = F.lower(F.regexp_extract(t, TAG_PARTS, 2))
        return (
            F.when(F.regexp_extract(t, TAG_PARTS, 3) == "/", F.concat(F.lit("<"), word, F.lit("/>")))
            .when(F.regexp_extract(t, TAG_PARTS, 1) == "/", F.concat(F.lit("</"), word, F.lit(">")))
            .otherwise(F.concat(F.lit("<"), word, F.lit(">")))
        )

    return F.transform(found, name)


def multiset(items: Column) -> Column:
    """Sorted ``item*count`` of an array. The array of one binds the sorted items to a name, so they are made once."""

    def counted(found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda t: F.concat(t, F.lit("*"), F.size(F.filter(found, lambda x: x == t)).cast("string")))

    return F.transform(F.array(F.sort_array(items)), counted)[0]


def symbol_drift(original: Column, translation: Column) -> Column:
    """Whether placeholders or tags differ in number; the order is free."""
    return (multiset(placeholders(original)) != multiset(placeholders(translation))) | (multiset(tags(original)) != multiset(tags(translation)))


def string_drift(original: Column, translation: Column) -> Column:
    """Whether placeholders or tags differ in number or order."""
    return (placeholders(original) != placeholders(translation)) | (tags(original) != tags(translation))


def position_similarity(a: Column, b: Column) -> Column:
    distance = F.abs(a - b)
    return F.when(distance.isNull(), 50.0).when(distance >= 6000, 0.0).otherwise(100.0 - distance / 60.0)


def structure_profile(masked: Column) -> Column:
    """Counts of the structure words in masked code, all from one pass over it."""

    def counted(hits: Column, word: str) -> Column:
        return F.size(F.filter(hits, lambda w: w == word))

    found = F.transform(F.regexp_extract_all(masked, F.lit(rf"(?i)\b({'|'.join(STRUCTURE_WORDS)})\b")), lambda w: F.lower(w))
    return F.transform(F.array(found), lambda hits: F.struct(*[counted(hits, word).alias(word) for word in STRUCTURE_WORDS]))[0]


def line_kind(text: Column, inline: Column) -> Column:
    """The kind of a logical line; inline: whether code stands behind its colon."""
    block = lambda word: F.concat(F.lit(word), F.when(inline, F.lit("_INLINE")).otherwise(F.lit("_BLOCK")))
    return (
        F.when(strip(text) == "", F.lit("BLANK"))
        .when(text.rlike(r"(?U)^\s*#\s*[^\r\n]+?\s*$"), F.lit("HEADER"))
        .when(text.rlike(r"(?U)^\s*(?:-|---.*)\s*$"), F.lit("FOOTER"))
        .when(text.rlike(r"(?U)^\s*!!"), F.lit("COMMENT"))
        .when(text.rlike(r"(?U)^\s*:[A-Za-z_][A-Za-z0-9_]*"), F.lit("LABEL"))
        .when(text.rlike(r"(?iU)^\s*end\b"), F.lit("END"))
        .when(text.rlike(r"(?iU)^\s*for\b"), block("FOR"))
        .when(text.rlike(r"(?iU)^\s*elseif\b"), block("ELSEIF"))
        .when(text.rlike(r"(?iU)^\s*else\b"), block("ELSE"))
        .when(text.rlike(r"(?iU)^\s*if\b"), block("IF"))
        .when(text.rlike(r"(?iU)^\s*act\b"), block("ACT"))
        .otherwise(F.lit("GENERIC"))
    )
