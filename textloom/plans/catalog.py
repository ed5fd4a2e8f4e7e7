"""Queries over the driver tables, each with the SQL that gives the same rows.

Every query runs over its whole tables. Where the tables have no catalogs of their own, the lines of documents
with even doc_id stand for the old one and those with odd doc_id for the new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordering
from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Ids of a block of ordered numbering.
BLOCK = 10_000


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A line's place as one number, so that the least place of a key is found by hashing: doc_id and 24 bits of line_no.
LINE_BITS = 24


def packed(flag: Column | None = None) -> Column:
    """doc_id (38 bits) and line_no, behind a flag of one bit, as a number that orders as they do."""
    place = F.shiftleft("doc_id", LINE_BITS).bitwiseOR(F.col("line_no"))
    return place if flag is None else F.shiftleft(flag.cast("long"), 62).bitwiseOR(place)


def doc_of(place: Column) -> Column:
    return F.shiftright(place, LINE_BITS).bitwiseAND(F.lit((1 << 38) - 1))


def line_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << LINE_BITS) - 1))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, line_no, line), line_no from 1."""
    docs = ordering.spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", "source", (F.col("i") + 1).cast("long").alias("line_no"), "line")


LINES = """lines as (select doc_id, source, i as line_no, string_split(text, chr(10))[i] as line
  from (select doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents))"""


@registered(f"with {LINES} select doc_id, line_no, line from lines")
def lines_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", "line_no", "line")


@registered(f"with {LINES} select doc_id, line_no, line from lines where contains(lower(line), 'license')")
def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that contain a word, whatever its case."""
    return document_lines(spark, sf_dir).filter(F.contains(F.lower("line"), F.lit("license"))).select("doc_id", "line_no", "line")


@registered("select source, count(*) as files from documents where contains(lower(source), 'src1') group by source")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.filter(F.contains(F.lower("source"), F.lit("src1"))).groupBy("source").agg(F.count(F.lit(1)).alias("files"))


VISIBLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '<<[^>]+>>|&lt;&lt;[^\n]*?&gt;&gt;', ' ', 'g'),
  '&(?:[A-Za-z]+|#[0-9]+);', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""


@registered(f"select page_id, {VISIBLE.format(c='html')} as visible from pages")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.spread(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", T.visible_text(F.col("html")).alias("visible"))


ASSET_SQL = r"regexp_full_match({c}, '(?i)[A-Za-z0-9_./\\() -]+\.(?:jpg|jpeg|png|gif|webp|bmp|svg|mp4|webm|avi|mov|mkv)')"
MEDIA_SQL = rf"""((regexp_matches({{c}}, '(?i)<\s*/?\s*(?:img|video|audio|source)\b[^>]*>') or contains(lower({{c}}), 'src='))
  and ({VISIBLE.format(c='{c}')} = '' or {ASSET_SQL.format(c=VISIBLE.format(c='{c}'))}))"""


@registered(f"""select kind, count(*) as n, count(*) filter ({MEDIA_SQL.format(c='body')}) as media, count(*) filter ({VISIBLE.format(c='body')} = '') as empty
  from (select 'page' as kind, html as body from pages union all select 'document', text from documents) group by kind""")
def markup_only_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("body")).unionByName(read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("text").alias("body")))
    seen = ordering.spread(bodies).select("kind", "body", T.visible_text(F.col("body")).alias("seen"))
    return seen.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.is_media_only(F.col("body"), F.col("seen"))).alias("media"), F.count_if(F.col("seen") == "").alias("empty"))


@registered(f"""select page_id, path, {ASSET_SQL.format(c='path')} as asset, {ASSET_SQL.format(c="concat(path, '.png')")} as asset_png
  from (select page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) as path from pages)""")
def asset_path_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the path of a page is an asset's, as it is and with an ending added."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    pages = read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", "path", T.is_asset_path(F.col("path")).alias("asset"), T.is_asset_path(F.concat("path", F.lit(".png"))).alias("asset_png"))


TAGS_SQL = r"""list_transform(regexp_extract_all(regexp_replace({c}, '<<[^>]+>>|&lt;&lt;[^\n]*?&gt;&gt;', '', 'g'), '<\s*/?\s*[A-Za-z0-9]+(?:\s+[^>]*)?\s*/?>'),
  lambda t: case when regexp_extract(t, '<\s*(/)?\s*([A-Za-z0-9]+)(?:\s+[^>]*)?\s*(/?)>', 3) = '/' then '<' || lower(regexp_extract(t, '<\s*/?\s*([A-Za-z0-9]+)', 1)) || '/>'
    when regexp_matches(t, '^<\s*/') then '</' || lower(regexp_extract(t, '<\s*/?\s*([A-Za-z0-9]+)', 1)) || '>'
    else '<' || lower(regexp_extract(t, '<\s*/?\s*([A-Za-z0-9]+)', 1)) || '>' end)"""


@registered(f"select page_id, array_to_string({TAGS_SQL.format(c='html')}, ' ') as signature from pages")
def tag_signature_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.spread(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.array_join(T.tags(F.col("html")), " ").alias("signature"))


@registered(f"""with t as (select page_id, unnest({TAGS_SQL.format(c='html')}) as tag from pages), c as (select page_id, tag, count(*) as n from t group by all)
  select page_id, string_agg(tag || '*' || n, ' ' order by tag) as signature from c group by page_id""")
def tag_signature_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.spread(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.array_join(T.multiset(T.tags(F.col("html"))), " ").alias("signature")).filter("signature <> ''")


@registered(f"""with p as (select page_id, html, split_part(split_part(url, '://', 2), '/', 1) as host from pages),
  pairs as (select page_id, html, lag(html) over (partition by host order by page_id) as before from p)
  select page_id, {TAGS_SQL.format(c='html')} <> {TAGS_SQL.format(c='before')} as ordered_drift,
    list_sort({TAGS_SQL.format(c='html')}) <> list_sort({TAGS_SQL.format(c='before')}) as multiset_drift from pairs where before is not null""")
def signature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the one before on its host."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    pages = read(spark, sf_dir, "pages").select("page_id", "html", host.alias("host"))
    pairs = pages.withColumn("before", F.lag("html").over(Window.partitionBy("host").orderBy("page_id"))).filter("before is not null")
    a, b = T.tags(F.col("html")), T.tags(F.col("before"))
    return pairs.select("page_id", (a != b).alias("ordered_drift"), (T.multiset(a) != T.multiset(b)).alias("multiset_drift"))


WORDS_SQL = ", ".join(rf"len(regexp_extract_all({{c}}, '(?i)\b{w}\b')) as n_{w}" for w in T.STRUCTURE_WORDS)


@registered(f"select 'document' as kind, doc_id as id, {WORDS_SQL.format(c='text')} from documents union all select 'turn', conv_id * 1000 + turn, {WORDS_SQL.format(c='text')} from conversations")
def keyword_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of structure words; on masked code it is the profile that drift checks compare."""
    texts = read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = read(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    profiled = ordering.spread(texts.unionByName(turns)).select("kind", "id", T.structure_profile(F.col("text")).alias("p"))
    return profiled.select("kind", "id", *[F.col(f"p.{w}").cast("long").alias(f"n_{w}") for w in T.STRUCTURE_WORDS])


SLUG_SQL = r"""case when regexp_replace(regexp_replace(line, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then format('pos_{:08d}', line_no)
  else substring(regexp_replace(regexp_replace(line, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 72) end"""


@registered(f"""with {LINES}, k as (select doc_id, source, line_no, concat(source, '|text|', {SLUG_SQL}) as base from lines)
  select doc_id, line_no, case when row_number() over (partition by base order by doc_id, line_no) > 1 then base || format('_{{:08d}}', doc_id * 1000 + line_no) else base end as key from k""")
def slug_keys_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line with a key keeps it; later ones get their position added."""
    lines = document_lines(spark, sf_dir)
    base = F.concat(F.coalesce("source", F.lit("")), F.lit("|text|"), T.slug(F.col("line"), F.col("line_no")))
    based = lines.select("doc_id", "line_no", base.alias("base")).withColumns({"k": F.xxhash64("base"), "h": F.xxhash64("base", F.lit(1))})
    first = based.select("k", "h", packed().alias("place")).groupBy("k", "h").agg(F.min("place").alias("first"))  # map-side; no key is numbered
    number = F.col("doc_id") * 1000 + F.col("line_no")
    later = F.concat("base", F.lit("_"), F.when(number < 10**8, F.lpad(number.cast("string"), 8, "0")).otherwise(number.cast("string")))
    met = based.join(first, ["k", "h"])
    return met.select("doc_id", "line_no", F.when(packed() == F.col("first"), F.col("base")).otherwise(later).alias("key"))


@registered("""select d.doc_id, case when l.quality = 1 then 1 else 0 end as stage from documents d join labels l using (doc_id)
  where (case when l.quality = 1 then 1 else 0 end) in (1, 3, 5) and d.text <> ''""")
def stage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(0).alias("stage"))
    docs = read(spark, sf_dir, "documents").join(labels, "doc_id")
    return docs.filter(T.is_translated(F.col("stage"), F.col("text"), F.col("text"))).select("doc_id", "stage")


def catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new entries: (doc_id, source, line_no, line, norm), the old with its translation flag."""
    lines = document_lines(spark, sf_dir).withColumn("norm", F.trim("line")).filter("norm <> ''")
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    old = lines.filter("doc_id % 2 = 0").join(good, "doc_id", "left").select("doc_id", "source", "line_no", "line", "norm", F.coalesce("good", F.lit(False)).alias("translated"))
    return old, lines.filter("doc_id % 2 <> 0")


CATALOGS = f"""{LINES}, entries as (select doc_id, source, line_no, line, trim(line) as norm from lines where trim(line) <> ''),
  old as (select e.*, coalesce(g.good, false) as translated from entries e left join (select distinct doc_id, true as good from labels where quality = 1) g using (doc_id) where doc_id % 2 = 0),
  new as (select * from entries where doc_id % 2 <> 0)"""


def numbered(entries: DataFrame, key: str) -> DataFrame:
    return ordering.ordered_number(entries, [key], ["doc_id", "line_no"], F.expr(f"doc_id div {BLOCK}"), "n")


def pairs_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One-to-one pairs: the n-th old and the n-th new entry of each key."""
    a = numbered(old, key).select(key, "n", F.col("doc_id").alias("old_doc"), F.col("line_no").alias("old_line"))
    b = numbered(new, key).select(key, "n", F.col("doc_id").alias("new_doc"), F.col("line_no").alias("new_line"))
    return a.join(b, [key, "n"]).select("old_doc", "old_line", "new_doc", "new_line")


PAIRS = """select o.doc_id as old_doc, o.line_no as old_line, w.doc_id as new_doc, w.line_no as new_line
  from (select *, row_number() over (partition by {k} order by doc_id, line_no) as n from old) o
  join (select *, row_number() over (partition by {k} order by doc_id, line_no) as n from new) w on o.{k} = w.{k} and o.n = w.n"""


@registered(f"with {CATALOGS} {PAIRS.format(k='line')}")
def exact_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_by(*catalogs(spark, sf_dir), "line")


@registered(f"with {CATALOGS} {PAIRS.format(k='norm')}")
def normalized_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_by(*catalogs(spark, sf_dir), "norm")


@registered(f"""with {CATALOGS}, keys as (select norm, count(*) as n_old, count_if(translated) as good from old group by norm),
  cand as (select w.doc_id, w.line_no, o.doc_id as old_doc, o.line_no as old_line, case when o.translated then 0 else 1 end as untranslated, case when o.line = w.line then 0 else 1 end as tier
    from new w join old o on o.norm = w.norm)
  select doc_id, line_no, (r).untranslated as untranslated, (r).tier as tier, (r).old_doc as old_doc, (r).old_line as old_line from
   (select doc_id, line_no, min({{'untranslated': untranslated, 'tier': tier, 'old_doc': old_doc, 'old_line': old_line}}) as r from cand group by doc_id, line_no)""")
def tiered_match_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best old entry for each new one: translated first, then the stronger tier, then the earlier entry.

    Only the best old entry of each line and of each normalised line can win, so the join meets two small
    tables of keys and never all pairs of a key.
    """
    old, new = catalogs(spark, sf_dir)
    best = lambda key: old.groupBy(key).agg(F.min(packed(~F.col("translated"))).alias("b"))
    # Equal lines also have equal normal forms: the normal form's best decides unless the line's own is as translated.
    exact, near = best("line").withColumnRenamed("b", "exact"), best("norm").withColumnRenamed("b", "near")
    met = new.select("doc_id", "line_no", "line", "norm").join(near, "norm").join(exact, "line", "left")
    flag = lambda c: F.shiftright(c, 62)
    own = F.coalesce(flag("exact") == flag("near"), F.lit(False))
    won = met.select("doc_id", "line_no", F.when(own, 0).otherwise(1).alias("tier"), F.when(own, F.col("exact")).otherwise(F.col("near")).alias("r"))
    return won.select("doc_id", "line_no", flag("r").cast("int").alias("untranslated"), "tier", doc_of(F.col("r")).alias("old_doc"), line_of(F.col("r")).alias("old_line"))


@registered(f"with {CATALOGS} select doc_id, line_no from old where line not in (select line from new) and norm not in (select norm from new)")
def superseded_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old entries that no tier finds in the new catalog: chained anti-joins, each on its own key."""
    old, new = catalogs(spark, sf_dir)
    left = old.join(new.select("line"), "line", "left_anti").join(new.select("norm"), "norm", "left_anti")
    return left.select("doc_id", "line_no")


@registered("""select coalesce(c.c_custkey, o.o_custkey) as custkey, coalesce(o.n, 0) as n_new, c.c_custkey is null as only_new, o.o_custkey is null as only_old
  from customer c full join (select o_custkey, count(*) as n from orders group by 1) o on c.c_custkey = o.o_custkey""")
def file_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey")
    new = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = old.join(new, old.c_custkey == new.o_custkey, "full_outer")
    return joined.select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), F.coalesce("n", F.lit(0)).alias("n_new"), F.col("c_custkey").isNull().alias("only_new"), F.col("o_custkey").isNull().alias("only_old"))


@registered("""with t as (select conv_id, turn, length(text) as pos, lag(length(text)) over (partition by conv_id order by turn) as before from conversations)
  select conv_id, turn, case when before is null then 50.0 when abs(before - pos) >= 6000 then 0.0 else 100.0 - abs(before - pos) / 60.0 end as similarity from t""")
def position_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("pos")).withColumn("before", F.lag("pos").over(w))
    return turns.select("conv_id", "turn", T.position_similarity(F.col("before"), F.col("pos")).alias("similarity"))


@registered("""select event_id, greatest(cast(event_id as int) - 1, 0) as position, greatest(cast(event_id as int) + 10 - 1, 0) as range_end, props as source, event_type as expression from events""")
def context_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags written into a context and read back."""
    e = read(spark, sf_dir, "events")
    written = T.template_context(F.col("event_id").cast("int"), (F.col("event_id") + 10).cast("int"), F.col("props"), F.array("event_type"))
    c = e.select("event_id", written.alias("context"))
    got = c.select("event_id", T.position(F.col("context")).alias("position"), T.range_end(F.col("context")).alias("range_end"), T.payload(F.col("context")).alias("p"))
    return got.select("event_id", "position", "range_end", F.col("p.source").alias("source"), F.col("p.expressions")[0].alias("expression"))


@registered("""with m as (select min(ts) as lo, max(ts) as hi from events),
  h as (select user_id, event_type, epoch_us(ts) < epoch_us(lo) + (epoch_us(hi) - epoch_us(lo)) // 2 as early from events, m),
  s as (select user_id, event_type, bool_or(early) as a, bool_or(not early) as b from h group by all)
  select user_id, coalesce(string_agg(event_type, ',' order by event_type) filter (a and not b), '') as missing, coalesce(string_agg(event_type, ',' order by event_type) filter (b and not a), '') as added from s group by user_id""")
def set_diff_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user did only in the earlier and only in the later half of the time."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    span = e.agg(F.expr("min(t) + (max(t) - min(t)) div 2").alias("middle"))
    split = e.crossJoin(F.broadcast(span)).groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("t") < F.col("middle"), F.col("event_type")))).alias("a"),
        F.array_sort(F.collect_set(F.when(F.col("t") >= F.col("middle"), F.col("event_type")))).alias("b"),
    )
    return split.select("user_id", F.array_join(F.array_except("a", "b"), ",").alias("missing"), F.array_join(F.array_except("b", "a"), ",").alias("added"))


@registered("""with locked as (select doc_id from labels where toxic = 1 union select doc_id from labels where quality = 0)
  select doc_id from documents where doc_id not in (select doc_id from locked)""")
def locked_union_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    locked = labels.filter("toxic = 1").select("doc_id").union(labels.filter("quality = 0").select("doc_id")).distinct()
    return read(spark, sf_dir, "documents").select("doc_id").join(locked, "doc_id", "left_anti")


@registered("""with tr as (select d.doc_id, upper(d.source) as source from documents d join labels l using (doc_id) where l.quality = 1 and l.toxic = 0)
  select d.doc_id, coalesce(tr.source, d.source) as source, tr.doc_id is not null as overlaid from documents d left join tr using (doc_id)""")
def overlay_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base tree under translated files less locked ones."""
    from ..operators.overlay import overlay

    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    translated = docs.join(labels.filter("quality = 1").select("doc_id"), "doc_id").withColumn("source", F.upper("source"))
    return overlay(docs, translated, labels.filter("toxic = 1").select("doc_id"), "doc_id", "source")


@registered("""select source, count(*) as files, sum(n_chars)::bigint as chars, count(*) filter (n_chars > 1000) as long_files, count(distinct lang) as langs from documents group by source
  union all select 'total', count(*), sum(n_chars)::bigint, count(*) filter (n_chars > 1000), count(distinct lang) from documents""")
def partial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by source and in total, in one pass of grouping sets."""
    docs = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "n_chars", "lang")
    rolled = docs.rollup("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 1000).alias("long_files"), F.countDistinct("lang").alias("langs"))
    return rolled.select(F.coalesce("source", F.lit("total")).alias("source"), "files", "chars", "long_files", "langs")


@registered("""select event_type, count(*) as issues, count(*) filter (value > 50) as severe, greatest(0, count(*) - count(*) filter (value > 50)) as legal from events group by event_type""")
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("value") > 50).alias("severe"))
    return e.withColumn("legal", F.greatest(F.lit(0), F.col("issues") - F.col("severe")))


@registered(f"""with {LINES} select doc_id, max(length(line)) as width, max(length(line)) > greatest(40, 180) as too_wide,
  coalesce(bool_or(regexp_matches(line, '^( +\\t|\\t+ )')), false) as mixed_indent from lines group by doc_id""")
def line_width_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    width = F.array_max(F.transform(lines, lambda x: F.char_length(x)))
    mixed = F.exists(lines, lambda x: x.rlike(r"^( +\t|\t+ )"))
    return read(spark, sf_dir, "documents").select("doc_id", width.cast("long").alias("width"), (width > 180).alias("too_wide"), mixed.alias("mixed_indent")).filter("width is not null")


@registered(f"""with t as (select page_id, {TAGS_SQL.format(c='html')} as tags from pages)
  select page_id, len(list_filter(tags, lambda x: regexp_matches(x, '^<[a-z0-9]+>$'))) as opened, len(list_filter(tags, lambda x: starts_with(x, '</'))) as closed from t""")
def header_footer_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = T.tags(F.col("html"))
    pages = ordering.spread(read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", tags.alias("tags"))
    count = lambda pattern: F.size(F.filter("tags", lambda x: x.rlike(pattern))).cast("long")
    return pages.select("page_id", count("^<[a-z0-9]+>$").alias("opened"), count("^</").alias("closed"))


@registered("""select event_id, last_value(case when event_type = 'error' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_error from events""")
def carry_forward_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return ordering.carried_forward(e, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), F.when(F.col("event_type") == "error", F.col("event_id")), "last_error").select("event_id", "last_error")


@registered("""select conv_id, turn, first_value(case when role <> 'system' then turn end ignore nulls) over (partition by conv_id order by turn rows between 1 following and unbounded following) as next_turn from conversations""")
def next_non_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordering.next_where(c, ["conv_id"], ["turn"], F.expr(f"turn div {BLOCK}"), F.col("turn"), F.col("role") != "system", "next_turn").select("conv_id", "turn", "next_turn")


@registered("""with b as (select *, case when lag(role) over (partition by conv_id order by turn) = 'user' then 0 else 1 end as begins from conversations),
  g as (select *, (sum(begins) over (partition by conv_id order by turn))::bigint as island from b)
  select conv_id, island, min(turn) as first_turn, max(turn) as last_turn, string_agg(text, chr(10) order by turn) as text from g group by conv_id, island""")
def continuation_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn after a user's turn joins it, as a line joins one that ends in a continuation mark."""
    c = ordering.islands(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.expr(f"turn div {BLOCK}"), F.col("role") == "user", "island")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text"))).getField("text"), "\n")
    return c.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), text.alias("text"))


@registered("""with recursive s as (select source, doc_id, greatest(3 * n_chars, 1000) as cost, row_number() over (partition by source order by doc_id) as i from documents),
  f as (select source, i, cost, 1::bigint as batch, cost as held from s where i = 1
    union all select s.source, s.i, s.cost, case when f.held + s.cost <= 50000 then f.batch else f.batch + 1 end, case when f.held + s.cost <= 50000 then f.held + s.cost else s.cost end from f join s on s.source = f.source and s.i = f.i + 1)
  select source, batch, count(*) as n, sum(cost)::bigint as cost from f group by source, batch""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return ordering.greedy_batches(docs, ["source"], ["doc_id"], F.greatest(3 * F.col("n_chars"), F.lit(1000)), 50_000)


@registered("""with e as (select conv_id, turn, length(text) as n, length(text) - length(replace(text, ' ', '')) as delta from conversations)
  select conv_id, turn, coalesce(sum(delta) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as shift from e""")
def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much earlier replacements move a later one, if each space gained a character."""
    delta = F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit("")))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", delta.alias("delta"))
    found = ordering.scanned(turns, ["conv_id"], ["turn"], F.expr(f"turn div {BLOCK}"), F.col("delta"), "shift", total=True, own=False)
    return found.select("conv_id", "turn", F.coalesce("shift", F.lit(0)).cast("long").alias("shift"))


ALIASES = ("ECONOMY", "ECONOMY ANODIZED", "LARGE", "LARGE BRUSHED", "MEDIUM", "PROMO", "PROMO BURNISHED", "SMALL", "SMALL PLATED", "STANDARD", "STANDARD POLISHED")


@registered(f"""select p_partkey, max_by(a, length(a)) as alias from part left join (select unnest({list(ALIASES)!r}) as a)
  on starts_with(upper(p_type), a) and (length(p_type) = length(a) or substring(p_type, length(a) + 1, 1) = ' ') group by p_partkey""")
def longest_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest alias that begins a name and ends at a space; aliases are a fixed list, longest first."""
    found = F.coalesce(*[F.when(F.upper("p_type").rlike(rf"^{a}(?: |$)"), F.lit(a)) for a in sorted(ALIASES, key=len, reverse=True)])
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("alias"))


@registered(f"""with {CATALOGS}, o as (select norm, count(*) as n from old group by norm),
  n as (select source, norm, row_number() over (partition by norm order by doc_id, line_no) as i from new),
  a as (select source, count(*) filter (i <= coalesce(o.n, 0)) as migrated, count(*) filter (i > coalesce(o.n, 0)) as new_entries from n left join o using (norm) group by source),
  w as (select norm, count(*) as n from new group by norm),
  r as (select source, count(*) filter (w.norm is null) as removed from old left join w using (norm) group by source)
  select coalesce(a.source, r.source) as source, coalesce(migrated, 0) as migrated, coalesce(new_entries, 0) as new_entries, coalesce(removed, 0) as removed from a full join r on a.source = r.source""")
def catalog_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old catalog synced with a new one: entries migrated, new and removed, by source.

    The n-th new entry of a normalised line takes the n-th old one; an old line is removed if the new catalog lacks it.
    """
    entries = document_lines(spark, sf_dir).withColumn("norm", F.trim("line")).filter("norm <> ''").withColumn("old", F.expr("doc_id % 2 = 0"))
    counts = entries.groupBy("norm", "source", "old").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("norm")  # a row for each source and side at most
    sides = counts.withColumn("held", F.sum(F.when(F.col("old"), F.col("n")).otherwise(0)).over(every)).withColumn("came", F.sum(F.when(~F.col("old"), F.col("n")).otherwise(0)).over(every))
    # Only where some of a line's new entries find an old one and others don't does their order count.
    partly = sides.filter("held > 0 and held < came").groupBy("norm").agg(F.max("held").alias("held"))
    ordered = numbered(entries.filter("not old").join(partly.select("norm"), "norm", "left_semi"), "norm").join(partly, "norm")
    n = F.col("n")
    took = ordered.select("source", (n <= F.col("held")).cast("long").alias("migrated"), (n > F.col("held")).cast("long").alias("new_entries"), F.lit(0).alias("removed"))
    whole = sides.filter("not (held > 0 and held < came) or old").select(
        "source", F.when(F.expr("not old and held >= came"), n).otherwise(0).alias("migrated"), F.when(F.expr("not old and held = 0"), n).otherwise(0).alias("new_entries"), F.when(F.expr("old and came = 0"), n).otherwise(0).alias("removed")
    )
    return whole.unionByName(took).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("migrated", "new_entries", "removed")])


@registered("""select distinct lower(source) as word from documents union select distinct lower(lang) from documents where lang is not null union select distinct lower(event_type) from events""")
def autocomplete_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    words = docs.select("source").union(docs.filter("lang is not null").select("lang")).union(read(spark, sf_dir, "events").select("event_type"))
    return words.select(F.lower("source").alias("word")).distinct()


@registered(f"with {LINES} select line, arg_min({{'doc_id': doc_id, 'line_no': line_no}}, (doc_id, line_no)).doc_id as doc_id, arg_min({{'doc_id': doc_id, 'line_no': line_no}}, (doc_id, line_no)).line_no as line_no from lines group by line")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each distinct line stands first."""
    first = document_lines(spark, sf_dir).groupBy("line").agg(F.min(packed()).alias("at"))
    return first.select("line", doc_of(F.col("at")).alias("doc_id"), line_of(F.col("at")).alias("line_no"))


@registered("""select source, bool_and(n_chars > 10) as ok, bool_or(n_chars > 10000) as any_long, count(distinct lang) as langs from documents group by source""")
def summary_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.bool_and(F.col("n_chars") > 10).alias("ok"), F.bool_or(F.col("n_chars") > 10_000).alias("any_long"), F.countDistinct("lang").alias("langs"))


@registered("""select p_partkey, p_name is distinct from p_type as changed, p_name <> p_type and lower(p_name) = lower(p_type) as case_only, upper(p_brand) is distinct from p_brand as brand_changed,
  p_brand <> upper(p_brand) and lower(p_brand) = lower(upper(p_brand)) as brand_case_only from part""")
def changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs null-safely, and what differs by case alone."""
    case_only = lambda a, b: (a != b) & (F.lower(a) == F.lower(b))
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return read(spark, sf_dir, "part").select(
        "p_partkey", (~name.eqNullSafe(kind)).alias("changed"), case_only(name, kind).alias("case_only"), (~F.upper(brand).eqNullSafe(brand)).alias("brand_changed"), case_only(brand, F.upper(brand)).alias("brand_case_only")
    )


@registered(r"""select doc_id, replace(replace(substring(text, greatest(1, p - 80), (p + 7 + 80) - greatest(1, p - 80)), chr(13), '\r'), chr(10), '\n') as preview
  from (select doc_id, text, strpos(text, 'License') as p from documents) where p > 0""")
def nearby_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighty characters around the first hit of a word, line ends written out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.locate("License", F.col("text")).alias("p")).filter("p > 0")
    cut = F.expr("substring(text, greatest(1, p - 80), (p + 7 + 80) - greatest(1, p - 80))")
    return docs.select("doc_id", F.replace(F.replace(cut, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")).alias("preview"))


@registered(f"""with {LINES} select doc_id, line_no, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as start from lines""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of a text begins."""
    lines = document_lines(spark, sf_dir).select("doc_id", "line_no", (F.char_length("line") + 1).alias("size"))
    found = ordering.scanned(lines, ["doc_id"], ["line_no"], F.expr(f"line_no div {BLOCK}"), F.col("size"), "start", total=True, own=False)
    return found.select("doc_id", "line_no", F.coalesce("start", F.lit(0)).cast("long").alias("start"))


@registered("""select user_id, array_to_string(list_slice(list_sort(list_distinct(list(event_type))), 1, 3), ', ') as shown, count(distinct event_type) as kinds from events group by user_id""")
def detail_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of a user's event types in order; the rest is only counted."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return e.select("user_id", F.array_join(F.slice("kinds", 1, 3), ", ").alias("shown"), F.size("kinds").cast("long").alias("kinds"))


@registered("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate nulls last, o_orderkey) as turn from orders""")
def entries_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a file by position, those without one last, ties by index."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("turn"))
