"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import licenses

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EXACT_DEDUP = f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, text_sha256 from d join g using (text_sha256)
"""


def license_scans() -> str:
    """Makes terms and weights from the texts of the templates by itself, and compares every window with every template."""
    texts = ", ".join("({}, '{}', '{}')".format(i, name, text.lower().replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))
    windows = " union all ".join(
        f"""select file, {size >= licenses.LARGE} as large, flatten(list_slice(lines, place + 1, place + {size})) as terms
          from (select file, lines, unnest(range(0, (greatest(0, len(lines) - {size}) + {step - 1}) // {step} * {step} + 1, {step})) as place from split where len(lines) > {shorter})"""
        for (size, step), shorter in zip(licenses.WINDOWS, (0, *(w for w, _ in licenses.WINDOWS)), strict=False)
    )
    return f"""
with texts(template, license, body) as (values {texts}),
words as (select template, license, term, count(*) as n from (select template, license, unnest(regexp_extract_all(body, '{licenses.TERM}')) as term from texts) group by all),
idf as (select term, ln((1 + (select count(*) from texts)) / (1 + count(*))) + 1 as idf from words group by term),
tpl as (select template, license, term, (1 + ln(n)) * idf / sqrt(sum(pow((1 + ln(n)) * idf, 2)) over (partition by template)) as share, count(*) over (partition by template) >= {licenses.LONG} as long from words join idf using (term)),
f as (
  select row_number() over () as file, doc_id, coalesce(text, '') as text,
    coalesce(coalesce(source, 'none') || '/p' || (doc_id // 1000) || '/m' || (doc_id // 100 % 10) || '/' ||
      case when doc_id % 10 = 0 then 'LICENSE' else 'd' || doc_id || '.txt' end, coalesce(source, 'none') || '/unnamed.txt') as path
  from documents),
split as (select file, list_transform(string_split(lower(text), chr(10)), lambda x: regexp_extract_all(x, '{licenses.TERM}')) as lines from f),
w as (select row_number() over () as line, file, large, terms from ({windows})),
weighed as (select file, line, large, term, (1 + ln(n)) * coalesce(idf, ln(1 + (select count(*) from texts)) + 1) as w
  from (select file, line, large, term, count(*) as n from (select file, line, large, unnest(terms) as term from w) group by all) left join idf using (term)),
norms as (select file, line, sqrt(sum(w * w)) as norm from weighed group by all),
dots as (select file, line, template, license, sum(w * share) as dot from weighed join tpl using (term) where long or not large group by all),
scored as (select file, license, max(round(dot / norm, 6)) as score from dots join norms using (file, line) group by all having max(round(dot / norm, 6)) >= {licenses.THRESHOLD}),
own as (select file, license, score from scored qualify row_number() over (partition by file order by score desc, license) = 1),
named as (select f.file, f.doc_id, f.path, regexp_replace(f.path, '/[^/]*$', '') as dir, own.license, own.score from f left join own using (file)),
giving as (
  select dir as from_dir, license as dir_license from named
  where license is not null and regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{licenses.LICENCE_FILE}')
  qualify row_number() over (partition by dir order by score desc, license) = 1),
folders as (select distinct dir from named where license is null),
reached as (
  select dir, unnest(list_transform(range(0, len(string_split(dir, '/')) + 1), lambda n: array_to_string(list_slice(string_split(dir, '/'), 1, n), '/'))) as from_dir from folders),
nearest as (
  select dir, from_dir, dir_license from reached join giving using (from_dir)
  qualify row_number() over (partition by dir order by length(from_dir) desc) = 1)
select named.doc_id, named.path, case when license is not null then 'own' when dir_license is not null then 'inherited' else 'none' end as origin,
  coalesce(license, dir_license) as license, score, case when license is null then from_dir end as from_dir
from named left join nearest using (dir)
"""


ORACLES = {"op9_license_scans": license_scans(), "op10_exact_dedup": EXACT_DEDUP}
