"""DuckDB statements of the text queries, kept apart from the operators."""

from __future__ import annotations

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x{7F}]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES_SQL = rf"""
with doc as (select doc_id, row_number() over () as r, regexp_extract_all({_LOWER}, '{WORD}') as w from documents),
item as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_LOWER}, '{WORD}') as w from benchmark),
win as (select distinct item, list_slice(w, i + 1, i + least(len(w), 10)) as t, least(len(w), 10) as n
        from (select item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as i from item where len(w) > 0)),
place as (select r, n, i, list_slice(w, i + 1, i + n) as t
          from (select r, w, n, unnest(range(0, len(w) - n + 1)) as i from doc, (select distinct n from win) where len(w) >= n)),
hit as (select r, item, i, win.n as n from place join win on place.t = win.t and place.n = win.n),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from hit)) group by r),
its as (select r, list_sort(list(distinct item)) as items from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join pos using (r) left join its using (r)
"""

MIXING_SQL = """
with size as (select source, sum(octet_length(encode(coalesce(text, '')))) as b from documents group by source),
rate as (select source, case when b > 0 then pow(b, 0.7) / (select sum(pow(b, 0.7)) from size) * (select sum(b) from size) / b else 0 end as rate
         from size),
part as (select source, rate, greatest(ceil(rate / 16), 1) as parts, rate / greatest(ceil(rate / 16), 1) as l from rate),
cdf as (select source, k, sum(p) over (partition by source order by k) as c
        from (select source, k, case when l > 0 then exp(-l + k * ln(l) - lgamma(k + 1)) else cast(k = 0 as double) end as p
              from part, (select unnest(range(0, 97)) as k)) where true),
closed as (select source, list(case when k >= 96 then 1.0 else c end order by k) as cs from cdf group by source),
drawn as (select doc_id, d.source, rate,
                 list_sum([len(list_filter(cs, lambda c: c <= cast('0x' || substr(md5('23:' || x || ':' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / 4503599627370496.0))
                           for x in range(1, cast(parts as bigint) + 1)]) as n
          from documents d join part p on d.source is not distinct from p.source join closed c on d.source is not distinct from c.source)
select doc_id, source, round(rate, 6) as rate, cast(n as bigint) as n_copies, replica,
       md5('23:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(replica as varchar)) as mix_key
from (select *, unnest(range(1, cast(n as bigint) + 1)) as replica from drawn)
"""

URLS_SQL = r"""
with rule(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                          ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
page as (select row_number() over () as r, page_id,
                translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
best as (select r, arg_max({'rule': rule.host || rule.path, 'verdict': verdict}, length(rule.host || rule.path)) as b
         from page join rule on (page.host = rule.host or ends_with(page.host, '.' || rule.host)) and starts_with(page.path, rule.path) group by r)
select page_id, host, path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict from page left join best using (r)
"""

WARC_SQL = """
with page as (select page_id, encode(coalesce(html, '')) as payload from pages),
named as (select *, sha256(payload) as digest, min(page_id) over (partition by payload) as first_id from page),
kind as (select *, octet_length(payload) >= 100 and first_id is not null and page_id is distinct from first_id as again from named)
select page_id, octet_length(payload) as payload_bytes, digest as payload_digest, case when again then 'revisit' else 'response' end as record_type,
       case when again then first_id end as refers_to, cast(null as varchar) as problem
from kind
"""


def licenses_sql(templates: dict[str, str], threshold: float) -> str:
    """Every distinct part of every text against every template; the size bounds are left to the coefficient."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates.items())

    def grams(column: str) -> str:
        lower = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x{{7F}}]+')"
        same = f"list_transform({words}, lambda w: case w when 'licence' then 'license' when 'licenced' then 'licensed' when 'licences' then 'licenses' else w end)"
        return f"(select list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from (select {same} as ws))"

    return rf"""
with template(name, body) as (values {values}),
own as (select name, {grams('body')} as g from template),
doc as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
part as (select distinct r, p from (select r, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n[ \t\r]*\n'), [t])) as p from doc)
         where not regexp_full_match(p, '\s*')),
cut as (select r, p, {grams('p')} as g from part),
dice as (select r, p, name, 2.0 * len(list_intersect(own.g, cut.g)) / (len(own.g) + len(cut.g)) as d
         from cut join own on len(cut.g) between len(own.g) / 3.0 and len(own.g) * 3.0),
best as (select r, p, arg_min(name, (-d, name)) as name, max(d) as d from dice where d >= {threshold} group by r, p),
found as (select r, count(*) as n, string_agg(distinct name, ',' order by name) as names, arg_min(name, (-d, name)) as best, max(d) as d from best group by r),
size as (select r, count(*) as n_parts from part group by r)
select doc_id, coalesce(n_parts, 0) as n_parts, coalesce(n, 0) as n_matches, coalesce(names, '') as licenses, best, round(d, 6) as best_dice
from doc left join size using (r) left join found using (r)
"""


#: Every anchor against every row, by windows; rows have a number of their own, as ids may repeat.
NEGATIVES_SQL = """
with rows as (
  select row_number() over () as row_no, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scores as (
  select a.row_no as anchor_no, a.vec_id as anchor_id, r.row_no, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.x, r.x) as bigint) as score
  from rows a join rows r on a.row_no <> r.row_no where a.vec_id % 100 = 0),
positives as (
  select anchor_no, anchor_id, row_no as positive_no, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_no order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_no, p.positive_no order by s.score desc, s.vec_id) as int) as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scores s on p.anchor_no = s.anchor_no
where not s.same and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify rank <= 5
"""
