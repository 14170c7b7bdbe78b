"""SQL for queries whose wording needs pieces of several modules."""

from __future__ import annotations

from pageloom.catalog import pages, term_store, urls_and_text
from pageloom.catalog import sql_parts as S
from pageloom.catalog.flow import vocab_sql
from pageloom.catalog.registry import ORACLES, with_views
from pageloom.catalog.sql_parts import trim
from pageloom.functions import lexicon as L

NOW = term_store.NOW


def add(name: str, sql: str) -> None:
    ORACLES[name] = with_views(sql)


add("t19_fix_closed_vocab", f"select seg_id, o as txt from ({vocab_sql('select seg_id, src as s, trans as o from fx_seg')})")

add("s10_write_term_snapshot", f"""select term_id, zh, vi, enabled or term_id % 2 = 0 as enabled, source as sources, created_s,
  case when term_id % 2 = 0 then {NOW} else updated_s end as updated_s from fx_store""")

add("s11_append_learned_terms", f"select zh || ' => ' || vi as value, series_id from {term_store._TERMS}")

add("s13_write_journal", "select run_id, seq, type, state as msg from fx_ev where run_id <> 7 or seq % 2 = 0")

add("m3_rename_term", f"""
with b as (select vi, min(term_id) as owner from fx_store where term_id % 7 = 0 and term_id % 5 <> 0 group by 1)
select term_id, case when term_id % 5 = 0 then zh || '改' when term_id % 7 = 0 then '宗' || vi else zh end as zh,
  case when term_id % 5 = 0 then vi || '!' when term_id % 7 = 0 then vi || '?' else vi end as vi, enabled, source as sources, created_s,
  case when term_id % 5 = 0 or term_id % 7 = 0 then {NOW} else updated_s end as updated_s
from fx_store where term_id % 5 = 0 or term_id % 7 <> 0 or term_id in (select owner from b)""")

add("ud1_batch_map", """
with n as (select *, (row_number() over (partition by page_id order by seg_no) - 1) // 3 as b from fx_conv),
r as (select *, bool_or(src like 'Le %') over (partition by page_id, b) as refused from n)
select page_id, seg_no, case when not refused and contains(src, 'an') then 'đã ' || src else src end as trans,
  case when refused then 'kept_original' else 'ok' end as status, case when refused then 'ValueError: refused' end as error from r""")

add("ud2_retry_until_valid", """select page_id, seg_no, case when contains(src, 'an') then 'đã ' || src else src end as trans, contains(src, 'an') as accepted,
  case when contains(src, 'an') then 0 else 2 end as rounds from fx_conv""")

add("ud7_explode_media", f"select page_id, ord, url from ({pages.media_sql('fx_site')})")

add("s3_read_image_pixels", """select page_id, page_id % 10 <> 3 as readable, case when page_id % 10 = 3 then -1 else w end as width,
  case when page_id % 10 = 3 then -1 else 48 end as height, case when page_id % 10 = 3 then 0 else w * 48 * 3 end::bigint as size
  from (select page_id, (40 + page_id % 16)::int as w from pages)""")

add("st6_stream_live_terms", """
with own as (select split_part(p_name, ' ', 1) as zh, min(p_type) as vi, min(p_partkey) as pos from part group by 1),
shared as (select zh, arg_min(vi, term_id) as vi, min(term_id) as pos, arg_min(enabled, term_id) as enabled from (
  select regexp_replace(zh, '^宗| \\d+$', '', 'g') as zh, vi, term_id, enabled from fx_store) group by 1),
terms as (select zh, vi, pos from own union all select zh, vi, pos from shared where enabled and zh not in (select zh from own)),
hits as (select seg_id, list_reduce(list(zh || chr(31) || vi order by length(zh) desc, pos), lambda acc, x: case when contains(acc, split_part(x, chr(31), 1))
    and not contains(lower(acc), lower(split_part(x, chr(31), 2))) then replace(acc, split_part(x, chr(31), 1), split_part(x, chr(31), 2)) else acc end, any_value(trans)) as o
  from fx_seg join terms on contains(src, zh) group by 1)
select series_id, seg_id, coalesce(o, trans) as enforced from fx_seg left join hits using (seg_id)""")

_IOU = "(greatest(least(k.x2, x[1].x2) - greatest(k.x1, x[1].x1), 0)::bigint * greatest(least(k.y2, x[1].y2) - greatest(k.y1, x[1].y1), 0))"
_SIZE = "(({t}.x2 - {t}.x1)::bigint * ({t}.y2 - {t}.y1))"
add("j11_dedupe_candidates", f"""
with b as (select (page_id // 32)::bigint as page_id, (page_id % 32 * 64 + region_id)::int as region_id, x1, y1, x2, y2 from fx_box),
k as (select page_id, list_reduce(list([struct_pack(id := region_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] order by region_id), lambda acc, x:
  case when len(list_filter(acc, lambda k: {_IOU} / ({_SIZE.format(t='k')} + {_SIZE.format(t='x[1]')} - {_IOU}) > 0.4)) > 0 then acc else list_concat(acc, x) end) as kept from b group by 1)
select page_id, unnest(kept).id as region_id from k""")

_P = S.sanitize(trim("substr(title, length(prefix) + 1)"))
add("x4_plan_article_listing", f"""
with last as (select listing_id, max((listing_id + (page_no - 1) * 12) % 5 + 1) as last from fx_art_page where page_no = 1 group by 1),
items as (select listing_id, page_no::bigint as page_no, 'Tale ' || listing_id::varchar || ' 1' || ((listing_id + (page_no - 1) * 12) % 30)::varchar as title,
  'https://site.example.com/a' || ((listing_id + (page_no - 1) * 12) % 30)::varchar || '.html' as url from fx_art_page join last using (listing_id) where page_no <= last),
one as (select listing_id, url, arg_max(title, page_no) as title, max(page_no) as page_no from items group by 1, 2),
pre as (select listing_id, max(n) as n, any_value(c) as c from (select listing_id, n, count(distinct left(title, n)) as d, count(*) as c from one, unnest(range(0, 40)) as r(n) group by 1, 2) where d = 1 group by 1),
p as (select o.*, case when c = 1 then '' else rtrim(left(title, n::bigint)) end as raw from one o join pre using (listing_id)),
c as (select *, case when contains(raw, ' ') then left(raw, length(raw) - strpos(reverse(raw), ' ') + 1) else raw end as prefix from p)
select listing_id, page_no, title, url, case when trim(prefix) = '' then 'output/' || {S.sanitize('title')} else 'output/' || {S.sanitize('prefix')} || '/' || {_P} end as folder from c""")

_SPELT = urls_and_text._SPELT
add("n2_parse_string_array", f"""
with r as (select reply_id, replace(replace(text, chr(10), ' '), '"', '') as t, role from (select conv_id * 1000 + turn as reply_id, text, role, (conv_id + turn) % 6 as kind from conversations) where kind = 2)
select reply_id, {S.clean_marks('y')} || '¦' || role || ' chủ' as texts from (select reply_id, role, {_SPELT} as y from (select reply_id, role, {urls_and_text._glued_sql('t')} as x from r))""")

_PAIR_IOU = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)::bigint * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"
add("j10_dedupe_overlaps", f"""
with c as (select (page_id // 32)::bigint as page_id, (page_id % 32 * 64 + region_id)::int as region_id, x1, y1, x2, y2, length(text) as n from fx_box),
e as (select a.page_id, list([a.region_id, b.region_id, case when a.n >= b.n then 1 else 0 end] order by a.region_id, b.region_id) as edges
  from c a join c b on a.page_id = b.page_id and a.region_id < b.region_id
  where {_PAIR_IOU} / ({_SIZE.format(t='a')} + {_SIZE.format(t='b')} - {_PAIR_IOU}) > 0.5 group by 1),
g as (select page_id, list_reduce(edges, lambda acc, x: case when list_contains(acc, x[1]) or list_contains(acc, x[2]) then acc
  else list_append(acc, case when x[3] = 1 then x[2] else x[1] end) end, []::int[]) as gone from e)
select c.page_id, c.region_id from c left join g using (page_id) where g.gone is null or not list_contains(g.gone, c.region_id)""")

# a character, a word (or a single Han character) five times in a row; or, of ten words or more, two words that stand in the rest again
# and three times at least in the whole
_RUN = " and ".join(f"x is not distinct from lag(x, {k}) over w" for k in range(1, 5))
def repetitive_sql(base: str) -> str:
    """base: id, t. Rows (id, repetitive)."""
    return rf"""
(with d as (select id, t, regexp_extract_all(t, '\S+') as ws from ({base})),
runs as (select id from (select id, x is not null and {_RUN} as five from (
    select id, 0 as kind, unnest(string_split(t, '')) as x, unnest(range(length(t))) as i from d
    union all select id, 1, unnest(g), unnest(range(len(g))) from (select id, regexp_extract_all(t, '[一-鿿]|\S+') as g from d))
  window w as (partition by id, kind order by i)) group by 1 having bool_or(five)),
phrases as (select id, t, ws, i, ws[i] || ' ' || ws[i + 1] as p from (select id, t, ws, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 10)),
again as (select distinct id from phrases where (length(t) - length(replace(t, p, ''))) // length(p) >= 3 and contains(array_to_string(ws[i + 2:], ' '), p))
select id, length({trim('t')}) >= 5 and (id in (select id from runs) or id in (select id from again)) as repetitive from d)"""


_WHOLE_TEXTS = "select doc_id as id, coalesce(text, '') as t from documents"
add("f17_is_repetitive", f"select id as doc_id, repetitive from {repetitive_sql(_WHOLE_TEXTS)}")

_JUDGED = f"""select id, page_id, seg_no, s, {S.clean_marks('t', 'chat')} as r from (
  select row_number() over () as id, page_id, seg_no, {S.artifacts("coalesce(src, '')", 'chat')} as s, {S.artifacts("coalesce(trans, '')", 'chat')} as t from (
    select page_id, seg_no, src, trans from fx_conv union all select -1 - page_id, seg_no, src, trans from fx_seg))"""
add("f18_accept_translation", f"""
with j as materialized ({_JUDGED})
select page_id, seg_no, case when r = {S.q(L.JOINER)} then true when lower(s) = {trim('lower(r)')} then true when {S.watermark('s', 'chat')} and r = '' then true
  when {S.needs_retry('r', 'chat')} then false else not repetitive end as accepted
from j join {repetitive_sql('select id, r as t from j')} using (id)""")

_PAIRS_OF = "map {" + ", ".join(f"{S.q(o)}: {S.q(c)}" for o, c in L.BRACKETS) + "}"
_OPENING = "[" + ", ".join(S.q(o) for o, _ in L.BRACKETS) + "]"
_CLOSING = "[" + ", ".join(S.q(c) for c in dict.fromkeys(c for _, c in L.BRACKETS)) + "]"
add("t21_repair_brackets", f"""
with recursive base as (select id, {trim('txt')} as t from (select doc_id as id, text || ' (a ]b' || chr(39) || ' 【c) 」' as txt from documents
  union all select -1 - seg_id, src || trans from fx_seg)),
ch as (select id, unnest(string_split(t, '')) as c, unnest(range(length(t))) as loc from base),
mark as (select id, loc, c, row_number() over (partition by id order by loc) as k from ch where list_contains({_OPENING}, c) or list_contains({_CLOSING}, c)),
walk as (
  select id, 0::bigint as k, []::struct(place bigint, mark varchar)[] as stack, []::struct(place bigint, mark varchar)[] as fixed from base
  union all
  select w.id, m.k, case when list_contains({_OPENING}, m.c) then list_append(w.stack, {{'place': m.loc, 'mark': m.c}}) else w.stack[:-2] end,
    case when not list_contains({_OPENING}, m.c) and len(w.stack) > 0 then [w.stack[-1], {{'place': m.loc, 'mark': ({_PAIRS_OF})[w.stack[-1].mark]}}] else []::struct(place bigint, mark varchar)[] end
  from walk w join mark m on w.id = m.id and m.k = w.k + 1),
kept as (select id, f.place as loc, f.mark as c from (select id, unnest(fixed) as f from walk))
select b.id, {trim("coalesce(string_agg(case when m.k is null then ch.c else coalesce(kept.c, '') end, '' order by ch.loc), '')")} as txt
from base b left join ch on b.id = ch.id left join mark m on ch.id = m.id and ch.loc = m.loc left join kept on ch.id = kept.id and ch.loc = kept.loc group by b.id""")

# groups are started in reading order and take whatever fits their box until nothing does
_FITS = """greatest(r.y1 - y2, y1 - r.y2) <= 18 and greatest(r.x2, x2) - least(r.x1, x1) > 0
  and least(r.x2, x2) - greatest(r.x1, x1) > 0.15 * (greatest(r.x2, x2) - least(r.x1, x1))"""


def _grown(side: str, best: str) -> str:
    return f"case when len(f) > 0 then {'least' if best == 'min' else 'greatest'}({side}, list_{best}(list_transform(f, lambda r: r.{side}))) else free[1].{side} end"


add("g13_group_nearby", f"""
with recursive walk as (
  select page_id, list({{'y1': y1::bigint, 'x1': x1::bigint, 'id': region_id::bigint, 'x2': x2::bigint, 'y2': y2::bigint}} order by y1, x1, region_id) as free,
    null::bigint as seed, null::bigint as x1, null::bigint as y1, null::bigint as x2, null::bigint as y2,
    []::struct(y1 bigint, x1 bigint, id bigint, x2 bigint, y2 bigint)[] as took from fx_box group by 1
  union all
  select page_id, case when len(f) > 0 then list_filter(free, lambda r: not list_contains(list_transform(f, lambda g: g.id), r.id)) else free[2:] end,
    case when len(f) > 0 then seed else free[1].id end, {_grown('x1', 'min')}, {_grown('y1', 'min')}, {_grown('x2', 'max')}, {_grown('y2', 'max')},
    case when len(f) > 0 then f else [free[1]] end
  from (select *, list_filter(free, lambda r: seed is not null and {_FITS}) as f from walk where len(free) > 0))
select page_id, t.id as region_id, seed as group_no from (select page_id, seed, unnest(took) as t from walk)""")

# names are handed out one by one: the first of name, name_1, name_2, ... that neither a file nor an earlier row has
add("w1_contested_names", r"""
with recursive work as (select file_id, folder, name, regexp_replace(name, '\.[^.]*$', '') as stem, regexp_extract(name, '\.[^.]*$') as ending, row_number() over (partition by folder order by file_id) as k
  from (select file_id, folder, case when file_id % 5 = 0 then regexp_replace(name, '\.', '_1.', 'g') when file_id % 7 = 0 then regexp_replace(name, '\.', '_2.', 'g') else name end as name from fx_file)),
walk as (
  select f.folder, 0::bigint as k, null::bigint as file_id, null::varchar as name, null::varchar as unique_name, coalesce(any_value(t.names), []::varchar[]) as taken
  from (select distinct folder from work) f left join (select folder, list(distinct name) as names from fx_file where file_id % 11 = 0 group by 1) t on f.folder = t.folder group by 1
  union all
  select folder, k, file_id, name, u, list_append(taken, u) from (
    select w.folder, w.k, w.file_id, w.name, s.taken, list_filter(list_transform(range(0, len(s.taken) + 1), lambda i: case when i = 0 then w.name else w.stem || '_' || i::varchar || w.ending end),
      lambda c: not list_contains(s.taken, c))[1] as u
    from walk s join work w on w.folder = s.folder and w.k = s.k + 1))
select file_id, folder, name, unique_name from walk where k > 0""")
