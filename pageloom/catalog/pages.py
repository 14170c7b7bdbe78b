"""Pages, listing plans and downloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.catalog import sql_parts as S
from pageloom.catalog.registry import query
from pageloom.functions import html as H
from pageloom.functions import parsing
from pageloom.operators import extract
from pageloom.operators.naming import assign_unique_names
from pageloom.plans import downloads, listing
from pageloom.plans.listing import common_prefix, sub_folder

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


@query("s1_read_pages", "select page_id, url, length(html)::bigint as size, md5(html) as hash from pages")
def s1(t):
    return t.pages.select("page_id", "url", big(F.length("html")).alias("size"), F.md5("html").alias("hash"))


def _resolve(base: str, raw: str) -> str:
    origin = f"regexp_extract({base}, '^[a-z]+://[^/?#]*')"
    folder = f"regexp_extract({base}, '^[a-z]+://[^/?#]*([^?#]*/)?', 1)"
    return (f"case when {raw} like 'http%' then {raw} when {raw} like '/%' then {origin} || {raw}"
            f" else {origin} || coalesce(nullif({folder}, ''), '/') || {raw} end")


_ATTRS = ("src", "data-src", "data-lazy", "data-original", "data-url", "data-lazy-src")


def _attr(tag: str, name: str) -> str:
    return f"coalesce(nullif(regexp_extract({tag}, '\\s{name}=\"([^\"]*)\"', 1), ''), regexp_extract({tag}, '\\s{name}=([^\\s\">]+)', 1))"


def media_sql(view: str) -> str:
    body = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script>.*?</script>', '', 'g')"
    src = " union all ".join(f"select page_id, url, 1 as pass, n * 10 + {i} as o, {_attr('tag', a)} as raw, tag, true as img from tag" for i, a in enumerate(_ATTRS))
    return f"""
with b as (select page_id, url, html, regexp_extract_all({body}, '(?i)<(?:img|source)\\b[^>]*>') as tags from {view}),
tag as (select page_id, url, unnest(tags) as tag, unnest(range(len(tags))) as n from b),
scr as (select page_id, url, regexp_extract_all(html, '"images":\\[([^\\]]*)\\]', 1) as lists from b),
raws as ({src} union all
  select page_id, url, 2, n * 100 + k, split_part(trim(part), ' ', 1), '', true from (select page_id, url, n, unnest(p) as part, unnest(range(len(p))) as k
    from (select page_id, url, n, string_split(nullif({_attr('tag', 'srcset')}, ''), ',') as p from tag))
  union all select page_id, url, 3, k, trim(item, ' "'), '', true from (select page_id, url, unnest(i) as item, unnest(range(len(i))) as k from (
    select page_id, url, string_split(array_to_string(lists, ','), ',') as i from scr))),
full_ as (select page_id, pass, o, {_resolve('url', 'raw')} as u, tag from raws where raw <> '' and raw not like 'data:%'),
firsts as (select page_id, u, min(pass * 1000000 + o) as place from full_ where {S.is_image('u')} or (pass = 1 and {_attr('tag', 'type')} like '%image%') group by 1, 2)
select page_id, u as url, row_number() over (partition by page_id order by place)::bigint as ord,
  case place // 1000000 when 1 then 'attribute' when 2 then 'srcset' else 'inline' end as origin from firsts"""


@query("x1_extract_media_urls", media_sql("fx_site"))
def x1(t):
    return extract.extract_media_urls(t.fx_site).drop("total")


@query("x1_external_scripts", f"""
with m as ({media_sql("fx_site")}), last as (select page_id, count(*) as n from m group by 1), p as (select page_id, url, coalesce(n, 0) as n from fx_site left join last using (page_id))
select page_id, ord, url, origin from m
union all select page_id, n + 1, {_resolve('url', "'shared.png'")}, 'script' from p
union all select page_id, n + 2, 'https://cdn.example.net/shared.webp', 'script' from p
union all select page_id, n + 3, 'https://cdn.example.net/' || page_id::varchar || '.png', 'script' from p""")
def x1b(t):
    # one script that all pages of a host name, one of the page's own, one of another host
    own = F.concat(F.lit("/js/p"), F.col("page_id").cast("string"), F.lit(".js"))
    made = t.fx_site.select("page_id", "url", F.concat("html", F.lit('<script src="/js/d.js"></script><script src="'), own, F.lit('"></script><script src="https://else.com/x.js"></script>')).alias("html"))
    host = F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0)
    shared = made.select(F.concat(host, F.lit("/js/d.js")).alias("script_url")).distinct().withColumn(
        "text", F.lit("""{"images": ["shared.png", 5]}; x = 'https://cdn.example.net/shared.webp'"""))
    single = made.select(F.concat(host, own).alias("script_url"), F.concat(F.lit("x='https://cdn.example.net/"), F.col("page_id").cast("string"), F.lit(".png'")).alias("text"))
    other = made.limit(1).select(F.lit("https://else.com/x.js").alias("script_url"), F.lit("x='https://else.com/x.png'").alias("text"))
    return extract.extract_media_urls(made, shared.unionByName(single).unionByName(other)).select("page_id", "ord", "url", "origin")


@query("n3_script_image_urls", """
select page_id, item from (select page_id, trim(unnest(string_split(regexp_extract(html, '"images":\\[([^\\]]*)\\]', 1), ',')), ' "') as item from fx_pg)
union all select page_id, 'https://q.example.com/' || page_id::varchar || '.JPEG' from fx_pg union all select page_id, 'a.png' from fx_pg""")
def n3(t):
    made = t.fx_pg.select("page_id", F.concat("html", F.lit("<script>'pics': [ 'no json' ], 'photo_list': [\"a.png\", 7, null, {\"b\": \"c.png\"}], u='https://q.example.com/"),
                                              F.col("page_id").cast("string"), F.lit(".JPEG'</script>")).alias("html"))
    scripts = made.select("page_id", F.explode(H.inline_scripts("html")).alias("s")).select("page_id", F.explode(parsing.script_url_lists("s")).alias("i"))
    return scripts.select("page_id", F.col("i.raw").alias("item"))


@query("n4_srcset_urls", f"""
select page_id, split_part(trim(unnest(string_split(regexp_extract(html, 'srcset="([^"]*)"', 1), ','))), ' ', 1) as raw from fx_pg""")
def n4(t):
    tags = t.fx_pg.select("page_id", F.explode(H.tags("html", "img", "source")).alias("tag"))
    return tags.select("page_id", F.explode(parsing.srcset_urls(F.coalesce(H.attribute_of(F.col("tag"), "srcset"), F.lit("")))).alias("raw"))


@query("u4_distinct_union_urls", f"select page_id, url, ord from ({media_sql('fx_pg')})")
def u4(t):
    return extract.extract_media_urls(t.fx_pg).select("page_id", "url", "ord")


@query("a15_first_seen_distinct", f"select url, min(page_id * 1000 + ord) as place from ({media_sql('fx_pg')}) group by 1")
def a15(t):
    media = extract.extract_media_urls(t.fx_pg).withColumn("place", F.col("page_id") * 1000 + F.col("ord"))
    return extract.first_seen_distinct(media, ["url"], "place")


@query("x2_extract_article_media", f"""
select page_id, 'Chap ' || page_id::varchar as title, unnest([1, 2])::bigint as ord, unnest([{_resolve('url', "'/c/' || page_id::varchar || '-1.jpg'")}, {_resolve('url', "'c2.webp'")}]) as url from fx_site""")
def x2(t):
    return extract.article_media(t.fx_site)


@query("x3_extract_listing_items", f"""
select page_id, title, {_resolve('url', 'ref')} as url from (
  select page_id, url, 'Series A ' || (page_id % 13)::varchar as title, '/art/' || (page_id % 13)::varchar || '.html' as ref from fx_site union all
  select page_id, url, 'Series B', '/art/' || (page_id % 5)::varchar || '.html' from fx_site where page_id % 5 <> page_id % 13)""")
def x3(t):
    made = t.fx_site.select("page_id", F.explode(extract.article_items("html", "url")).alias("i"))
    return made.select("page_id", "i.title", "i.url")


@query("a4_max_page_no", """
select page_id, page_id % 5 + 1 as by_query, page_id % 4 + 1 as by_path, greatest(page_id % 5 + 1, coalesce(try_cast(nullif(regexp_extract(url, '[?&]p=(\\d+)', 1), '') as bigint), 1)) as with_own from fx_site""")
def a4(t):
    q = extract.max_page_no("html")
    return t.fx_site.select("page_id", q.alias("by_query"), extract.max_page_no("html", "path").alias("by_path"),
                            F.greatest(q, extract.own_page_no("url")).alias("with_own"))


@query("a6_best_title_per_item", f"""
with a as (select page_id, url, url as t1, 'A longer title for the gallery: no ' || page_id::varchar || '?' as t2 from fx_site)
select page_id, (page_id % 9)::varchar as item_id, case when length(t2) > length({S.sanitize('t1')}) then {S.sanitize('t2')} else {S.sanitize('t1')} end as title,
  {_resolve('url', "'/photos-index-aid-' || (page_id % 9)::varchar || '.html'")} as url from a
union all select page_id, '77', 'gallery_77', {_resolve('url', "'/photos-index-aid-77.html'")} from fx_site""")
def a6(t):
    made = t.fx_site.select("page_id", F.explode(extract.gallery_items("html", "url")).alias("i"))
    return made.select("page_id", "i.item_id", "i.title", "i.url")


_TITLES = "select doc_id, lang, source, concat('[', source, '] ', lang, ' ', case doc_id % 2 when 0 then 'vol 1' else 'vol 12' end, ' ', text) as title from documents"
# every title of a group lies between its smallest and its largest, so their common beginning is all titles'
_PREFIXED = f"""(select lang, source, k, rtrim(left(lo, n::bigint)) as p from (select *, case when lo = hi then length(lo)
  else list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda n: left(lo, n) = left(hi, n))) end as n
  from (select lang, source, min(title) as lo, max(title) as hi, count(*) as k from ({_TITLES}) group by 1, 2)))"""


@query("a5_common_prefix", f"""
select lang, source, p as plain, case when k > 1 then case when strpos(reverse(p), ' ') > 0 and length(p) - strpos(reverse(p), ' ') > 0
  then left(p, length(p) - strpos(reverse(p), ' ') + 1) else p end else '' end as cut from {_PREFIXED}""")
def a5(t):
    groups = t.sql(_TITLES).groupBy("lang", "source").agg(common_prefix("title").alias("plain"), common_prefix("title", True).alias("cut"))
    return groups


@query("ud6_lcp_agg", f"select lang, source, p as prefix from {_PREFIXED}")
def ud6(t):
    return t.sql(_TITLES).groupBy("lang", "source").agg(common_prefix("title").alias("prefix"))


@query("t37_sub_folder", f"""select doc_id, {S.sanitize(S.trim("substr(title, length(p) + 1)"))} as folder from ({_TITLES}) join {_PREFIXED} using (lang, source)""")
def t37(t):
    titles = t.sql(_TITLES)
    prefixes = titles.groupBy("lang", "source").agg(common_prefix("title").alias("p"))
    return titles.join(prefixes, ["lang", "source"]).select("doc_id", sub_folder("title", "p").alias("folder"))


_PLAN = f"""
with own as (select listing_id, max(page_id % 5 + 1) as last from (select *, (listing_id + (page_no - 1) * 12) as page_id from fx_list_page) where page_no = 1 group by 1),
pg as (select p.listing_id, p.page_no, p.listing_id + (p.page_no - 1) * 12 as page_id from fx_list_page p join own using (listing_id) where p.page_no <= own.last),
items as (select listing_id, page_no, 0 as ord, '[team] Story ' || listing_id::varchar || ' - part ' || page_no::varchar as title, page_id as aid from pg
  union all select listing_id, page_no, 1, '[team] Story ' || listing_id::varchar || ' - extra', 100000 + page_id from pg),
pre as (select listing_id, rtrim(left(any_value(title), max(n)::bigint)) as prefix from items join (select listing_id as l, n from (select listing_id, n, count(distinct left(title, n)) as d
  from items, unnest(range(0, 60)) as r(n) group by 1, 2) where d = 1) on l = listing_id group by 1)
select listing_id, page_no::bigint as page_no, ord::bigint as ord, title, 'https://site.example.com/photos-slide-aid-' || aid::varchar || '.html' as url,
  'output/' || {S.sanitize('prefix')} || '/' || {S.sanitize(S.trim("substr(title, length(prefix) + 1)"))} as folder,
  row_number() over (partition by listing_id order by page_no desc, ord desc)::bigint as place from items join pre using (listing_id)"""


@query("x4_plan_listing", _PLAN)
def x4(t):
    from pageloom.plans.ordered import any_order_position

    plan = listing.plan_listing(t.fx_list, t.fx_list_page)
    return any_order_position(plan, ["listing_id"], listing.visit_order(), "place").select(
        "listing_id", "page_no", "ord", "title", "url", "folder", "place")


@query("x4_plan_article_listing")
def x4b(t):
    return listing.plan_listing(t.fx_list, t.fx_art_page, "article").select("listing_id", "page_no", "title", "url", "folder")


@query("o5_visit_order", f"select page_id, url, row_number() over (partition by page_id % 12 order by page_id desc, ord desc)::bigint as place from ({media_sql('fx_pg')})")
def o5(t):
    from pageloom.plans.ordered import any_order_position

    media = extract.extract_media_urls(t.fx_pg).withColumn("listing_id", F.col("page_id") % 12)
    return any_order_position(media, ["listing_id"], listing.visit_order("page_id", "ord"), "place").select("page_id", "url", "place")


_EXIST = "select '/d/' || (page_id % 3)::varchar as folder, (page_id % 40)::varchar || '.jpg' as name, (page_id % 2) as length from fx_pg where page_id % 7 = 0"
_WORK = f"""select '/d/' || (page_id % 3)::varchar as folder, page_id, page_id * 1000 + ord as idx, url, {S.file_name('url', 'ord')} as name from ({media_sql('fx_pg')})"""


@query("j1_pending_downloads", f"select folder, page_id, idx, url, name from ({_WORK}) where (folder, name) not in (select folder, name from ({_EXIST}) where length > 0)")
def j1(t):
    from pageloom.functions.urls import url_filename

    work = extract.extract_media_urls(t.fx_pg).select(F.concat(F.lit("/d/"), (F.col("page_id") % 3).cast("string")).alias("folder"), "page_id",
                                                      (F.col("page_id") * 1000 + F.col("ord")).alias("idx"), "url", url_filename("url", "ord").alias("name"))
    return downloads.pending_downloads(work, _existing(t))


def _existing(t):
    return t.fx_pg.filter("page_id % 7 = 0").select(F.concat(F.lit("/d/"), (F.col("page_id") % 3).cast("string")).alias("folder"),
                                                    F.concat((F.col("page_id") % 40).cast("string"), F.lit(".jpg")).alias("name"), (F.col("page_id") % 2).alias("length"))


@query("x5_plan_downloads", f"""
with w as (select '/d/' || page_id::varchar as folder, page_id, ord as idx, max(ord) over (partition by page_id) as total, url, {S.file_name('url', 'ord')} as name from ({media_sql('fx_pg')}))
select *, case when (folder, name) in (select folder, name from ({_EXIST})) then regexp_replace(name, '(\\.[^.]*)$', '_1\\1') else name end as unique_name
from w where (folder, name) not in (select folder, name from ({_EXIST}) where length > 0)""")
def x5(t):
    existing = _existing(t)
    return downloads.plan_downloads(t.fx_pg, existing, F.concat(F.lit("/d/"), F.col("page_id").cast("string"))).select(
        "folder", "page_id", "idx", "total", "url", "name", "unique_name")


@query("w1_assign_unique_names", """
select file_id, folder, name, case when k = 0 then name else regexp_replace(name, '(\\.[^.]*)$', '_' || k::varchar || '\\1') end as unique_name
from (select *, row_number() over (partition by folder, name order by file_id) - 1 as k from fx_file)""")
def w1(t):
    nothing = t.fx_file.filter("1 = 0").select("folder", "name")
    return assign_unique_names(t.fx_file.select("file_id", "folder", "name", F.col("file_id").alias("idx")), nothing).select("file_id", "folder", "name", "unique_name")


@query("w1_contested_names")
def w1b(t):
    """Requests that read like another request's suffixed name, with files in place."""
    work = t.fx_file.select("file_id", "folder", F.expr("case when file_id % 5 = 0 then regexp_replace(name, '\\\\.', '_1.') when file_id % 7 = 0 then regexp_replace(name, '\\\\.', '_2.') else name end").alias("name"),
                            F.col("file_id").alias("idx"))
    there = t.fx_file.filter("file_id % 11 = 0").select("folder", "name")
    return assign_unique_names(work, there).select("file_id", "folder", "name", "unique_name")


_IMG = S.is_image("url")
_OUTCOME = (f"case when http_status is null or http_status = 429 then 'retryable' when http_status between 400 and 499 then 'permanent' when http_status >= 500 then 'retryable'"
            f" when not (content_type like '%image%' or {_IMG}) then 'skipped' else 'success' end")


@query("f19_classify_http_outcome", f"select run_id, url, attempt_no::bigint as attempt_no, {_OUTCOME} as outcome from fx_att")
def f19(t):
    from pageloom.functions.predicates import http_outcome

    return t.fx_att.select("run_id", "url", big("attempt_no").alias("attempt_no"), http_outcome("http_status", "content_type", "url").alias("outcome"))


_RESOLVED = f"""
with j as (select *, {_OUTCOME} as what from fx_att where attempt_no <= 3),
e as (select run_id, url, min(attempt_no) filter (what <> 'retryable') as at, max(attempt_no) as last from j group by 1, 2),
f as (select j.* from j join e on j.run_id = e.run_id and j.url = e.url and j.attempt_no = coalesce(e.at, e.last)),
r as (select run_id, url, idx, folder, referer, (attempt_no + 1)::bigint as tries,
  case when what in ('success', 'skipped') then what when what = 'permanent' or attempt_no >= 3 then 'failed' else 'retrying' end as outcome,
  case when what not in ('success', 'skipped') then coalesce('HTTP ' || http_status::varchar, error) end as error,
  case when what = 'retryable' and attempt_no < 3 then least(power(2.0, attempt_no + 1), 30.0)::double end as next_wait from f)"""


@query("x6_resolve_attempts", f"{_RESOLVED} select * from r")
def x6(t):
    return downloads.resolve_attempts(t.fx_att)


@query("a7_download_summary", f"""{_RESOLVED} select run_id, count(*) filter (outcome = 'success')::bigint as success, count(*) filter (outcome = 'failed')::bigint as failed,
  count(*) filter (outcome = 'skipped')::bigint as skipped, count(*) filter (outcome <> 'retrying')::bigint as done from r group by 1""")
def a7(t):
    return downloads.download_summary(downloads.resolve_attempts(t.fx_att))


_FILLED = "select run_id, url, idx, coalesce(nullif(folder, ''), '/def') as folder, coalesce(nullif(referer, ''), 'https://r/') as referer from r where outcome = 'failed'"


@query("a8_retry_groups", f"{_RESOLVED} select run_id, folder, referer, count(*)::bigint as items, min(idx) as first_idx from ({_FILLED}) group by 1, 2, 3")
def a8(t):
    failed = downloads.resolve_attempts(t.fx_att).filter("outcome = 'failed'")
    return downloads.retry_groups(failed, "/def", "https://r/")


@query("x7_next_retry_batch", f"{_RESOLVED} {_FILLED}")
def x7(t):
    return downloads.next_retry_batch(t.fx_att, 3, "/def", "https://r/")


@query("d3_backoff_seconds", """
select run_id, url, attempt_no::bigint as attempt_no, case when attempt_no > 0 then least(power(2.0, attempt_no), 30.0) else 0.0 end::double as expo, least(20.0 * attempt_no, 60.0)::double as linear,
  (1.5 * attempt_no)::double as short from fx_att""")
def d3(t):
    from pageloom.functions.times import backoff_seconds

    return t.fx_att.select("run_id", "url", big("attempt_no").alias("attempt_no"), backoff_seconds("attempt_no").alias("expo"), backoff_seconds("attempt_no", "linear", 20).alias("linear"),
                           backoff_seconds("attempt_no", "short").cast("double").alias("short"))


@query("ud7_explode_media")
def ud7(t):
    t.fx_site.createOrReplaceTempView("fx_site_pages")
    extract.register_media_view(t.spark, "fx_site_pages", "explode_media")
    return t.spark.sql("select page_id, ord, url from explode_media")
