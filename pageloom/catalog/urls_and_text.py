"""Predicates and scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.catalog import sql_parts as S
from pageloom.catalog.registry import query
from pageloom.catalog.sql_parts import has, q, sub, trim
from pageloom.functions import lexicon as L
from pageloom.functions import parsing, predicates, text, urls

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")

# ---------------------------------------------------------------- predicates


@query("f1_is_image_url", f"""
select page_id, url, {S.is_image('url')} as direct, {S.is_image("'/i/' || page_id::varchar || ' x.PNG?a=.txt'")} as spaced from pages""")
def f1(t):
    return t.pages.select("page_id", "url", urls.is_image_url("url").alias("direct"),
                          urls.is_image_url(F.concat(F.lit("/i/"), F.col("page_id").cast("string"), F.lit(" x.PNG?a=.txt"))).alias("spaced"))


_ROUTED = ("case page_id % 7 when 0 then 'https://www.wnacg.com/search/?q=' || page_id::varchar"
           " when 1 then 'https://wnacg.ru/photos-index-aid-' || page_id::varchar || '.html'"
           " when 2 then 'https://mhxiaoshen.vip/category/a' when 3 then 'https://x.mhxiaoshen.vip/p?a=1&s=k'"
           " when 4 then 'https://mhxiaoshen.vip/' || page_id::varchar when 5 then 'https://notwnacg.com/search/' else url end")


@query("f2_route_url", f"""
select page_id, u as url, case
  when {has('h', r'(^|\.)mhxiaoshen\.vip$')} and ({has('qs', r'(^|&)s=')} or p like '/category/%') then 'article_listing'
  when {has('h', r'(^|\.)mhxiaoshen\.vip$')} then 'article'
  when {has('h', r'(^|\.)(wnacg\.com|wnacg\.ru|wnacg01\.link)$')} and (p like '/search/%' or rtrim(p, '/') in ('/search', '/search/index.php'))
    then 'gallery_listing'
  when {has('h', r'(^|\.)(wnacg\.com|wnacg\.ru|wnacg01\.link)$')} then 'gallery' else 'generic' end as route
from (select *, regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) as h, {S.path_of('u')} as p, regexp_extract(u, '[?]([^#]*)', 1) as qs
      from (select page_id, {_ROUTED} as u from pages))""")
def f2(t):
    from pageloom.operators.routing import route_urls

    made = t.sql(f"select page_id, {_ROUTED.replace('::varchar', '')} as url from pages")
    return route_urls(made).select("page_id", "url", "route")


@query("f3_has_script", f"""
select seg_id, {has('src', S.HAN_RE)} as chinese, {has('src', S.JA_RE)} as japanese,
  {has('src', f'(^|[^{S.WORDISH}])[a-zA-Z]{{3,}}($|[^{S.WORDISH}])')} as english_word, {has('src', '[A-Za-z]{2,}')} as english
from fx_seg union all
select -1 - doc_id, {has('text', S.HAN_RE)}, {has('text', S.JA_RE)},
  {has('text', f'(^|[^{S.WORDISH}])[a-zA-Z]{{3,}}($|[^{S.WORDISH}])')}, {has('text', '[A-Za-z]{2,}')} from documents""")
def f3(t):
    both = t.sql("select seg_id, src from fx_seg union all select -1 - doc_id, text from documents")
    return both.select("seg_id", *[predicates.has_script("src", s).alias(s) for s in ("chinese", "japanese", "english_word", "english")])


@query("f4_is_watermark", "select id, " + ", ".join(f"{S.watermark('txt', v)} as {v}" for v in ("common", "translate", "ocr", "chat", "render"))
       + " from (select doc_id as id, text as txt from documents union all select -1 - seg_id, src from fx_seg)")
def f4(t):
    both = t.sql("select doc_id as id, text as txt from documents union all select -1 - seg_id, src from fx_seg")
    return both.select("id", *[text.is_watermark("txt", v).alias(v) for v in ("common", "translate", "ocr", "chat", "render")])


_EAST = r"[\x{3041}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{ac00}-\x{d7af}\x{3131}-\x{318e}]"
DECOR_SQL = f"({trim('src')} <> '' and not {has('src', _EAST)} and not {S.watermark('src')})"


@query("f5_is_decor", f"select seg_id, src, {DECOR_SQL} as decor from fx_seg")
def f5(t):
    return t.fx_seg.select("seg_id", "src", predicates.is_decor("src").alias("decor"))


_REST = sub("src", r"[A-Za-z0-9._:/~?\-]+")
MARK_ONLY_SQL = (f"({S.watermark('src')} and not ({S.count(_REST, S.HAN_RE)} >= 5 or ({S.count(_REST, S.HAN_RE)} >= 2 and "
                 f"{has(_REST, '[。！？…!?]')})))")


@query("f6_watermark_only", f"select seg_id, src, {MARK_ONLY_SQL} as only_mark from fx_seg")
def f6(t):
    return t.fx_seg.select("seg_id", "src", predicates.watermark_only("src").alias("only_mark"))


TITLE_SQL = (f"({trim('src')} = '' or length({trim('src')}) >= 16 or "
             + has(trim("src"), r"[A-Za-z0-9０-９Ａ-Ｚａ-ｚ()（）\[\]【】《》〈〉#＃*＊·•:：]|第|章|话|話|回|卷|期") + ")")


@query("f7_title_safe_to_erase", f"select seg_id, src, {TITLE_SQL} as safe from fx_seg")
def f7(t):
    return t.fx_seg.select("seg_id", "src", predicates.title_safe_to_erase("src").alias("safe"))


@query("f8_effectively_empty", f"select seg_id, trans, {S.empty('trans')} as is_empty from fx_seg")
def f8(t):
    return t.fx_seg.select("seg_id", "trans", predicates.effectively_empty("trans").alias("is_empty"))


@query("f9_needs_retry", f"""
select id, {S.needs_retry('txt', 'chat')} as chat, {S.needs_retry('txt', 'translate')} as translate, {S.needs_retry('txt', 'common')} as common
from (select doc_id as id, text as txt from documents union all select -1 - seg_id, trans from fx_seg)""")
def f9(t):
    both = t.sql("select doc_id as id, text as txt from documents union all select -1 - seg_id, trans from fx_seg")
    return both.select("id", *[predicates.needs_retry("txt", v).alias(v) for v in ("chat", "translate", "common")])


@query("f10_target_is_vietnamese", f"""
select doc_id, lower(trim(l, ' ')) in ('vin', 'vi', 'vietnamese', 'tiếng việt', 'tieng viet') as vi
from (select doc_id, case doc_id % 5 when 0 then ' VIN ' when 1 then 'Tiếng Việt' when 2 then 'vi-VN' else lang end as l from documents)""")
def f10(t):
    made = t.sql("select doc_id, case doc_id % 5 when 0 then ' VIN ' when 1 then 'Tiếng Việt' when 2 then 'vi-VN' else lang end as l from documents")
    return made.select("doc_id", predicates.target_is_vietnamese("l").alias("vi"))


@query("f13_pre_translation_filter", f"""
select doc_id, reason from (select doc_id, case when {trim('x')} = '' then 'empty' when length({trim('x')}) < 40 then 'short'
  when not {has('x', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} then 'no_content' when lang = 'de' then 'target_language' end as reason
from (select doc_id, lang, case doc_id % 9 when 0 then ' ' when 1 then repeat('.-', 30) else text end as x from documents))""")
def f13(t):
    made = t.sql("select doc_id, lang, case doc_id % 9 when 0 then ' ' when 1 then repeat('.-', 30) else text end as x from documents")
    return made.select("doc_id", predicates.skipped_before_translation("x", "lang", "DE", 40).alias("reason"))


@query("f14_skip_languages", "select doc_id, lang from documents where lang not in ('fr', 'es') or lang is null")
def f14(t):
    return t.documents.select("doc_id", "lang").filter(predicates.language_not_skipped("lang", "fr, ES"))


_HAN_N, _JA_N = S.count("src", S.HAN_RE), S.count("src", r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}]")


@query("f15_filter_by_source_script", f"""
select seg_id, {has('src', S.HAN_RE)} and (conf > 0.1 or {_HAN_N} >= 4) as zh, {has('src', S.JA_RE)} and (conf > 0.1 or {_JA_N} >= 3) as ja,
  conf > 0.3 and {has('src', '[A-Za-z]{2,}')} and length({trim('src')}) >= 2 as en
from (select seg_id, src, seg_id % 11 / 20.0e0 as conf from fx_seg)""")
def f15(t):
    made = t.sql("select seg_id, src, seg_id % 11 / 20.0e0 as conf from fx_seg")
    return made.select("seg_id", *[predicates.keep_by_source_script("src", "conf", lang).alias(lang) for lang in ("zh", "ja", "en")])


@query("f16_has_visible_text", f"""
select seg_id, {trim("translate(x, chr(8203)||chr(8204)||chr(8205)||chr(8288)||chr(65279), '')")} <> '' as visible
from (select seg_id, case seg_id % 6 when 0 then chr(8205) when 1 then ' ' || chr(8203) || chr(65279) else trans || chr(8205) end as x from fx_seg)""")
def f16(t):
    made = t.sql("select seg_id, case seg_id % 6 when 0 then chr(8205) when 1 then concat(' ', chr(8203), chr(65279)) else concat(trans, chr(8205)) end as x from fx_seg".replace("chr(8205)", "'‍'").replace("chr(8203)", "'​'").replace("chr(65279)", "'﻿'"))
    return made.select("seg_id", predicates.has_visible_text("x").alias("visible"))


@query("f17_is_repetitive")
def f17(t):
    return t.documents.select("doc_id", predicates.is_repetitive("text").alias("repetitive"))


@query("f20_clamp_params", """
select p_partkey, least(greatest(try_cast(raw as double), 0.3), 2.0) as rejected,
  coalesce(least(greatest(try_cast(raw as double), 40.0), 100.0), 95.0) as defaulted
from (select p_partkey, case p_partkey % 4 when 0 then 'abc' when 1 then p_size::varchar else (p_size / 20.0e0)::varchar end as raw from part)""")
def f20(t):
    made = t.sql("select p_partkey, case p_partkey % 4 when 0 then 'abc' when 1 then cast(p_size as string) else cast(p_size / 20.0e0 as string) end as raw from part")
    return made.select("p_partkey", predicates.clamp("raw", 0.3, 2.0).alias("rejected"), predicates.clamp("raw", 40, 100, 95).alias("defaulted"))


# ---------------------------------------------------------------- names and addresses


@query("t1_sanitize_name", f"""
select page_id, {S.sanitize('n')} as name from (select page_id, case page_id % 5 when 0 then ' .a+b%20c%E4%BD%A0/' || url || '. '
  when 1 then '...' when 2 then url || repeat('x', 300) else 'q"<' || url || '>|' end as n from pages)""")
def t1(t):
    made = t.sql("""select page_id, case page_id % 5 when 0 then concat(' .a+b%20c%E4%BD%A0/', url, '. ') when 1 then '...'
      when 2 then concat(url, repeat('x', 300)) else concat('q"<', url, '>|') end as n from pages""")
    return made.select("page_id", urls.sanitize_name("n").alias("name"))


_NAMED = "concat(url, case page_id % 3 when 0 then '/a%20b.JPG?x=1.2' when 1 then '/plain' else '/c.tar.gz' end)"


@query("t2_url_filename", f"select page_id, {S.file_name('u', '(page_id * 97)')} as name from (select page_id, {_NAMED} as u from pages)")
def t2(t):
    made = t.sql(f"select page_id, {_NAMED} as u from pages")
    return made.select("page_id", urls.url_filename("u", F.col("page_id") * 97).alias("name"))


@query("t3_filename_from_url", f"""select page_id, coalesce(nullif(regexp_extract(u, '/([^/?]+)[^/]*$', 1), ''), 'none') as name
from (select page_id, {_NAMED} as u from pages)""")
def t3(t):
    return t.sql(f"select page_id, {_NAMED} as u from pages").select("page_id", urls.filename_from_url("u", "none").alias("name"))


_PAGED = ("case page_id % 6 when 0 then 'https://a.com/l?p=3&q=1' when 1 then concat(url, '?k=1') when 2 then 'https://a.com/page/4/?s=x'"
          " when 3 then 'https://a.com' when 4 then 'https://a.com/c/page/2' else url end")


@query("t4_listing_page_url", f"""
select page_id, case when contains(u, 'p=') then regexp_replace(u, '([?&]p=)\\d+', '\\1' || n::varchar, 'g')
   else u || case when contains(u, '?') then '&' else '?' end || 'p=' || n::varchar end as by_query,
  regexp_extract(u, '^([a-z]+)://', 1) || '://' || regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)
   || coalesce(nullif(rtrim(regexp_replace({S.path_of('u')}, '/page/\\d+/?', '/', 'g'), '/') || case when n > 1 then '/page/' || n::varchar else '' end, ''), '/')
   || case when regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) <> '' then '?' || regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) else '' end as by_path
from (select page_id, {_PAGED} as u, page_id % 4 + 1 as n from pages)""")
def t4(t):
    made = t.sql(f"select page_id, {_PAGED} as u, page_id % 4 + 1 as n from pages")
    return made.select("page_id", urls.gallery_page_url("u", "n").alias("by_query"), urls.article_page_url("u", "n").alias("by_path"))


@query("t5_slide_url", """
select page_id, case when regexp_matches(u, '(https?://[^/]+)/photos-(index|slide)-aid-(\\d+)\\.html') then
  regexp_extract(u, '(https?://[^/]+)/photos-(index|slide)-aid-(\\d+)\\.html', 1) || '/photos-slide-aid-' ||
  regexp_extract(u, '(https?://[^/]+)/photos-(index|slide)-aid-(\\d+)\\.html', 3) || '.html' end as slide
from (select page_id, case page_id % 3 when 0 then url || '/photos-index-aid-' || page_id::varchar || '.html'
  when 1 then 'https://w.com/photos-slide-aid-' || page_id::varchar || '.html' when 2 then 'https://w.com/photos-index-aid-7.html' end as u from pages)""")
def t5(t):
    made = t.sql("""select page_id, case page_id % 3 when 0 then concat(url, '/photos-index-aid-', cast(page_id as string), '.html')
      when 1 then concat('https://w.com/photos-slide-aid-', cast(page_id as string), '.html') when 2 then 'https://w.com/photos-index-aid-7.html' end as u from pages""")
    return made.select("page_id", urls.slide_url("u").alias("slide"))


_REFS = ("//cdn.x.com/a.jpg", "/abs/b.png?x=1", "rel/c.gif", "../up/d.jpg", "./e.jpg", "?q=2", "#frag", "http://o.com/z/../f.jpg", "")


@query("t6_resolve_url", """
with r as (select page_id, url, regexp_extract(url, '^([a-z]+)://', 1) as sch, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p from pages),
d as (select *, sch || '://' || host as o, regexp_replace(p, '[^/]*$', '') as dir from r)
select page_id, unnest(['0', '1', '2', '3', '4', '5', '6', '7', '8']) as ref, unnest([sch || '://cdn.x.com/a.jpg', o || '/abs/b.png?x=1',
  o || dir || 'rel/c.gif', o || case when dir = '/' then '/' else regexp_replace(dir, '[^/]*/$', '') end || 'up/d.jpg', o || dir || 'e.jpg', o || p || '?q=2',
  regexp_replace(url, '#.*$', '') || '#frag', 'http://o.com/f.jpg', url]) as full_url from d""")
def t6(t):
    refs = F.array(*[F.struct(F.lit(str(i)).alias("ref"), F.lit(r).alias("raw")) for i, r in enumerate(_REFS)])
    made = t.pages.select("page_id", "url", F.explode(refs).alias("r")).select("page_id", "url", "r.*")
    return made.select("page_id", "ref", urls.resolve_url("url", "raw").alias("full_url"))


@query("t7_series_root", """
select file_id, regexp_replace(d, '/original(/[^/]*)?$', '') as root,
  regexp_replace(e, '/[^/]*$', '') as other from (select file_id, folder as d, replace(folder, 'original', 'src') as e from fx_file)""")
def t7(t):
    made = t.sql("select file_id, folder as d, replace(folder, 'original', 'src') as e from fx_file")
    return made.select("file_id", urls.series_root("d").alias("root"), urls.series_root("e").alias("other"))


@query("t8_output_name", """
select file_id, name as q100, case when lower(name) similar to '.*\\.(jpg|jpeg|webp)' then name else regexp_replace(name, '\\.[^.]*$', '') || '.jpg' end as q90
from fx_file""")
def t8(t):
    return t.fx_file.select("file_id", urls.output_name("name", 100).alias("q100"), urls.output_name("name", 90).alias("q90"))


# ---------------------------------------------------------------- cleaning


@query("t9_strip_artifacts", f"""
select seg_id, {S.artifacts('x', 'common')} as common, {S.artifacts('x', 'translate')} as translate, {S.artifacts('x', 'chat')} as chat,
  {S.artifacts('x', 'chat', True)} as kept
from (select seg_id, trans || case seg_id % 4 when 0 then ' <|3|>a </|4|> [INST]b' when 1 then '<|assistant|>' || chr(10) || chr(10) || chr(10) || 'z'
  when 2 then '</think>c</think> </s>  ' || chr(10) || '| </' else '' end as x from fx_seg)""")
def t9(t):
    made = t.sql("""select seg_id, concat(trans, case seg_id % 4 when 0 then ' <|3|>a </|4|> [INST]b'
      when 1 then concat('<|assistant|>', chr(10), chr(10), chr(10), 'z') when 2 then concat('</think>c</think> </s>  ', chr(10), '| </') else '' end) as x from fx_seg""")
    return made.select("seg_id", *[text.strip_artifacts("x", v).alias(v) for v in ("common", "translate", "chat")],
                       text.strip_artifacts("x", "chat", True).alias("kept"))


@query("t10_clean_watermark_lines", f"""
select id, {S.clean_marks('txt', 'translate', 'src')} as translate, {S.clean_marks('txt', 'common', 'src')} as common, {S.clean_marks('txt', 'chat')} as chat
from (select doc_id as id, text as txt, source as src from documents union all select -1 - seg_id, trans, src from fx_seg)""")
def t10(t):
    both = t.sql("select doc_id as id, text as txt, source as src from documents union all select -1 - seg_id, trans, src from fx_seg")
    return both.select("id", *[text.clean_watermark_lines("txt", "src", v).alias(v) for v in ("translate", "common", "chat")])


def _glued_sql(x: str) -> str:
    plain = S.artifacts(x)
    for e in ("\\r\\n", "\\n", "\\r", "/r/n", "/n", "/r"):
        plain = f"replace({plain}, {q(e)}, chr(10))"
    ls = f"list_transform(string_split_regex(_p, {q(S.EOL_RE)}), lambda a: rtrim(a, {S.WS}))"
    glue = (f"list_reduce(_l, lambda acc, b: case when {trim('b')} <> '' and length({trim('b')}) <= 2 and not regexp_matches(acc, '[!?.,:;-]$')"
            f" then acc || {trim('b')} else acc || chr(10) || b end)")
    return f"(select case when len(_l) > 1 then {glue} else _p end from (select _p, {ls} as _l from (select {plain} as _p)))"


@query("t11_normalize_newlines", f"select seg_id, {_glued_sql('trans')} as txt from fx_seg")
def t11(t):
    return t.fx_seg.select("seg_id", text.normalize_newlines("trans").alias("txt"))


def _word_sql(x: str, word: str, to: str, flags: str = "(?i)") -> str:
    w = S.WORDISH
    # twice, because neighbouring hits share a separator
    once = sub(x, rf"{flags}(^|[^{w}]){word}($|[^{w}])", rf"\1{to}\2")
    return sub(once, rf"{flags}(^|[^{w}]){word}($|[^{w}])", rf"\1{to}\2")


_SPELT = "x"
for _wrong, _right in L.SPELLING_FIXES:
    _SPELT = _word_sql(_SPELT, _wrong.replace("đ", "[đĐ]"), _right)


@query("t12_fix_vi_spelling", f"select seg_id, {_SPELT} as txt from (select seg_id, trans || ' Chu don ĐONG thoi mien chung' as x from fx_seg)")
def t12(t):
    made = t.sql("select seg_id, concat(trans, ' Chu don ĐONG thoi mien chung') as x from fx_seg")
    return made.select("seg_id", text.fix_vi_spelling("x").alias("txt"))


def _relation_sql(x: str, lang: str) -> str:
    return "case " + " ".join(f"when {has(x, p)} then '{n}'" for n, p in L.RELATIONSHIPS[lang]) + " end"


@query("t13_relationship", f"select seg_id, {_relation_sql('src', 'zh')} as zh, {_relation_sql('src', 'ja')} as ja from fx_seg")
def t13(t):
    return t.fx_seg.select("seg_id", text.relationship("src", "zh").alias("zh"), text.relationship("src", "ja").alias("ja"))


def _pronoun_sql(x: str) -> str:
    return _word_sql(_word_sql(x, "t[ôÔ]i", "con"), "em", "con")


@query("t14_apply_pronouns", f"select seg_id, case when seg_id % 3 = 0 then {_pronoun_sql('trans')} else trans end as txt from fx_seg")
def t14(t):
    rel = F.when(F.col("seg_id") % 3 == 0, "parent_child").otherwise("school")
    return t.fx_seg.select("seg_id", text.apply_pronouns("trans", rel).alias("txt"))


@query("t15_fix_pronoun_patterns", f"""select seg_id, {sub('trans', f'cầu xin anh.*con($|[^{S.WORDISH}])', 'con cầu xin anh' + chr(92) + '1')} as txt from fx_seg""")
def t15(t):
    return t.fx_seg.select("seg_id", text.fix_pronoun_patterns("trans").alias("txt"))


_HONOR = "x"
for _h in L.HONORIFICS:
    _HONOR = _word_sql(_HONOR, f"({_h})", "", "").replace(r"\1\2", r"\1\3")


@query("t16_drop_honorifics", f"""select seg_id, {_HONOR} as txt from (select seg_id, name || ' さん, 君! ' || src || ' 先生' as x from fx_seg)""")
def t16(t):
    return t.sql("select seg_id, concat(name, ' さん, 君! ', src, ' 先生') as x from fx_seg").select("seg_id", text.drop_honorifics("x").alias("txt"))


@query("t17_map_onomatopoeia", f"""
select seg_id, {S.replace_all('x', L.LAUGHTER)} as zh, {S.replace_all('x', L.SOUND_WORDS_JA)} as ja
from (select seg_id, src || ' 咯咯咯咯 ドキドキ ' || trans as x from fx_seg)""")
def t17(t):
    made = t.sql("select seg_id, concat(src, ' 咯咯咯咯 ドキドキ ', trans) as x from fx_seg")
    return made.select("seg_id", text.map_onomatopoeia("x", "zh").alias("zh"), text.map_onomatopoeia("x", "ja").alias("ja"))


_H = S.HAN_RE
OCR_SQL = sub(sub(sub(S.replace_all("src", L.OCR_REPAIRS), rf"({_H})[oO0]{{2,}}([^A-Za-z0-9oO0])", r"\1……\2"),
                  rf"({_H})[oO0]{{2,}}$", r"\1……"), rf"^[oO0]{{2,}}({_H})", r"……\1")


@query("t18_fix_ocr_source", f"select seg_id, {OCR_SQL} as txt from fx_seg")
def t18(t):
    return t.fx_seg.select("seg_id", text.fix_ocr_source("src").alias("txt"))


_VOCAB_NAMES = list(dict.fromkeys(n for _, n in L.REALMS))


@query("t19_fix_closed_vocab")
def t19(t):
    return t.fx_seg.select("seg_id", text.fix_closed_vocab("src", "trans").alias("txt"))


@query("t20_apply_rules", r"""select doc_id, x as txt, x <> text as changed from (select doc_id, text,
  regexp_replace(regexp_replace(regexp_replace(text, '(the|The) (\w+)', '\2 \1', 'g'), 'qu[ei]', 'k', 'g'), '[0-9]+', '', 'g') as x from documents)""")
def t20(t):
    fixed = text.apply_rules("text", [(r"(the|The) (\w+)", "$2 $1"), ("qu[ei]", "k"), ("[0-9]+", "")])
    return t.documents.select("doc_id", fixed.alias("txt"), (fixed != F.col("text")).alias("changed"))


@query("t21_repair_brackets")
def t21(t):
    both = t.sql("""select doc_id as id, concat(text, ' (a ]b', chr(39), ' 【c) 」') as txt from documents
                    union all select -1 - seg_id, concat(src, trans) from fx_seg""")
    return both.select("id", text.repair_brackets("txt").alias("txt"))


_QUOTED_SRC = "case seg_id % 5 when 0 then concat('「', name, '」', src) when 1 then concat('『', name, '』') when 2 then concat('【', name, '】(a)') when 3 then concat('(', name, ')[') else src end"
_QUOTED_TRANS = "case seg_id % 3 when 0 then concat('\"', name, '\" á') when 1 then concat('“', name, '” [x] (y)') else trans end"


def _harmonise_sql() -> str:
    n = lambda x, c: f"(length({x}) - length(replace({x}, {q(c)}, '')))"
    cases = []
    for a, b in ("『』", "「」", "【】"):
        agree = f"({n('s', a)} = {n('o', chr(34))} or {n('s', a)} = {n('o', '＂')}) and o <> '' and regexp_matches(o, '[^\\x00-\\x7f]')"
        fixed = sub("o", '"([^"]*)"', f"{a}\\1{b}")
        cases.append(f"when contains(s, '{a}') and contains(s, '{b}') then case when {agree} then {fixed} else o end")
    sql = f"select seg_id, s, case {' '.join(cases)} else o end as o from (select seg_id, {_QUOTED_SRC} as s, {_QUOTED_TRANS} as o from fx_seg)"
    for fam in L.QUOTE_FAMILIES:
        others = " + ".join(n("s", c) for c in fam[1:])
        seen = " + ".join(n("o", c) for c in fam)
        sql = (f"select seg_id, s, case when {n('s', fam[0])} > 0 and {n('s', fam[0])} <> ({others}) and {n('s', fam[0])} = ({seen})"
               f" then {S.replace_all('o', [(c, fam[0]) for c in fam[1:]])} else o end as o from ({sql})")
    return f"select seg_id, {S.replace_all('o', L.QUOTE_FORCED)} as txt from ({sql})"


@query("t22_harmonise_quotes", _harmonise_sql())
def t22(t):
    made = t.sql(f"select seg_id, {_QUOTED_SRC} as s, {_QUOTED_TRANS} as o from fx_seg")
    return made.select("seg_id", text.harmonise_quotes("s", "o").alias("txt"))


def _markers_sql(x: str) -> str:
    fixed = sub(x, r"<\|?(\d+)\|?>", r"<|\1|>")
    for e in ("\\r\\n", "\\n", "\\r", "/r/n", "/n", "/r"):
        fixed = f"replace({fixed}, {q(e)}, chr(10))"
    parts = f"string_split_regex('pre_1' || chr(10) || _f, {q('<' + chr(92) + '|[^|]+' + chr(92) + '|>')})"
    return f"(select case when len(_s) > 1 then _s[2:] else [_f] end from (select _f, {parts} as _s from (select {fixed} as _f)))"


@query("t23_split_markers", f"select reply_id, len(a)::bigint as n, array_to_string(a, '¦') as parts from (select reply_id, {_markers_sql('raw')} as a from fx_reply)")
def t23(t):
    made = t.fx_reply.select("reply_id", text.split_markers("raw").alias("a"))
    return made.select("reply_id", big(F.size("a")).alias("n"), F.array_join("a", "¦").alias("parts"))


@query("w16_align_slots", f"""
select reply_id, array_to_string((p || list_transform(range(greatest(n_expected - len(p), 0)), lambda i: ''))[1:n_expected], '¦') as slots
from (select reply_id, n_expected, case when len(a) <= 1 and n_expected > 1 then string_split(raw, chr(10)) else a end as p
      from (select *, {_markers_sql('raw')} as a from fx_reply))""")
def w16(t):
    made = t.fx_reply.withColumn("a", text.split_markers("raw"))
    return made.select("reply_id", F.array_join(text.align_slots("a", "raw", "n_expected"), "¦").alias("slots"))


@query("t24_take_kind_tag", rf"""
select seg_id, nullif(lower(regexp_extract(trans, '(?i)^\s*\[\s*(speech|thought|moan|shout|narration|sfx|anger|fear|title)\s*\]', 1)), '') as kind,
  {S.retag('trans')} as rest from fx_seg""")
def t24(t):
    return t.fx_seg.select("seg_id", text.kind_tag("trans").alias("kind"), text.without_kind_tag("trans").alias("rest"))


def _unquoted(x: str) -> str:
    return trim(f"trim({trim(x)}, {q(L.WRAPPING_QUOTES)})")


@query("t25_strip_outer_quotes", f"select seg_id, {_unquoted('trans')} as txt, {_unquoted('src')} as src_txt from fx_seg")
def t25(t):
    return t.fx_seg.select("seg_id", text.strip_outer_quotes("trans").alias("txt"), text.strip_outer_quotes("src").alias("src_txt"))


@query("t26_ensure_terminal_punct", f"select seg_id, {S.terminal('trans')} as txt, {S.terminal('src')} as src_txt from fx_seg")
def t26(t):
    return t.fx_seg.select("seg_id", text.ensure_terminal_punct("trans").alias("txt"), text.ensure_terminal_punct("src").alias("src_txt"))


def _posted_sql() -> str:
    rel = _relation_sql("src", "zh")
    inner = f"case when {rel} = 'parent_child' and {trim('_x')} <> '' then {_pronoun_sql('_x')} else _x end"
    cleaned = f"(select {S.clean_marks('_y', 'translate', 'src')} from (select {inner} as _y))"
    body = f"case when {S.watermark('_x', 'translate')} or {S.watermark('src', 'translate')} then '' else {cleaned} end"
    return f"case when {trim('trans')} = '' then trans else (select {body} from (select {S.artifacts('trans')} as _x)) end"


@query("t28_post_process", f"select seg_id, {_posted_sql()} as txt from fx_seg")
def t28(t):
    return t.fx_seg.select("seg_id", text.post_process("trans", "src").alias("txt"))


@query("t28_comprehensive", f"""
select seg_id, case when {trim('trans')} = '' then trans else (select {S.clean_marks('_y', 'translate', 'src')} from (select
  {sub(S.artifacts('trans'), f'cầu xin anh.*con($|[^{S.WORDISH}])', 'con cầu xin anh' + chr(92) + '1')} as _y)) end as txt from fx_seg""")
def t28b(t):
    return t.fx_seg.select("seg_id", text.comprehensive_post_process("trans", "src").alias("txt"))


@query("t29_count_text_length", f"""select seg_id, length({trim('x')}) - 0.5::double * {S.count(trim('x'), '[っッぁぃぅぇぉ]')} as len from
  (select seg_id, ' っ' || src || 'ぁぁ ' as x from fx_seg)""")
def t29(t):
    return t.sql("select seg_id, concat(' っ', src, 'ぁぁ ') as x from fx_seg").select("seg_id", text.count_text_length("x").cast("double").alias("len"))


@query("t30_script_char_count", f"""select id, {S.count('x', S.HAN_RE)} as zh, {S.count('x', '[' + chr(92) + 'x{3040}-' + chr(92) + 'x{30ff}' + chr(92) + 'x{4e00}-' + chr(92) + 'x{9fff}]')} as ja
  from (select doc_id as id, text as x from documents union all select -1 - seg_id, src from fx_seg)""")
def t30(t):
    both = t.sql("select doc_id as id, text as x from documents union all select -1 - seg_id, src from fx_seg")
    return both.select("id", predicates.script_char_count("x").alias("zh"), predicates.script_char_count("x", "japanese").alias("ja"))


@query("t31_list_breaks", rf"""select seg_id, ltrim(regexp_replace(regexp_replace(trans, '[{S.WS_RE}]+(\d{{1,2}}[.)、．])[{S.WS_RE}]+([^{S.WS_RE}])', chr(10) || '\1 \2', 'g'),
  '^(\d{{1,2}}[.)、．])[{S.WS_RE}]+([^{S.WS_RE}])', chr(10) || '\1 \2'), chr(10)) as txt from fx_seg""")
def t31(t):
    return t.fx_seg.select("seg_id", text.list_breaks("trans").alias("txt"))


@query("t32_repeat_unit", """
select seg_id, coalesce(list_filter(list_transform(range(1, length(x) // 2 + 1), lambda i: left(x, i::bigint)),
  lambda u: left(repeat(u, length(x) // length(u) + 1), length(x)) = x)[1], x) as unit
from (select seg_id, case when seg_id % 3 = 0 then left(repeat(name, 4), length(name) * 3 + 2) when seg_id % 3 = 1 then repeat('ab', (seg_id % 7)::int) else name end as x from fx_seg)""")
def t32(t):
    made = t.sql("""select seg_id, case when seg_id % 3 = 0 then left(repeat(name, 4), length(name) * 3 + 2)
      when seg_id % 3 = 1 then repeat('ab', cast(seg_id % 7 as int)) else name end as x from fx_seg""")
    return made.select("seg_id", text.repeat_unit("x").alias("unit"))


@query("t33_replace_prefix", "select seg_id, case when name like 'red%' then 'blue' || substr(name, 4) else name end as txt from fx_seg")
def t33(t):
    return t.fx_seg.select("seg_id", text.replace_prefix("name", "red", "blue").alias("txt"))


@query("t34_apply_case", "select seg_id, upper(name) as up, lower(brand) as low, trans as same from fx_seg")
def t34(t):
    return t.fx_seg.select("seg_id", text.apply_case("name", True, True).alias("up"), text.apply_case("brand", lowercase=True).alias("low"),
                           text.apply_case("trans").alias("same"))


@query("t35_content_key", """
select file_id, md5(name || '|m|zh') as text_key, sha256(folder || '/' || name) as digest,
  sha1(folder || '/' || name || '|' || epoch(mtime)::bigint::varchar || '|' || length::varchar) as thumb from fx_file""")
def t35(t):
    path = F.concat("folder", F.lit("/"), "name")
    mtime = F.unix_timestamp(F.col("mtime").cast("timestamp"))
    return t.fx_file.select("file_id", text.content_key("name", "m", "zh").alias("text_key"), F.sha2(path, 256).alias("digest"),
                            text.thumb_key(path, mtime, "length").alias("thumb"))


@query("t36_norm_term", f"select term_id, nfc_normalize({trim('x')}) as zh from (select term_id, ' ' || zh || 'e' || chr(769) || ' ' as x from fx_term)")
def t36(t):
    from pageloom.operators.terms import normalized

    made = t.sql("select term_id, concat(' ', zh, 'é', ' ') as x from fx_term")
    return normalized(made, "x", "zh").select("term_id", "zh")


def _kind_sql() -> str:
    t = trim("coalesce(trans, '')")
    k, s = "coalesce(kind, '')", "coalesce(shape, '')"
    caps = (f"{S.count(t, chr(92) + 'p{L}')} >= 2 and length({t}) <= 14 and not {has(t, '[' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lo}' + chr(92) + 'p{Lm}' + chr(92) + 'p{Lt}]')}"
            f" and {k} in ('', 'speech', 'shout')")
    return f"""case when {k} = 'fear' then 'fear' when {k} = 'anger' then 'anger'
  when {has(t, '[!！]{2,}|[?？][!！]|[!！][?？]')} or ({caps}) or {k} = 'shout' or {s} = 'burst' then 'shout'
  when {k} = 'moan' then 'moan' when {k} = 'sfx' then 'sfx' when {s} = 'rect' or {k} = 'narration' then 'narration'
  when {s} = 'cloud' or {k} = 'thought' then 'thought' when not on_bubble and {k} = '' and length({t}) <= 14 then 'sfx' else 'normal' end"""


@query("t38_dialogue_kind", f"select seg_id, {_kind_sql()} as dialogue from (select * replace (case when seg_id % 5 = 0 then upper(name) when seg_id % 7 = 0 then trans || '!!' else trans end as trans) from fx_seg)")
def t38(t):
    made = t.fx_seg.withColumn("trans", F.expr("case when seg_id % 5 = 0 then upper(name) when seg_id % 7 = 0 then concat(trans, '!!') else trans end"))
    return made.select("seg_id", text.dialogue_kind("trans", "kind", "shape", "on_bubble").alias("dialogue"))


@query("t39_hex_color", f"""
select region_no, case when {has("ltrim(trim(coalesce(flat_color, '')), '#')", '^[0-9a-fA-F]{6}$')} then '#' || lower(ltrim(trim(flat_color), '#')) end as flat,
  case when {has("ltrim(trim(coalesce(text_color, '')), '#')", '^[0-9a-fA-F]{6}$')} then ('0x' || substr(text_color, 1, 2))::bigint end as r from fx_region""")
def t39(t):
    return t.fx_region.select("region_no", text.hex_color("flat_color").alias("flat"), text.hex_to_rgb(text.hex_color("text_color"))["r"].cast("bigint").alias("r"))


@query("t40_capture_groups", f"""
select doc_id, nullif({trim("array_to_string(flatten(list_transform(range(1, len(a) + 1), lambda i: [a[i], b[i]])), chr(10))")}, '') as txt
from (select doc_id, regexp_extract_all(text, '(?s)(\\d+)([a-z.])', 1) as a, regexp_extract_all(text, '(?s)(\\d+)([a-z.])', 2) as b from documents)""")
def t40(t):
    return t.documents.select("doc_id", text.capture_groups("text", r"(\d+)([a-z.])", 2).alias("txt"))


# ---------------------------------------------------------------- replies


def _boxes_sql() -> str:
    c = lambda v, top: f"greatest(0.0, least({v}, {top}))"
    b = [f"try_cast(json_extract_string(j, '$.bbox[{i}]') as double)" for i in range(4)]
    return f"""
with items as (select reply_id, w, h, unnest(from_json(m, '["json"]')) as j from (
  select reply_id, w, h, nullif(regexp_extract(raw, '(?s)\\[.*\\]'), '') as m from fx_reply) where json_valid(m) and json_type(m) = 'ARRAY'),
parts as (select reply_id, w, h, trim(coalesce(json_extract_string(j, '$.text'), '')) as text, json_array_length(j, '$.bbox') as n,
  {', '.join(f'{c(b[i], "w" if i % 2 == 0 else "h")} as b{i}' for i in range(4))} from items where json_type(j) = 'OBJECT')
select reply_id, text, least(b0, b2)::double as x1, least(b1, b3)::double as y1, greatest(b0, b2)::double as x2, greatest(b1, b3)::double as y2
from parts where n = 4 and text <> '' and greatest(b0, b2) - least(b0, b2) >= 3 and greatest(b1, b3) - least(b1, b3) >= 3"""


@query("n1_parse_box_json", _boxes_sql())
def n1(t):
    made = t.fx_reply.select("reply_id", F.explode(parsing.page_boxes("raw", "w", "h")).alias("b"))
    return made.select("reply_id", "b.text", "b.box.*")


@query("n2_parse_string_array")
def n2(t):
    made = t.fx_reply.select("reply_id", parsing.reply_texts("raw", F.lit(2)).alias("a"))
    return made.filter(F.col("a").isNotNull()).select("reply_id", F.array_join("a", "¦").alias("texts"))


def _arrows_sql(keep: str) -> str:
    return f"""
select reply_id, zh, arg_{keep}(vi, n) as vi from (select reply_id, n, {trim("substr(l, 1, strpos(l, s) - 1)")} as zh,
  {trim("substr(l, strpos(l, s) + length(s))")} as vi
from (select reply_id, n, l, case when contains(l, '=>') then '=>' when contains(l, '→') then '→' when contains(l, '：') then '：' when contains(l, ':') then ':' end as s
from (select reply_id, n, {trim("ltrim(" + trim('l') + ", '-*0123456789.) ')")} as l
from (select reply_id, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as n from (select reply_id, string_split_regex(raw, {q(S.EOL_RE)}) as ls from fx_reply)))))
where zh <> '' and vi <> '' group by 1, 2"""


@query("n5_parse_arrow_lines", _arrows_sql("max"))
def n5(t):
    from pageloom.operators.terms import arrow_terms

    return arrow_terms(t.fx_reply, "reply_id", "raw", last_wins=True)


@query("n6_parse_yes_no", r"""
select reply_id, k from (select reply_id, k, arg_min(yes, n) as yes from (select reply_id, n, try_cast(regexp_extract(l, '^\s*(\d+)', 1) as int) as k,
  regexp_matches(l, '(?i)^\s*\d+\s*[:.)-]?\s*YES\b') as yes
from (select reply_id, unnest(ls) as l, unnest(range(len(ls))) as n from (select reply_id, string_split(raw, chr(10)) as ls from fx_reply))
where regexp_matches(l, '(?i)^\s*\d+\s*[:.)-]?\s*(YES|NO)\b')) group by 1, 2) where yes and k is not null""")
def n6(t):
    return t.fx_reply.select("reply_id", F.explode(parsing.yes_numbers("raw")).alias("k"))
