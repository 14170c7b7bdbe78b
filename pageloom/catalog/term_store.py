"""Term store: reading, combining, mutating."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.catalog import sql_parts as S
from pageloom.catalog.registry import query
from pageloom.catalog.sql_parts import q, trim
from pageloom.functions import lexicon as L
from pageloom.functions import parsing
from pageloom.operators import segments, terms
from pageloom.plans.ordered import dense_position
from pageloom.sources import glossary, snapshots

NOW = 1735689600
big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


def store(t):
    """fx_store with the snapshot's types."""
    return t.fx_store.select("term_id", "zh", "vi", "enabled", F.array("source").alias("sources"),
                             F.timestamp_seconds("created_s").alias("created"), F.timestamp_seconds("updated_s").alias("updated"))


def now():
    return F.timestamp_seconds(F.lit(NOW))


def flat(df):
    """Comparable columns of a snapshot."""
    return df.select("term_id", "zh", "vi", "enabled", F.array_join("sources", "|").alias("sources"),
                     F.unix_timestamp("created").alias("created_s"), F.unix_timestamp("updated").alias("updated_s"))


_HAS_HAN = S.has("zh", S.HAN_RE)
_STOP = "(" + ", ".join(q(w) for w in L.STOPWORDS) + ")"
_LINES = f"""(select series_id, line_no, t, b, strpos(b, '=>') as cut, keep from (select series_id, line_no, t, keep,
  case when keep then rtrim(left(t, length(t) - 5), {S.WS}) else t end as b
  from (select series_id, line_no, {trim('line')} as t, lower({trim('line')}) like '%@keep' as keep from fx_term_line)))"""
_TERMS = f"""(select series_id, zh, arg_min(vi, line_no) as vi, min(line_no) as line_no from (select series_id, line_no, keep,
  {trim("substr(b, 1, cut - 1)")} as zh, {trim("substr(b, cut + 2)")} as vi from {_LINES}
  where cut > 0 and t not like '#%' and lower(t) not like '@note%') where zh <> '' and vi <> ''
  and (keep or ({_HAS_HAN} and zh not in {_STOP} and length({trim('zh')}) >= 2)) group by 1, 2)"""
_NOTES = f"""(select series_id, line_no, trim(substr(t, 6), ' :' || chr(9)) as note from {_LINES} where lower(t) like '@note%')"""


@query("s5_read_glossary_file", f"select series_id, 'term' as kind, line_no, zh, vi from {_TERMS} union all select series_id, 'note', line_no, note, '' from {_NOTES} where note <> ''")
def s5(t):
    lines = t.fx_term_line
    got = glossary.glossary_terms(lines).withColumn("kind", F.lit("term"))
    notes = glossary.glossary_notes(lines).select("series_id", F.lit("note").alias("kind"), "line_no", F.col("note").alias("zh"), F.lit("").alias("vi"))
    return got.unionByName(notes)


@query("s6_extract_glossary_pairs", f"""
select series_id, line_no, {trim("substr(t, 1, strpos(t, '=>') - 1)")} as zh, {trim("substr(t, strpos(t, '=>') + 2)")} as vi from {_LINES}
where contains(t, '=>') and t not like '#%' and lower(t) not like '@note%'""")
def s6(t):
    return glossary.glossary_pairs(t.fx_term_line)


_RULES = """select part.p_partkey % 40 as series_id, p_partkey as line_no, case p_partkey % 8 when 0 then '# c' when 1 then '// c' when 2 then ''
  when 3 then concat(p_name, ' more # x') when 4 then concat(p_brand, ' x // y') when 5 then p_brand else p_name end as line from part"""


@query("s7_read_rule_dictionary", f"""
select series_id, line_no as rule_no, p[1] as pattern, coalesce(p[2], '') as replacement, len(p) in (1, 2) as accepted from (
  select *, list_filter(string_split_regex({trim("string_split(trim(string_split(line, '#')[1]), '//')[1]")}, '\\s+'), lambda x: x <> '') as p
  from ({_RULES}) where trim(line) <> '' and trim(line) not like '#%' and trim(line) not like '//%')""")
def s7(t):
    return glossary.rule_lines(t.sql(_RULES))


@query("s8_read_terms", "select term_id, zh, vi, enabled, source as sources, created_s, updated_s from fx_store")
def s8(t):
    path = snapshots.scratch_path(t.spark, "terms")
    snapshots.write_snapshot(store(t), path)
    return flat(snapshots.read_terms(t.spark, path))


_URLS = "select page_id, concat(' ', url, chr(10), 'ftp://x,', url, ';; https://a.com/', cast(page_id as string), chr(13), chr(10), 'http://b.com ', ',', url) as raw from pages"


@query("s9_parse_url_list", f"""
select page_id, url, min(n) as ord from (select page_id, {trim('unnest(a)')} as url, unnest(range(len(a))) as n from (
  select page_id, string_split_regex(raw, '[\\r\\n,;]+') as a from ({_URLS}))) where regexp_matches(url, '^https?://') group by 1, 2""")
def s9(t):
    return glossary.url_list(t.sql(_URLS), "page_id", "raw")


@query("s10_write_term_snapshot")
def s10(t):
    path = snapshots.scratch_path(t.spark, "versions")
    snapshots.write_snapshot(store(t), path)
    current = snapshots.read_terms(t.spark, path)
    snapshots.write_snapshot(terms.set_enabled(current, current.filter(F.col("term_id") % 2 == 0), True, now()), path)
    return flat(snapshots.read_terms(t.spark, path))


@query("s11_append_learned_terms")
def s11(t):
    path = snapshots.scratch_path(t.spark, "lines")
    found = glossary.glossary_terms(t.fx_term_line)
    glossary.append_terms(found.filter(F.col("line_no") % 2 == 0), path)
    glossary.append_terms(found.filter(F.col("line_no") % 2 == 1), path)
    return t.spark.read.schema("value string, series_id bigint").text(path)


@query("f11_learnable_terms", f"select pos, zh, vi from (select pos, case pos % 5 when 0 then '妈妈' when 1 then '王' when 2 then vi when 3 then '安 全' else zh end as zh, vi from fx_pair) where zh <> '' and {_HAS_HAN} and zh not in {_STOP} and length(zh) >= 2")
def f11(t):
    made = t.sql("select pos, case pos % 5 when 0 then '妈妈' when 1 then '王' when 2 then vi when 3 then '安 全' else zh end as zh, vi from fx_pair")
    return terms.learnable_terms(made).select("pos", "zh", "vi")


@query("a1_term_counts", "select count(*)::bigint as total, count(*) filter (enabled)::bigint as enabled, count(*) filter (not enabled)::bigint as pending from fx_store")
def a1(t):
    return terms.term_counts(store(t))


_DUP = "select term_id, case when term_id % 2 = 0 then concat(' ', zh_han, ' ') else zh_han end as zh, vi, enabled, source, created_s, updated_s from fx_term"


def _dup(t):
    return t.sql(_DUP).select("term_id", "zh", "vi", "enabled", F.array(F.col("source"), F.concat(F.lit("s"), (F.col("term_id") % 3).cast("string"))).alias("sources"),
                              F.timestamp_seconds("created_s").alias("created"), F.timestamp_seconds("updated_s").alias("updated"))


@query("a2_dedup_terms", f"""
with d as (select *, trim(zh) as k, row_number() over (partition by trim(zh) order by enabled desc, term_id) as rn from ({_DUP})),
e as (select k, rn, 0 as i, source as s from d union all select k, rn, 1, 's' || (term_id % 3)::varchar from d),
u as (select k, s, min(rn * 2 + i) as o from e group by 1, 2), a as (select k, string_agg(s, '|' order by o) as sources from u group by 1),
n as (select k, count(*) as n from d group by 1)
select term_id, k as zh, vi, enabled, sources, created_s, case when n > 1 or zh <> k then {NOW} else updated_s end as updated_s
from d join a using (k) join n using (k) where rn = 1""")
def a2(t):
    return flat(terms.dedup_terms(_dup(t), now()))


@query("a2_dedup_report", "select (count(*) - count(distinct trim(zh_han)))::bigint as merged, count(distinct trim(zh_han))::bigint as total from fx_term")
def a2b(t):
    return terms.dedup_report(_dup(t))


@query("a9_glossary_line_counts", f"""select series_id, count(*) filter (contains(t, '=>') and t not like '#%' and lower(t) not like '@note%')::bigint as terms,
  count(*) filter (lower(t) like '@note%')::bigint as notes from {_LINES} group by 1""")
def a9(t):
    return glossary.glossary_line_counts(t.fx_term_line)


@query("a16_merge_sources", """select term_id, case when enabled then '' else 'x|' end || case when term_id % 4 = 0 and not enabled then 'y' else
   case when enabled then source else 'y|' || source end end as sources from fx_store""")
def a16(t):
    raw = F.when(F.col("enabled"), F.lit("{broken")).otherwise(F.lit('["x","y"]'))
    made = t.fx_store.select("term_id", "enabled", parsing.sources_array(raw).alias("sources"),
                             F.when((F.col("term_id") % 4 == 0) & ~F.col("enabled"), "y").otherwise(F.col("source")).alias("source"))
    return terms.add_source(made).select("term_id", F.array_join("sources", "|").alias("sources"))


@query("n7_sources_array", "select term_id, case when enabled then source || '|a' else '' end as sources, case when enabled then 2 else 0 end::bigint as n from fx_store")
def n7(t):
    raw = F.when(F.col("enabled"), F.concat(F.lit('["'), "source", F.lit('","a"]'))).otherwise("not json")
    made = t.fx_store.select("term_id", parsing.sources_array(raw).alias("a"))
    return made.select("term_id", F.array_join("a", "|").alias("sources"), big(F.size("a")).alias("n"))


@query("o2_longest_first", "select term_id, zh, row_number() over (order by length(zh) desc, term_id)::bigint as place from fx_store")
def o2(t):
    from pageloom.plans.ordered import any_order_position

    made = t.fx_store.select("term_id", "zh").withColumn("_all", F.lit(0))
    return any_order_position(made, ["_all"], [-F.length("zh"), F.col("term_id")], "place").drop("_all")


@query("o3_list_terms", "select term_id, zh, vi, enabled from fx_store where (zh ilike '%Ring%' or vi ilike '%Ring%') and not enabled")
def o3(t):
    return terms.list_terms(store(t), "Ring", "pending").select("term_id", "zh", "vi", "enabled")


@query("o8_limit_prompt_terms", f"select series_id, zh, vi, line_no from (select *, row_number() over (partition by series_id order by length(zh) desc, line_no) as rn from {_TERMS}) where rn <= 3")
def o8(t):
    return terms.limit_prompt_terms(glossary.glossary_terms(t.fx_term_line), k=3).select("series_id", "zh", "vi", "line_no")


@query("t41_prompt_block", f"""
with p as (select series_id, 1 as part, -length(zh) as o, line_no, '  ' || zh || ' → ' || vi as txt from {_TERMS}
  qualify row_number() over (partition by series_id order by length(zh) desc, line_no) <= 200
  union all select series_id, 2, 0, line_no, '  - ' || note from {_NOTES} where note <> '' qualify row_number() over (partition by series_id order by line_no) <= 40
  union all select distinct series_id, 2, -1, 0, {q(L.PROMPT_BLOCK_NOTES)} from {_NOTES} where note <> '')
select series_id, {q(L.PROMPT_BLOCK_HEAD)} || chr(10) || string_agg(txt, chr(10) order by part, o, line_no) as block from p group by 1""")
def t41(t):
    return terms.prompt_blocks(glossary.glossary_terms(t.fx_term_line), glossary.glossary_notes(t.fx_term_line))


_PER = "select zh, concat(vi, ' own') as vi from fx_store where term_id % 4 = 0"
_MERGED = f"select zh, vi from ({_PER}) union all select zh, vi from fx_store where enabled and zh not in (select zh from ({_PER}))"


@query("j5_merge_term_sets", _MERGED)
def j5(t):
    return terms.precedence_union(t.sql(_PER), terms.load_enabled(store(t)).select("zh", "vi"), ["zh"])


@query("u1_precedence_union", _MERGED)
def u1(t):
    return terms.precedence_union(t.sql(_PER), t.sql("select zh, vi from fx_store where enabled"), ["zh"])


_SUGGEST = "select zh, case when term_id % 6 = 0 then '' when term_id % 4 = 0 then vi else concat(vi, ' new') end as new from fx_store where term_id % 5 <> 0"


@query("j7_suggestion_diff", f"""
select term_id, zh, vi as old, coalesce(nullif(new, ''), vi) as new, coalesce(nullif(new, ''), vi) <> vi as changed, nullif(new, '') is null as missing, term_id as pos
from fx_store left join ({_SUGGEST}) using (zh)""")
def j7(t):
    return terms.suggestion_diff(t.fx_store.select("term_id", "zh", "vi", F.col("term_id").alias("pos")), t.sql(_SUGGEST))


@query("o7_changed_first", f"""
select term_id, changed, row_number() over (order by changed desc, term_id)::bigint as place from (
 select term_id, coalesce(nullif(new, ''), vi) <> vi as changed from fx_store left join ({_SUGGEST}) using (zh))""")
def o7(t):
    from pageloom.plans.ordered import any_order_position

    diff = terms.suggestion_diff(t.fx_store.select("term_id", "zh", "vi", F.col("term_id").alias("pos")), t.sql(_SUGGEST))
    placed = any_order_position(diff.withColumn("_all", F.lit(0)), ["_all"], [~F.col("changed"), F.col("pos")], "place")
    return placed.select("term_id", "changed", "place")


@query("u2_new_terms_except", "select pos, zh, vi from fx_pair where zh not in (select zh from fx_store)")
def u2(t):
    return terms.except_keys(t.fx_pair, t.fx_store, ["zh"]).select("pos", "zh", "vi")


@query("u3_intersect_ids", "select term_id, zh from fx_store where term_id in (select p_partkey from part where p_size < 20)")
def u3(t):
    asked = t.part.filter("p_size < 20").select(F.col("p_partkey").alias("term_id"))
    return terms.intersect_ids(asked, store(t)).select("term_id", "zh")


_NEW = "select zh, min(pos) as pos, arg_min(vi, pos) as v0, arg_max(vi, pos) as v1, arg_max(enabled, pos) as e1 from fx_pair group by 1"
_SRC = "select zh, string_agg(source, '|' order by p) as srcs, list(source order by p) as l from (select zh, source, min(pos) as p from fx_pair group by 1, 2) group by 1"
_JOINED = "case when srcs is null then s.source else array_to_string([s.source] || list_filter(l, lambda x: x <> s.source), '|') end"


def _mutated(overwrite: bool, enabled: str = "e1") -> str:
    vi = "coalesce(v1, s.vi)" if overwrite else "s.vi"
    en = f"case when n.zh is null then s.enabled else {enabled} end" if overwrite else "s.enabled"
    up = f"case when n.zh is null then s.updated_s else {NOW} end" if overwrite else "s.updated_s"
    return f"""with n as ({_NEW}), r as ({_SRC}), top as (select max(term_id) as m from fx_store)
select s.term_id, s.zh, {vi} as vi, {en} as enabled, {_JOINED} as sources, s.created_s, {up} as updated_s
from fx_store s left join n on s.zh = n.zh left join r on s.zh = r.zh union all
select m + row_number() over (order by pos), n.zh, {'v1' if overwrite else 'v0'}, {enabled if overwrite else 'false'}, srcs, {NOW}, {NOW}
from n join r on n.zh = r.zh, top where n.zh not in (select zh from fx_store)"""


def mutated_by(pairs: str) -> str:
    """The store after learning from a table of pairs, without the ``with`` in front."""
    return _mutated(False).replace("fx_pair", pairs).removeprefix("with ")


@query("m1_learn_pending", _mutated(False))
def m1(t):
    return flat(terms.learn_pending(store(t), t.fx_pair, now()))


@query("m2_upsert_terms", _mutated(True))
def m2(t):
    return flat(terms.upsert_terms(store(t), t.fx_pair, now()))


@query("m6_promote_terms", _mutated(True, "true"))
def m6(t):
    return flat(terms.promote_terms(store(t), t.fx_pair, now()))


@query("m7_import_terms", _mutated(False).replace("source, min(pos) as p from fx_pair", "'b' as source, min(pos) as p from fx_pair"))
def m7(t):
    return flat(terms.import_terms(store(t), t.fx_pair.withColumn("folder", F.lit("/a/b/c.txt")), now(), enabled=False))


_EDITS = """select term_id, term_id as pos, case when term_id % 2 = 1 then concat(zh, '改') else lead(zh, 1, zh) over (order by term_id) end as zh, concat(vi, '!') as vi
  from fx_store where term_id % 5 = 0"""


@query("m3_rename_term")
def m3(t):
    edits = t.fx_store.filter("term_id % 5 = 0").select(
        "term_id", F.col("term_id").alias("pos"), F.concat("zh", F.lit("改")).alias("zh"), F.concat("vi", F.lit("!")).alias("vi"))
    taken = t.fx_store.filter("term_id % 7 = 0 and term_id % 5 <> 0").select(
        "term_id", F.col("term_id").alias("pos"), F.concat(F.lit("宗"), F.col("vi")).alias("zh"), F.concat("vi", F.lit("?")).alias("vi"))
    return flat(terms.rename_terms(store(t), edits.unionByName(taken), now()))


@query("m4_set_enabled", f"""select term_id, zh, vi, enabled or term_id % 4 = 0 as enabled, source as sources, created_s,
  case when term_id % 4 = 0 then {NOW} else updated_s end as updated_s from fx_store""")
def m4(t):
    return flat(terms.set_enabled(store(t), t.fx_store.filter("term_id % 4 = 0"), True, now()))


@query("m5_delete_terms", "select term_id, zh, vi, enabled, source as sources, created_s, updated_s from fx_store where term_id not in (select p_partkey from part where p_size < 10)")
def m5(t):
    return flat(terms.delete_terms(store(t), t.part.filter("p_size < 10").select(F.col("p_partkey").alias("term_id"))))


@query("m8_load_enabled_terms", "select term_id, zh, vi from fx_store where enabled and zh <> '' and vi <> ''")
def m8(t):
    return terms.load_enabled(store(t))


@query("m9_fold_learned", f"""
with per as ({_PER}), added as (select zh, min(pos) as pos, arg_min(vi, pos) as vi from fx_pair where zh not in (select zh from per) group by 1),
known as (select zh, vi from per union all select zh, vi from added)
select 'appended' as part, zh, vi from added union all select 'merged', zh, vi from known
union all select 'merged', zh, vi from fx_store where enabled and zh not in (select zh from known)
union all select 'store', zh, vi from fx_store union all
select 'store', zh, arg_min(vi, pos) from fx_pair where zh not in (select zh from fx_store) group by 1, 2""")
def m9(t):
    parts = terms.fold_learned(t.sql(_PER), store(t), t.fx_pair, now())
    return parts["appended"].select(F.lit("appended").alias("part"), "zh", "vi").unionByName(
        parts["merged"].select(F.lit("merged").alias("part"), "zh", "vi")).unionByName(
        parts["store"].select(F.lit("store").alias("part"), "zh", "vi"))


@query("m10_apply_suggestions", f"""
select term_id, zh, case when term_id % 3 = 0 and term_id % 2 = 0 then vi || '+' else vi end as vi, enabled, source as sources, created_s,
  case when term_id % 3 = 0 and term_id % 2 = 0 then {NOW} else updated_s end as updated_s from fx_store""")
def m10(t):
    chosen = t.sql("select term_id, term_id as pos, case when term_id % 2 = 0 then concat(vi, '+') else ' ' end as new from fx_store where term_id % 3 = 0")
    return flat(terms.apply_suggestions(store(t), chosen, now()))


@query("d1_touch_time", f"select term_id, strftime(make_timestamp({NOW}000000), '%Y-%m-%d %H:%M:%S') as touched from fx_store")
def d1(t):
    from pageloom.functions.times import touch_time

    return t.fx_store.select("term_id", F.date_format(touch_time(now()), "yyyy-MM-dd HH:mm:ss").alias("touched"))


@query("w10_number_batches", "select series_id, pos, ((row_number() over (partition by series_id order by pos) - 1) // 30)::bigint as batch from fx_pair")
def w10(t):
    numbered = dense_position(t.fx_pair.select("series_id", "pos"), ["series_id"], "pos", "n")
    return numbered.select("series_id", "pos", segments.batch_of("n", L.SUGGESTION_BATCH).alias("batch"))
