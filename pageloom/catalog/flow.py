"""Segments in order: context, batches, merging, quality gates, stages, translation memory, journals, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.catalog import sql_parts as S
from pageloom.catalog.registry import query
from pageloom.catalog.sql_parts import q, trim
from pageloom.catalog.urls_and_text import DECOR_SQL, MARK_ONLY_SQL, OCR_SQL, TITLE_SQL
from pageloom.functions import lexicon as L
from pageloom.functions import predicates, text
from pageloom.functions.geometry import rect
from pageloom.operators import context, files, journal, memory, segments, stages
from pageloom.plans.ordered import dense_position
from pageloom.sources import snapshots
from pageloom.sources.dumps import dump_translations, load_translations
from pageloom.sources.journal import read_journal, write_journal

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")

# ---------------------------------------------------------------- quality gates

_REASON = (f"case when {trim('trans')} = '' then 'blank' when {S.has('trans', '^' + chr(92) + 'p{N}+$')} then 'numeric' when {S.has('trans', 'xong')} then 'filter_text'"
           f" when {trim('lower(src)')} = {trim('lower(trans)')} then 'same_as_source' end")


@query("f12_post_translation_filter", f"select page_id, seg_no, {_REASON} as reason from fx_conv union all select -1 - page_id, seg_no, {_REASON} from fx_seg")
def f12(t):
    both = t.sql("select page_id, seg_no, src, trans from fx_conv union all select -1 - page_id, seg_no, src, trans from fx_seg")
    return both.select("page_id", "seg_no", predicates.rejection_reason("src", "trans", "xong").alias("reason"))


@query("f18_accept_translation")
def f18(t):
    both = t.sql("select page_id, seg_no, src, trans from fx_conv union all select -1 - page_id, seg_no, src, trans from fx_seg")
    return both.select("page_id", "seg_no", predicates.accept_translation("src", "trans").alias("accepted"))


def vocab_sql(base: str) -> str:
    """base: seg_id, s, o."""
    names = "[" + ", ".join(q(n) for n in dict.fromkeys(n for _, n in L.REALMS)) + "]"
    valid = "list_filter([" + ", ".join(f"case when contains(s, {q(z)}) then {q(n)} end" for z, n in L.REALMS) + "], lambda v: v is not null)"
    sql = f"select *, {valid} as valid from ({base})"
    wrong = f"list_filter({names}, lambda n: not list_contains(valid, n) and contains(lower(o), lower(n)))[1]"
    for zh, name in L.REALMS:
        at = f"strpos(lower(o), lower(wr))"
        sql = (f"select seg_id, s, valid, case when contains(s, {q(zh)}) and not contains(lower(o), lower({q(name)})) and wr is not null"
               f" then left(o, {at} - 1) || {q(name)} || substr(o, {at} + length(wr)) else o end as o from (select *, {wrong} as wr from ({sql}))")
    return sql


_VOCAB_SRC = "case seg_id % 4 when 0 then concat('结丹初期 ', src) when 1 then concat('金丹化神', src) else src end"
_VOCAB_TRANS = "case seg_id % 3 when 0 then concat('Trúc Cơ và NGUYÊN ANH ', trans) when 1 then concat('kim đan ', trans) else trans end"


@query("t19_closed_vocab_names", f"select seg_id, o as txt from ({vocab_sql(f'select seg_id, {_VOCAB_SRC} as s, {_VOCAB_TRANS} as o from fx_seg')})")
def t19(t):
    made = t.sql(f"select seg_id, {_VOCAB_SRC} as s, {_VOCAB_TRANS} as o from fx_seg")
    return made.select("seg_id", text.fix_closed_vocab("s", "o").alias("txt"))


def _final_sql() -> str:
    mark, none = S.watermark("src"), S.empty("trans")
    ended = S.terminal("trans")
    chosen = (f"case when {mark} and ({MARK_ONLY_SQL} or {none}) then chr(8205) when {mark} then {ended} when {DECOR_SQL} then src"
              f" when kind = 'title' and not {none} then trans when kind = 'title' and {TITLE_SQL} then chr(8205) when kind = 'title' then src"
              f" when {none} then chr(8205) when {S.needs_retry('trans')} then case when src <> '' then src else trans end"
              f" when coalesce(kind <> 'sfx', true) then {ended} else trans end")
    base = f"select seg_id, {OCR_SQL} as s, {chosen} as o from ({_KINDED})"
    fixed = vocab_sql(base)
    return f"select b.seg_id, case when b.o in ('', chr(8205)) then b.o else f.o end as final from ({base}) b join ({fixed}) f using (seg_id)"


_KINDED = "select seg_id, src, trans, case when seg_id % 10 = 3 then 'title' else kind end as kind from fx_seg"


@query("t27_finalise_translation", _final_sql())
def t27(t):
    return segments.finalise_translation(t.sql(_KINDED)).select("seg_id", "final")


_TERMS = """select series_id, zh, min(vi) as vi, min(pos) as pos from (
  select p_partkey % 40 as series_id, p_name as zh, concat('Đ ', p_brand) as vi, p_partkey as pos from part
  union all select p_partkey % 40, split_part(p_name, ' ', 1), concat('đ', p_type), p_partkey + 1000000000 from part
  union all select p_partkey % 40, '灵晶', 'linh tinh', 2000000000 from part) group by 1, 2"""


@query("j4_enforce_terms", f"""
select seg_id, coalesce(o, trans) as txt from fx_seg left join (
  select seg_id, list_reduce(list(zh || chr(31) || vi order by length(zh) desc, pos), lambda acc, x: case when contains(acc, split_part(x, chr(31), 1))
    and not contains(lower(acc), lower(split_part(x, chr(31), 2))) then replace(acc, split_part(x, chr(31), 1), split_part(x, chr(31), 2)) else acc end, any_value(trans)) as o
  from fx_seg join ({_TERMS}) m using (series_id) where contains(src, zh) group by seg_id) using (seg_id)""")
def j4(t):
    return segments.enforce_terms(t.fx_seg, t.sql(_TERMS), ["seg_id"], ["series_id"], out="txt").select("seg_id", "txt")


_LABELS = "select page_id, seg_no, src, concat('k', cast(seg_no % 3 as string)) as label from fx_seg"


@query("j17_label_by_source_text", f"""
select page_id, seg_no, l.label from fx_seg s left join (select page_id, {trim('src')} as x, arg_min(label, seg_no) as label from ({_LABELS}) group by 1, 2) l
  using (page_id) where {trim('s.src')} = l.x""")
def j17(t):
    return segments.label_by_source_text(t.fx_seg, t.sql(_LABELS), ["page_id"], "label", "seg_no").select("page_id", "seg_no", "label")


# ---------------------------------------------------------------- context

_NB = f"{trim('src')} <> '' and {trim('trans')} <> ''"
_WINDOW = "over (partition by series_id order by seg_id rows between unbounded preceding and 1 preceding)"
_PAIRS = f"(select series_id, seg_id, (list(struct_pack(s := {trim('src')}, t := {trim('trans')})) filter ({_NB}) {_WINDOW})[-12:] as r from fx_ctx)"


@query("w5_recent_context", f"""
select series_id, seg_id, coalesce(len(r), 0)::bigint as n, case when coalesce(len(r), 0) = 0 then '' else array_to_string(list_transform(r[-5:],
  lambda p: '=== TRƯỚC ĐÓ ===' || chr(10) || 'Original: ' || p.s || chr(10) || 'Translation: ' || p.t), chr(10) || chr(10)) || chr(10) || chr(10) || '=== KẾT THÚC NGỮ CẢNH ===' || chr(10) || chr(10) end as block
from {_PAIRS}""")
def w5(t):
    recent = context.recent_pairs(t.fx_ctx.select("series_id", "seg_id", "src", "trans"), ["series_id"], "seg_id")
    return recent.select("series_id", "seg_id", big(F.size("recent")).alias("n"), context.pair_block().alias("block"))


def _pronoun(p: str) -> str:
    return f"case when regexp_matches(x.t, '(?i)(^|[^{S.WORDISH}]){p}($|[^{S.WORDISH}])') then '{p}' end"


@query("w5_pronoun_context", f"""
select series_id, seg_id, case when coalesce(len(r), 0) < 2 then '' else coalesce(array_to_string(list_transform(list_filter(list_transform(r[-6:], lambda p: struct_pack(s := left(p.s, 80), t := left(p.t, 120))),
  lambda x: len(list_filter([{', '.join(_pronoun(p.replace('ô', '[ôÔ]').replace('ẹ', '[ẹẸ]')).replace("then '" + p.replace('ô', '[ôÔ]').replace('ẹ', '[ẹẸ]') + "'", "then '" + p + "'") for p in L.LISTED_PRONOUNS)}], lambda y: y is not null)) > 0),
  lambda x: 'Source: ' || x.s || chr(10) || chr(10) || 'Translation: ' || x.t || chr(10) || chr(10) || 'Pronouns used: ' || array_to_string(list_filter([{', '.join(_pronoun(p.replace('ô', '[ôÔ]').replace('ẹ', '[ẹẸ]')).replace("then '" + p.replace('ô', '[ôÔ]').replace('ẹ', '[ẹẸ]') + "'", "then '" + p + "'") for p in L.LISTED_PRONOUNS)}], lambda y: y is not null), ', ')),
  chr(10) || chr(10)), '') end as block from {_PAIRS}""")
def w5b(t):
    recent = context.recent_pairs(t.fx_ctx.select("series_id", "seg_id", "src", "trans"), ["series_id"], "seg_id")
    return recent.select("series_id", "seg_id", context.pronoun_block().alias("block"))


_STORY = f"""(select series_id, page_id, string_agg({trim("replace(" + trim('trans') + ", chr(10), ' ')")}, ' / ' order by seg_no) filter ({S.has('trans', '[' + S.MARKS + ']')}) as story from fx_ctx group by 1, 2)"""


@query("w6_page_context", f"""
select series_id, page_id, case when length(c) > 1200 then '…' || right(c, 1200) else c end as context from (
  select series_id, page_id, coalesce(array_to_string((list(story) filter (story is not null) over (partition by series_id order by page_id rows between unbounded preceding and 1 preceding))[-10:], ' / '), '') as c from {_STORY})""")
def w6(t):
    return context.page_story(t.fx_ctx)


@query("w6_numbered_context", f"""
with lines as (select series_id, page_id, seg_no, {trim('trans')} as line from fx_ctx where {trim('trans')} <> ''),
pages as (select distinct series_id, page_id from fx_ctx), ne as (select distinct series_id, page_id from lines),
prev as (select p.series_id, p.page_id, n.page_id as src_page, row_number() over (partition by p.series_id, p.page_id order by n.page_id desc) as rn from pages p join ne n on p.series_id = n.series_id and n.page_id < p.page_id)
select series_id, page_id, line_no, '<|' || line_no::varchar || '|>' || line as line from (select p.series_id, p.page_id, l.line, row_number() over (partition by p.series_id, p.page_id order by p.src_page, l.seg_no)::bigint as line_no
  from prev p join lines l on l.series_id = p.series_id and l.page_id = p.src_page where rn <= 3)""")
def w6b(t):
    return context.numbered_context(t.fx_ctx, 3)


# ---------------------------------------------------------------- split sentences

_A = OCR_SQL.replace("src", trim("src"))
_LAST = "right(a, 1)"


def _islands(box: str) -> str:
    return f"""
with f as (select *, {_A} as a from fx_seg), n as (select *, lead(a) over w as b, lead(bx) over w as nbx from (select *, seg_id % 900 as bx from f) window w as (partition by page_id order by seg_no)),
c as (select *, coalesce({S.has('a', S.HAN_RE)} and {S.has('b', S.HAN_RE)} and not {S.watermark('a')} and not {S.watermark('b')} and not contains({q(L.SENTENCE_END)}, {_LAST})
   and {S.count('a', S.HAN_RE)} > 4 {box}, false) as cand from n),
k as (select *, case when cand and {S.has(_LAST, S.HAN_RE)} and not contains({q(L.FINAL_PARTICLES)}, {_LAST}) then 'forced' when cand then 'ask' end as pair_kind from c),
j as (select *, coalesce(pair_kind = 'forced' or (pair_kind = 'ask' and seg_id % 2 = 0), false) as joins from k)
select page_id, seg_no, pair_kind, sum(case when coalesce(prev, false) then 0 else 1 end) over (partition by page_id order by seg_no)::bigint as island
from (select *, lag(joins) over (partition by page_id order by seg_no) as prev from j)"""


@query("w7_sentence_islands", _islands("and greatest(abs(nbx - bx) - 20, 0) <= 30"))
def w7(t):
    boxed = t.fx_seg.select("*", rect((F.col("seg_id") % 900).cast("int"), F.lit(0), (F.col("seg_id") % 900 + 20).cast("int"), F.lit(15)).alias("box"))
    answers = t.fx_seg.select("page_id", "seg_no", (F.col("seg_id") % 2 == 0).alias("yes"))
    return segments.sentence_islands(boxed, answers, box="box").select("page_id", "seg_no", "pair_kind", "island")


@query("w8_continuation_fill", rf"""
with f as (select *, regexp_matches(trans, '(?i)^\s*\[\s*cont[\w.]*\s*\]') as c, {trim(S.sub('trans', r'(?i)^\s*\[\s*cont[\w.]*\s*\]\s*'))} as rest, {trim('trans')} as p, {trim('src')} as own from fx_seg),
a as (select *, case when c then rest <> '' else p <> '' and p <> chr(8205) end as anchor from f),
l as (select *, max(case when anchor then seg_no end) over (partition by page_id order by seg_no) as at from a)
select l.page_id, l.seg_no, case when c and l.rest = '' then chr(8205) when c then l.rest else l.trans end as filled,
  case when c and l.rest = '' and l.own <> '' and x.own <> '' and l.own <> x.own then l.at end as anchor_no
from l left join (select page_id, seg_no, own from f) x on x.page_id = l.page_id and x.seg_no = l.at""")
def w8(t):
    return segments.continuation_fill(t.fx_seg).select("page_id", "seg_no", "filled", "anchor_no")


_GROUPS = "select *, seg_no - seg_no % 3 as group_no from fx_seg"
_RESULTS = f"""select page_id, group_no, case when page_id % 3 = 0 then string_agg({trim('src')}, '' order by seg_no) when page_id % 3 = 1 then concat('dịch ', cast(page_id as varchar)) else '' end as trans from ({_GROUPS}) group by 1, 2"""


@query("w9_expand_merged", f"""
select page_id, seg_no, case when n > 1 and {trim('trans')} = joined then src when seg_no = first then trans else chr(8205) end as expanded from (
  select g.page_id, g.seg_no, g.src, coalesce(r.trans, '') as trans, count(*) over w as n, min(seg_no) over w as first, j.joined from ({_GROUPS}) g
  left join ({_RESULTS}) r on r.page_id = g.page_id and r.group_no = g.group_no and not (g.page_id % 3 = 2)
  join (select page_id, group_no, string_agg({trim('src')}, '' order by seg_no) as joined from ({_GROUPS}) group by 1, 2) j on j.page_id = g.page_id and j.group_no = g.group_no
  window w as (partition by g.page_id, g.group_no))""")
def w9(t):
    grouped = t.sql(_GROUPS)
    joined = grouped.groupBy("page_id", "group_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", text.strip("src").alias("s")))), lambda x: x["s"]), "").alias("j"))
    results = joined.filter("page_id % 3 <> 2").select("page_id", "group_no", F.when(F.col("page_id") % 3 == 0, F.col("j")).otherwise(F.concat(F.lit("dịch "), F.col("page_id").cast("string"))).alias("trans"))
    return segments.expand_merged(grouped, results).select("page_id", "seg_no", "expanded")


# ---------------------------------------------------------------- batches

_FIXED = OCR_SQL


@query("w11_pack_prompts", f"""
with r as (select page_id, seg_no, {_FIXED} as fixed, coalesce(sum(length(src)) over (partition by page_id order by seg_no rows between 1 following and unbounded following), 0) as rest from fx_seg),
s as (select *, coalesce(sum(case when rest > 30 then 1 else 0 end) over (partition by page_id order by seg_no rows between unbounded preceding and 1 preceding), 0)::bigint as prompt_no from r)
select page_id, seg_no, prompt_no, line_no, '<|' || line_no::varchar || '|>' || fixed as line from (select *, row_number() over (partition by page_id, prompt_no order by seg_no)::bigint as line_no from s)""")
def w11(t):
    return segments.pack_prompts(t.fx_seg, 30).select("page_id", "seg_no", "prompt_no", "line_no", "line")


@query("w11_prompt_budget", """
select page_id, prompt_no, count(*)::bigint as size, sum(length(src))::bigint as chars from (select page_id, src, floor(coalesce(sum(length(src)) over (partition by page_id order by seg_no rows between unbounded preceding and 1 preceding), 0) / 30)::bigint as prompt_no from fx_seg) group by 1, 2""")
def w11b(t):
    packed = segments.pack_prompts(t.fx_seg, 30, by="budget")
    texts = segments.prompt_texts(packed)
    sizes = packed.groupBy("page_id", "prompt_no").agg(F.sum(F.length("src")).alias("chars"))
    return texts.join(sizes, ["page_id", "prompt_no"]).select("page_id", "prompt_no", "size", "chars")


@query("w12_budgeted_selection", """
with u as (select series_id, src, arg_min(trans, seg_id) as trans, min(seg_id) as seg_id from fx_seg where src <> '' and trans <> '' group by 1, 2),
r as (select *, row_number() over w as rn, sum(length(src) + length(trans) + 6) over w as s, count(*) over (partition by series_id) as n from u window w as (partition by series_id order by length(src), seg_id)),
k as (select * from r where rn <= 12 and s <= 300)
select series_id, src, trans, seg_id, count(*) over (partition by series_id) < n as capped from k""")
def w12(t):
    return segments.budgeted_selection(t.fx_seg, ["series_id"], "seg_id", max_pairs=12, max_chars=300)


@query("w13_flush_epochs", "select series_id, page_id, ((dense_rank() over (partition by series_id order by page_id) - 1) // 10)::bigint as epoch from (select distinct series_id, page_id from fx_seg)")
def w13(t):
    return segments.flush_epochs(t.fx_seg, ["series_id"])


@query("w17_scatter_gather", "select series_id, seg_id, upper(name) as result, (row_number() over (partition by series_id order by seg_id) - 1)::bigint as flat from fx_seg")
def w17(t):
    flat = segments.scatter_positions(t.fx_seg.select("series_id", "seg_id", "name"), ["series_id"], "seg_id")
    results = flat.select("series_id", "flat", F.upper("name").alias("result"))
    return flat.join(results, ["series_id", "flat"]).select("series_id", "seg_id", "result", "flat")


@query("s14_dump_load_translations", "select page_id, seg_no, trans, (row_number() over (partition by page_id order by seg_no) - 1)::bigint as place from fx_conv")
def s14(t):
    path = snapshots.scratch_path(t.spark, "dump")
    dump_translations(t.fx_conv, path)
    loaded = load_translations(t.spark, path)
    placed = dense_position(t.fx_conv.select("page_id", "seg_no"), ["page_id"], "seg_no", "n").withColumn("place", F.col("n") - 1)
    return placed.join(loaded, ["page_id", "place"]).select("page_id", "seg_no", "trans", "place")


@query("a14_page_language_gate", f"""
select page_id, count(*)::bigint as regions, count(*) <= 3 or count(*) filter ({trim('trans')} <> '') = 0
  or coalesce(sum({S.count('trans', '[' + S.MARKS + ']')}) filter ({trim('trans')} <> ''), 0) * 10 > sum(length({trim('trans')})) filter ({trim('trans')} <> '') as passes from fx_conv group by 1""")
def a14(t):
    marks = F.sum(text.pattern_count("trans", L.VIETNAMESE_MARK))
    detected = F.when(marks * 10 > F.sum(F.length("trans")), "vin").otherwise("eng")
    return segments.page_language_gate(t.fx_conv, detected, "VIN", min_regions=3)


# ---------------------------------------------------------------- memory

_CACHE = "select src, concat(trans, '!') as trans, timestamp '2024-01-01 00:00:00' as ts from fx_conv where seg_no % 2 = 0 and trans <> ''"


@query("j15_cache_lookup", f"""
select page_id, seg_no, c.t as cached from fx_conv left join (select src, max(trans) as t from ({_CACHE}) group by 1) c using (src)""")
def j15(t):
    cache = memory.cache_entries(t.sql(_CACHE), "m", "zh")
    return memory.cache_lookup(t.fx_conv, cache, "m", "zh").select("page_id", "seg_no", "cached")


@query("s15_cache_save_load", f"select md5(src || '|m|zh') as key, src as source, max(trans) as translation from ({_CACHE}) group by src")
def s15(t):
    path = snapshots.scratch_path(t.spark, "cache")
    memory.save_cache(memory.cache_entries(t.sql(_CACHE), "m", "zh"), path)
    return memory.load_cache(t.spark, path).select("key", "source", "translation")


@query("w14_lru_keep", "select key from (select md5(src) as key, max(page_id * 1000 + seg_no) as ts from fx_conv group by 1) order by ts desc, key limit 50")
def w14(t):
    uses = t.fx_conv.select(F.md5("src").alias("key"), (F.col("page_id") * 1000 + F.col("seg_no")).alias("ts"))
    return memory.lru_keep(uses, 50).select("key")


# ---------------------------------------------------------------- journals


@query("w2_running_progress", """select run_id, seq, sum(case when type = 'progress' then amount else 0 end) over (partition by run_id order by seq)::bigint as done from fx_ev""")
def w2(t):
    amount = F.when(F.col("type") == "progress", F.col("amount")).otherwise(0)
    return journal.running_progress(t.fx_ev, amount).select("run_id", "seq", "done")


@query("w3_journal_tail", """select run_id, seq, total, place from (select run_id, seq, count(*) over (partition by run_id) as total, (row_number() over (partition by run_id order by seq) - 1)::bigint as place from fx_ev)
  where place >= greatest(5, total - 40)""")
def w3(t):
    return journal.journal_tail(t.fx_ev, 5, 40).select("run_id", "seq", "total", "place")


@query("w4_stage_durations", """select run_id, seq, state, round((epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) as seconds from (select *, lead(ts) over (partition by run_id order by seq) as nxt from fx_ev)
  where nxt is not null and type <> 'done'""")
def w4(t):
    timed = journal.stage_durations(t.fx_ev, F.col("type") == "done")
    return timed.select("run_id", "seq", "state", F.round("seconds", 3).alias("seconds"))


@query("a17_token_totals", "select run_id, sum(amount)::bigint as tokens, arg_max(amount, seq) as last_tokens from fx_ev group by 1")
def a17(t):
    return journal.token_totals(t.fx_ev)


@query("s13_write_journal")
def s13(t):
    path = snapshots.scratch_path(t.spark, "journal")
    rows = t.fx_ev.select("seq", F.col("ts").cast("timestamp").alias("ts"), "type", F.col("state").alias("msg"), "run_id")
    write_journal(rows, path)
    write_journal(rows.filter("run_id = 7 and seq % 2 = 0"), path)
    return read_journal(t.spark, path).select("run_id", "seq", "type", "msg")


@query("ud5_progress_metrics", "select count(*)::bigint as entries, count(*) filter (type = 'error')::bigint as failed, sum(amount)::bigint as done from fx_ev")
def ud5(t):
    watched, seen = stages.observed(t.fx_ev, "progress", entries=F.count(F.lit(1)), failed=F.count_if(F.col("type") == "error"), done=F.sum("amount"))
    watched.write.mode("overwrite").format("noop").save()
    return t.spark.createDataFrame([seen.get], "entries bigint, failed bigint, done bigint")


# ---------------------------------------------------------------- stages


def _stub(texts):
    """Deterministic stand-in for a translation service: marks its output, refuses one kind of text."""
    return [("đã " + x) if "an" in x else x for x in texts]


def _service(texts):
    if any(x.startswith("Le ") for x in texts):
        raise ValueError("refused")
    return _stub(texts)


@query("ud1_batch_map")
def ud1(t):
    return stages.batch_map(t.fx_conv, _service, ["page_id"], "seg_no", size=3).select("page_id", "seg_no", "trans", "status", "error")


@query("ud2_retry_until_valid")
def ud2(t):
    rows = t.fx_conv.select("page_id", "seg_no", "src")
    return stages.retry_until_valid(rows, _stub, ["page_id"], "seg_no", 2, accept=lambda s, r: ~(F.col(s) == F.col(r))).select("page_id", "seg_no", "trans", "accepted", "rounds")


@query("ud3_fallback_stage", "select doc_id, case when doc_id % 4 = 0 then replace(text, ' ', '_') else text end as ocr, doc_id % 4 = 0 as rescued from documents")
def ud3(t):
    rows = t.documents.select("doc_id", (F.col("doc_id") % 7).alias("page_id"), "text", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("text")).alias("ocr"))
    return stages.fallback_stage(rows, lambda xs: [x.replace(" ", "_") for x in xs], ["page_id"], "doc_id", "ocr", "text").select("doc_id", "ocr", "rescued")


@query("ud4_row_errors", """select doc_id, case when length(text) % 5 = 0 then text else replace(text, ' ', '_') end as result,
  case when length(text) % 5 = 0 then 'failed' else 'ok' end as status from documents""")
def ud4(t):
    def joined(x):
        if len(x) % 5 == 0:
            raise ValueError("no")
        return x.replace(" ", "_")

    return stages.row_errors(t.documents.select("doc_id", "text"), joined, "text").select("doc_id", "result", "status")


# ---------------------------------------------------------------- files

_EXT = "regexp_matches(lower(name), '\\.(jpg|jpeg|png|webp|bmp)$')"


@query("s2_list_images", f"select file_id, folder, name from fx_file where {_EXT}")
def s2(t):
    return files.list_images(t.fx_file).select("file_id", "folder", "name")


_DONE = "select folder, case when file_id % 2 = 0 then name else regexp_replace(name, '[.][^.]*$', '.jpg') end as name from fx_file where file_id % 3 = 0"


@query("j2_pending_outputs", f"""select file_id from fx_file f where {_EXT} and (folder, name) not in (select folder, name from ({_DONE}))
  and (regexp_matches(lower(name), '\\.(jpe?g|webp)$') or (folder, regexp_replace(name, '[.][^.]*$', '.jpg')) not in (select folder, name from ({_DONE})))""")
def j2(t):
    return files.pending_outputs(files.list_images(t.fx_file), t.sql(_DONE), 90).select("file_id")


@query("j3_match_source_image", f"""
with s as (select folder, name, lower(regexp_replace(name, '[.][^.]*$', '')) as st from fx_file where {_EXT} and file_id % 4 <> 0), e as (select distinct folder, name from s), a as (select folder, st, min(name) as n from s group by 1, 2)
select f.file_id, coalesce(e.name, a.n) as source from fx_file f left join e on e.folder = f.folder and e.name = f.name left join a on a.folder = f.folder and a.st = lower(regexp_replace(f.name, '[.][^.]*$', ''))""")
def j3(t):
    return files.match_source_image(t.fx_file, t.fx_file.filter("file_id % 4 <> 0")).select("file_id", "source")


_SIDE = "select folder, name, count(*) as regions, max(mtime) + interval '1' day as mtime from fx_file where file_id % 5 = 0 group by 1, 2"


@query("j6_listing_with_region_counts", f"""select folder, name, coalesce(regions, 0)::bigint as count, epoch(greatest(f.mtime, s.mtime))::bigint as mtime_s from fx_file f left join ({_SIDE}) s using (folder, name) where {_EXT}""".replace("greatest(f.mtime, s.mtime)", "greatest(f.mtime, coalesce(s.mtime, f.mtime))"))
def j6(t):
    listed = files.listing_with_region_counts(t.fx_file, t.sql(_SIDE))
    return listed.select("folder", "name", "count", F.unix_timestamp(F.col("mtime").cast("timestamp")).alias("mtime_s"))


@query("j18_split_manual_jobs", """with side as (select distinct image, mode from fx_region), im as (select distinct name as image from fx_file)
select 'manual' as part, image, mode from im join side using (image) union all select 'auto', image, '' from im where image not in (select image from side where mode = 'replace')
union all select 'manual', 'img' || (p_partkey % 400)::varchar || '.jpg', '' from part where false""")
def j18(t):
    from pageloom.operators.regions import split_manual_jobs

    side = t.fx_region.groupBy("image", "mode").agg(F.collect_list("region_no").alias("regions"))
    manual, auto = split_manual_jobs(t.fx_file.select(F.col("name").alias("image")).distinct(), side)
    return manual.select(F.lit("manual").alias("part"), "image", "mode").unionByName(auto.select(F.lit("auto").alias("part"), "image", F.lit("").alias("mode")))


@query("j19_explain_selection", f"""select a.folder, a.name, case when l.folder is null then 'not_found' when not is_file then 'not_a_file' when not regexp_matches(lower(a.name), '\\.(jpg|jpeg|png|webp|bmp)$') then 'unsupported' else 'ok' end as reason
 from (select distinct folder, name from fx_file) a left join (select folder, name, max(file_id) % 5 <> 0 as is_file from fx_file where file_id % 3 <> 0 group by 1, 2) l using (folder, name)""")
def j19(t):
    listing = t.fx_file.filter("file_id % 3 <> 0").groupBy("folder", "name").agg((F.max("file_id") % 5 != 0).alias("is_file"))
    return files.explain_selection(t.fx_file.select("folder", "name").distinct(), listing)


_CONF = """select case file_id % 3 when 0 then folder when 1 then regexp_replace(folder, '/[^/]*$', '') else regexp_replace(folder, '/original/[^/]*$', '') end as folder, 'glossary.txt' as name from fx_file where file_id % 50 < 3 and folder like '%s1%'"""


@query("s16_resolve_config_file", f"""
with d as (select distinct folder, regexp_replace(folder, '/[^/]*$', '') as p, regexp_replace(folder, '/original/[^/]*$', '') as r from fx_file), c as (select distinct folder as f from ({_CONF}))
select folder, coalesce(case when folder in (select f from c) then folder when p in (select f from c) then p end, r) || '/glossary.txt' as path,
  folder in (select f from c) or p in (select f from c) or r in (select f from c) as exists from d""")
def s16(t):
    return files.resolve_config_file(t.fx_file.select("folder").distinct(), t.sql(_CONF), "glossary.txt")


_NAT = "order by try_cast(regexp_extract(name, '(\\d+)', 1) as bigint), lower(name), file_id"


@query("o1_natural_sort_key", f"select file_id, row_number() over (partition by folder {_NAT})::bigint as place from fx_file")
def o1(t):
    return files.natural_place(t.fx_file).select("file_id", "place")


@query("w18_neighbours_in_order", f"""select file_id, lag(name) over w as previous, lead(name) over w as following, row_number() over w as place, count(*) over (partition by folder) as siblings
  from fx_file window w as (partition by folder {_NAT})""")
def w18(t):
    return files.neighbours_in_order(t.fx_file).select("file_id", "previous", "following", "place", "siblings")


@query("o4_newest_then_natural", f"select name, epoch(mtime)::bigint as mtime_s, (select count(*) from fx_file where {_EXT})::bigint as total from fx_file where {_EXT} order by mtime desc, name desc limit 30")
def o4(t):
    return files.newest_then_natural(t.fx_file, 30).select("name", F.unix_timestamp(F.col("mtime").cast("timestamp")).alias("mtime_s"), "total")


_NOW = "1998-01-01 00:00:00"


@query("w15_retention_prune", f"""select file_id from (select *, row_number() over (partition by folder order by mtime desc, file_id desc) as rn from fx_file) where rn > 5 or mtime < timestamp '{_NOW}' - interval 1500 day""")
def w15(t):
    return files.retention_prune(t.fx_file, F.lit(_NOW).cast("timestamp_ntz"), 1500, 5).select("file_id")


@query("d2_age_cutoff", f"select file_id, mtime < timestamp '{_NOW}' - interval 7 day as old from fx_file")
def d2(t):
    from pageloom.functions.times import older_than

    return t.fx_file.select("file_id", older_than("mtime", F.lit(_NOW).cast("timestamp_ntz"), 7).alias("old"))


@query("a11_compression_report", """select count(*)::bigint as files, sum(length)::bigint as bytes_before, sum(length // 3)::bigint as bytes_after, round(sum(length) / 1048576, 2) as mb_before,
  round(sum(length // 3) / 1048576, 2) as mb_after, round((sum(length) - sum(length // 3)) / sum(length) * 100, 1) as saved_pct from fx_file""")
def a11(t):
    after = t.fx_file.select("file_id", F.floor(F.col("length") / 3).alias("length"))
    return files.compression_report(t.fx_file, after)


_STATUS = "select file_id % 4 as run_id, name, case file_id % 7 when 0 then 'skipped' when 1 then 'failed' when 2 then 'ignored' when 3 then 'copied' else 'cropped' end as status from fx_file"


@query("a12_crop_report", f"""
with s as ({_STATUS}), d as (select run_id, status, string_agg(name, ',' order by name) as names from (select *, row_number() over (partition by run_id, status order by name) as rn from s) where rn <= 20 group by 1, 2)
select run_id, count(*) filter (status = 'cropped')::bigint as cropped, count(*) filter (status = 'copied')::bigint as copied, count(*) filter (status = 'skipped')::bigint as skipped, count(*) filter (status = 'failed')::bigint as failed,
  count(*) filter (status = 'ignored')::bigint as ignored, (select names from d where d.run_id = s.run_id and status = 'skipped') as skipped_detail, (select names from d where d.run_id = s.run_id and status = 'failed') as failed_detail,
  (select names from d where d.run_id = s.run_id and status = 'ignored') as ignored_detail from s group by run_id""")
def a12(t):
    return files.crop_report(t.sql(_STATUS))
