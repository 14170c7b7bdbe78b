"""Page regions and hand-drawn regions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.catalog import sql_parts as S
from pageloom.catalog.registry import query
from pageloom.functions import geometry as G
from pageloom.operators import boxes, regions
from pageloom.sources import sidecars, snapshots

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")
W, H = 1100, 1300
_INTER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)::bigint * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"
_AREA = "(({t}.x2 - {t}.x1)::bigint * ({t}.y2 - {t}.y1))"
_A, _B = _AREA.format(t="a"), _AREA.format(t="b")
_IOU = f"(case when {_INTER} > 0 then {_INTER} / ({_A} + {_B} - {_INTER}) else 0.0 end)"
_PAIR = "from fx_box a join fx_box b on a.page_id = b.page_id and a.region_id < b.region_id"
_GAP = "greatest(greatest(a.x1, b.x1) - least(a.x2, b.x2), greatest(a.y1, b.y1) - least(a.y2, b.y2), 0)"
_SHORT = "least(a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1)"
_IDS = "select a.page_id, a.region_id as a_id, b.region_id as b_id"


@query("g1_bbox_of_quad", "select page_id, region_id, x1, y1, x2, y2 from fx_box")
def g1(t):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    quad = F.array(p("x2", "y1"), p("x1", "y2"), p("x2", "y2"), p("x1", "y1"))
    return t.fx_box.select("page_id", "region_id", G.bbox_of_quad(quad).alias("r")).select("page_id", "region_id", "r.*")


@query("g2_expand_rect", f"select page_id, region_id, greatest(x1 - 24, 0) as x1, greatest(y1 - 24, 0) as y1, least(x2 + 24, {W}) as x2, least(y2 + 24, {H}) as y2 from fx_box")
def g2(t):
    return t.fx_box.select("page_id", "region_id", G.expand_rect(G.rect_of(), 24, 24, W, H).alias("r")).select("page_id", "region_id", "r.*")


@query("g3_rects_intersect", f"{_IDS} {_PAIR} where not (a.x2 <= b.x1 or a.y2 <= b.y1 or b.x2 <= a.x1 or b.y2 <= a.y1)")
def g3(t):
    pairs = boxes.near_pairs_of(t.fx_box, t.fx_box).filter(F.col("a.region_id") < F.col("b.region_id"))
    return boxes._ids(pairs.filter(G.rects_intersect(F.col("a"), F.col("b"))))


@query("g4_iou", f"{_IDS}, round({_IOU}, 6) as iou {_PAIR} where {_INTER} > 0")
def g4(t):
    pairs = boxes.near_pairs_of(t.fx_box, t.fx_box).filter(F.col("a.region_id") < F.col("b.region_id"))
    return boxes._ids(pairs, F.round(G.iou(F.col("a"), F.col("b")), 6).alias("iou")).filter("iou > 0")


@query("g5_coverage", f"{_IDS}, round({_INTER} / greatest(1, {_A}), 6) as covered {_PAIR} where {_INTER} > 0")
def g5(t):
    pairs = boxes.near_pairs_of(t.fx_box, t.fx_box).filter(F.col("a.region_id") < F.col("b.region_id"))
    return boxes._ids(pairs, F.round(G.coverage(F.col("a"), F.col("b")), 6).alias("covered")).filter("covered > 0")


@query("j12_overlap_pairs", f"{_IDS} {_PAIR} where least({_A}, {_B}) > 0 and {_INTER} > 0.06 * least({_A}, {_B})")
def j12(t):
    return boxes.overlap_pairs(t.fx_box)


@query("j13_near_pairs", f"{_IDS} {_PAIR} where {_GAP} <= greatest(30.0, 1.5 * {_SHORT})")
def j13(t):
    return boxes.near_pairs(t.fx_box)


def _lines_sql() -> str:
    aw, ah, bw, bh = "(a.x2 - a.x1)", "(a.y2 - a.y1)", "(b.x2 - b.x1)", "(b.y2 - b.y1)"
    fa, fb = f"least({aw}, {ah})", f"least({bw}, {bh})"
    f = f"least({fa}, {fb})"
    dist = ("sqrt(power(greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)), 2) + power(greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)), 2))")
    return f"""{_IDS} {_PAIR} where {dist} <= 2 * {f} and greatest({fa}, {fb}) <= 1.5 * {f}
  and not ({aw} / {ah} > 2 and {bw} / {bh} < 0.5) and not ({bw} / {bh} > 2 and {aw} / {ah} < 0.5) and {dist} < 0.6 * {f}
  and case when abs(a.x1 + {aw} // 2 - b.x1 - {bw} // 2) < 1.5 then true when {aw} > {ah} * 1.9 and {bh} > {bw} * 1.9 then false when {bw} > {bh} * 1.9 and {ah} > {aw} * 1.9 then false
    when {aw} > {ah} * 1.9 or {bw} > {bh} * 1.9 then abs(a.x1 - b.x1) < {f} * 1.5 or abs(a.x2 - b.x2) < {f} * 1.5
    when {ah} > {aw} * 1.9 or {bh} > {bw} * 1.9 then abs(a.y1 - b.y1) < {f} * 1.5 or abs(a.y2 - b.y2) < {f} * 1.5 else false end"""


@query("j14_mergeable_lines", _lines_sql())
def j14(t):
    return boxes.mergeable_lines(t.fx_box)


@query("j14_mergeable_lines_coarse", f"""{_IDS} {_PAIR} where ((a.x2 - a.x1) >= (a.y2 - a.y1)) = ((b.x2 - b.x1) >= (b.y2 - b.y1))
  and abs(least(a.x2 - a.x1, a.y2 - a.y1) - least(b.x2 - b.x1, b.y2 - b.y1)) <= 0.7 * least(a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1)
  and sqrt(power(greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)), 2) + power(greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2)), 2))
    <= 2 * greatest(least(a.x2 - a.x1, a.y2 - a.y1), least(b.x2 - b.x1, b.y2 - b.y1))""")
def j14b(t):
    return boxes.mergeable_lines(t.fx_box, coarse=True)


_BEST = f"""best as (select page_id, region_id, arg_max(c, struct_pack(v := v, o := -c)) as container_id, max(v) as covered from (
  select a.page_id, a.region_id, b.region_id as c, {_INTER} / greatest(1, {_A}) as v from fx_box a join fx_box b on a.page_id = b.page_id
  where not a.is_container and b.is_container and {_INTER} > 0) group by 1, 2)"""
_WITH_BEST = f"""with {_BEST} select r.page_id, r.region_id, r.x1, r.y1, r.x2, r.y2, k.container_id, coalesce(k.covered, 0.0) as covered,
  c.x1 as cx1, c.y1 as cy1, c.x2 as cx2, c.y2 as cy2 from fx_box r left join best k using (page_id, region_id)
  left join fx_box c on c.page_id = r.page_id and c.region_id = k.container_id where not r.is_container"""


def _contained(t):
    return boxes.best_container(t.fx_box.filter("not is_container"), t.fx_box.filter("is_container"))


@query("j8_best_container", f"select page_id, region_id, container_id, round(covered, 6) as covered from ({_WITH_BEST})")
def j8(t):
    return _contained(t).select("page_id", "region_id", "container_id", F.round("covered", 6).alias("covered"))


@query("g8_text_limits", f"""select page_id, region_id, case when covered > 0.4 then greatest(6, (cx2 - cx1) // 8) end::bigint as max_chars,
  case when covered > 0.4 then greatest(1, (cy2 - cy1) // 14) end::bigint as max_lines from ({_WITH_BEST})""")
def g8(t):
    made = _contained(t).select("page_id", "region_id", G.text_limits(F.col("container"), "covered").alias("l"))
    return made.select("page_id", "region_id", big("l.max_chars").alias("max_chars"), big("l.max_lines").alias("max_lines"))


_PX, _PY = "greatest(8, floor((x2 - x1) * 0.3e0)::int)", "greatest(8, floor((y2 - y1) * 0.4e0)::int)"


@query("g10_render_rect", f"""select page_id, region_id, case when covered > 0.4 then cx1 else greatest(0, x1 - {_PX}) end as x1, case when covered > 0.4 then cy1 else greatest(0, y1 - {_PY}) end as y1,
  case when covered > 0.4 then cx2 else least({W}, x2 + {_PX}) end as x2, case when covered > 0.4 then cy2 else least({H}, y2 + {_PY}) end as y2 from ({_WITH_BEST})""")
def g10(t):
    made = _contained(t)
    return made.select("page_id", "region_id", G.render_rect(G.rect_of(), F.col("container"), "covered", F.lit(W), F.lit(H)).alias("r")).select("page_id", "region_id", "r.*")


_MARKED = "(select page_id, region_id, x1, y1, x2, y2, conf, case when region_id % 4 = 0 then 'gxr.com' else text end as text from fx_box)"


def _marked(t):
    return t.fx_box.withColumn("text", F.when(F.col("region_id") % 4 == 0, "gxr.com").otherwise(F.col("text"))).drop("is_container")


_MARK_BOX = f"select page_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from {_MARKED} where text like '%.com' group by 1"


@query("j9_watermark_neighbours", f"""select r.page_id, r.region_id from {_MARKED} r left join ({_MARK_BOX}) m using (page_id) where r.text not like '%.com' and (m.x1 is null or
  r.x2 <= greatest(0, m.x1 - 80) or r.y2 <= greatest(0, m.y1 - 80) or least({W}, m.x2 + 80) <= r.x1 or least({H}, m.y2 + 80) <= r.y1)""")
def j9(t):
    return boxes.drop_watermark_neighbours(_marked(t), W, H).select("page_id", "region_id")


@query("g12_erase_regions", f"""
select page_id, region_id, x1, y1, x2, y2, 'text' as kind, 5 as kernel, 2 as rounds, 6 as radius from {_MARKED} where text not like '%.com' union all
select page_id, 0, greatest(0, x1 - 90), greatest(0, y1 - 90), least({W}, x2 + 90), least({H}, y2 + 90), 'wm', 9, 4, 12 from ({_MARK_BOX}) union all
select page_id, region_id, greatest(0, x1 - 64), greatest(0, y1 - 64), least({W}, x2 + 64), least({H}, y2 + 64), 'wm', 9, 4, 10 from {_MARKED} where text like '%.com'""")
def g12(t):
    return boxes.erase_regions(_marked(t), W, H)


@query("g11_watermark_pad", f"""select page_id, region_id, x1, y1, x2, y2 from (select page_id, region_id, greatest(0, x1 - floor((x2 - x1) * 0.1e0)::int - 6) as x1,
  greatest(0, y1 - floor((y2 - y1) * 0.3e0)::int - 4) as y1, least({W}, x2 + floor((x2 - x1) * 0.1e0)::int + 6) as x2, least({H}, y2 + floor((y2 - y1) * 0.3e0)::int + 4) as y2
  from {_MARKED} where text like '%.com' and region_id % 8 = 0) where x2 > x1 and y2 > y1""")
def g11(t):
    made = _marked(t).withColumn("trans", F.when(F.col("region_id") % 8 == 0, F.lit("‍ ")).otherwise("said"))
    return boxes.watermark_fill_boxes(made, W, H)


@query("g14_is_narrow", "select page_id, region_id, greatest(1, y2 - y1) / greatest(1, x2 - x1) >= 4 as narrow from (select page_id, region_id, x1, x1 + (x2 - x1) // 5 as x2, y1, y2 from fx_box)")
def g14(t):
    made = t.fx_box.withColumn("x2", F.col("x1") + F.floor((F.col("x2") - F.col("x1")) / 5).cast("int"))
    return made.select("page_id", "region_id", G.is_narrow(G.rect_of()).alias("narrow"))


@query("j20_split_glued_watermarks", """
with l as (select page_id, region_id // 3 as region_id, region_id % 4 = 0 as m, x1, y1, x2, y2 from fx_box),
p as (select page_id, region_id, count(*) filter (m) as k, count(*) as n from l group by 1, 2)
select page_id, region_id::bigint as region_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*)::bigint as lines, bool_or(k > 0 and k < n) as was_glued
from l join p using (page_id, region_id) where not (m and k > 0 and k < n) group by 1, 2""")
def j20(t):
    lines = _marked(t).withColumn("line_no", F.col("region_id")).withColumn("region_id", F.floor(F.col("line_no") / 3))
    return boxes.split_glued_watermarks(lines)


@query("a3_union_boxes", "select page_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from fx_box group by 1")
def a3(t):
    return boxes.union_boxes(t.fx_box, ["page_id"])


_SIZES = "select page_id, region_id, (x2 - x1) // 6 as size, region_id % 3 <> 0 as is_body from fx_box"


@query("a13_group_size_target", f"""
with s as ({_SIZES}), p as (select page_id, count(*) filter (is_body) as n, median(size) filter (is_body and size >= 12) as m1, median(size) filter (is_body) as m2 from s group by 1),
t as (select page_id, case when n >= 2 then greatest(12, round_even(coalesce(m1, m2), 0)::int) end as target from p)
select page_id, region_id, size, target, case when target is null then size when is_body then case when target > size then least(target, greatest(size + 1, floor(size * 1.3e0)::int)) else target end
  else least(size, floor(target * 1.8e0)::int) end as new_size from s join t using (page_id)""")
def a13(t):
    made = t.fx_box.select("page_id", "region_id", F.floor((F.col("x2") - F.col("x1")) / 6).cast("int").alias("size"), (F.col("region_id") % 3 != 0).alias("is_body"))
    return boxes.group_size_target(made, 12).select("page_id", "region_id", "size", "target", "new_size")


@query("o6_reading_order", "select page_id, region_id, row_number() over (partition by page_id order by y1, x1, region_id)::bigint as place from fx_box")
def o6(t):
    from pageloom.plans.ordered import any_order_position

    return any_order_position(t.fx_box.select("page_id", "region_id", "x1", "y1"), ["page_id"], [*boxes.reading_order(), F.col("region_id")], "place").select("page_id", "region_id", "place")


@query("j10_dedupe_overlaps")
def j10(t):
    return boxes.dedupe_overlaps(_crowded(t)).select("page_id", "region_id")


def _crowded(t):
    """Pages of many orders, so that regions meet."""
    made = t.fx_box.select(F.floor(F.col("page_id") / 32).alias("page_id"), (F.col("page_id") % 32 * 64 + F.col("region_id")).cast("int").alias("region_id"), "x1", "y1", "x2", "y2", "text")
    return made


@query("j11_dedupe_candidates")
def j11(t):
    return boxes.dedupe_candidates(_crowded_by_page(t), 0.4).select("page_id", "region_id")


def _crowded_by_page(t):
    """``_crowded`` without texts. Lines go to their page first, so that numbering them within orders and choosing within pages take one exchange."""
    line = t.lineitem.withColumn("page_id", F.floor(F.col("l_orderkey") / 32)).repartition("page_id")
    within = Window.partitionBy("page_id", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x1, y1 = F.col("l_partkey") % 800, F.col("l_suppkey") * 7 % 1100
    return line.select("page_id", (F.col("l_orderkey") % 32 * 64 + F.row_number().over(within)).cast("int").alias("region_id"), x1.cast("int").alias("x1"),
                       y1.cast("int").alias("y1"), (x1 + F.col("l_quantity").cast("int") * 3 + 20).cast("int").alias("x2"),
                       (y1 + F.col("l_linenumber") * 5 + 16).cast("int").alias("y2"))


@query("g13_group_nearby")
def g13(t):
    return boxes.group_nearby(t.fx_box).select("page_id", "region_id", "group_no")


@query("g15_union_merged_regions", """
with r as (select page_id, region_id, x1, y1, x2, y2, text from fx_box), p as (select a.page_id, a.region_id as anchor, b.region_id as cont,
  greatest(greatest(a.x1, b.x1) - least(a.x2, b.x2), greatest(a.y1, b.y1) - least(a.y2, b.y2), 0) <= greatest(30.0, 1.5 * least(a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1)) as near,
  b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2, b.text as bt from r a join r b on a.page_id = b.page_id and a.region_id % 2 = 1 and b.region_id = a.region_id + 1)
select page_id, region_id, case when p.cont is null then text else text || bt end as text, case when region_id % 2 = 0 then '' else 'said' end as trans,
  case when near then least(x1, bx1) else x1 end as x1, case when near then least(y1, by1) else y1 end as y1, case when near then greatest(x2, bx2) else x2 end as x2, case when near then greatest(y2, by2) else y2 end as y2
from r left join p using (page_id) where false union all
select r.page_id, r.region_id, case when p.cont is null then r.text else r.text || bt end, case when r.region_id % 2 = 0 then '' else 'said' end,
  case when near then least(r.x1, bx1) else r.x1 end, case when near then least(r.y1, by1) else r.y1 end, case when near then greatest(r.x2, bx2) else r.x2 end, case when near then greatest(r.y2, by2) else r.y2 end
from r left join p on r.page_id = p.page_id and r.region_id = p.anchor""")
def g15(t):
    box = t.fx_box.select("page_id", "region_id", "x1", "y1", "x2", "y2", "text", F.lit("said").alias("trans"))
    merges = box.filter("region_id % 2 = 0").select("page_id", F.col("region_id").alias("pos"), F.col("region_id").alias("cont_id"), (F.col("region_id") - 1).alias("anchor_id"))
    return boxes.union_merged_regions(box, merges)


# ---------------------------------------------------------------- hand-drawn regions

_CX, _CY = "greatest(0.0, least(1.0, x))", "greatest(0.0, least(1.0, y))"
_CW, _CH = f"greatest(0.0, least(1.0 - {_CX}, w))", f"greatest(0.0, least(1.0 - {_CY}, h))"
_OK = f"{_CW} >= 0.002 and {_CH} >= 0.002"
_FLAT = "case when erase_flat and regexp_matches(ltrim(coalesce(flat_color, ''), '#'), '^[0-9a-fA-F]{6}$') then '#' || lower(ltrim(flat_color, '#')) end"
_FONT = "regexp_extract(coalesce(font, ''), '[^/]*$')"
CLEANED = f"""select region_no, image, mode, mask_dilate, round({_CX}, 5) as x, round({_CY}, 5) as y, round({_CW}, 5) as w, round({_CH}, 5) as h,
  case when not inpaint_only then nullif(trim(text), '') end as text, case when inpaint_only then true end as inpaint_only, case when erase_flat then true end as erase_flat,
  case when not inpaint_only and erase_box then true end as erase_box, {_FLAT} as flat_color, case when not inpaint_only and text_color is not null then '#' || lower(text_color) end as text_color,
  case when not inpaint_only and regexp_matches(lower({_FONT}), '\\.(ttf|otf)$') then {_FONT} end as font, case when not inpaint_only and font_size between 6 and 200 then font_size end as font_size,
  case when not inpaint_only and own_dilate between 0 and 10 then own_dilate end as own_dilate,
  case when not inpaint_only and rotate between -180 and 180 and abs(rotate) > 0.01 then round(rotate, 1) end as rotate from fx_region where {_OK}"""
_FIELDS = ("x", "y", "w", "h", "text", "inpaint_only", "erase_flat", "erase_box", "flat_color", "text_color", "font", "font_size", "own_dilate", "rotate")


def _region_struct():
    kinds = dict(inpaint_only="boolean", erase_flat="boolean", erase_box="boolean")
    return F.struct(*[F.col(f).cast(kinds.get(f, t)).alias("mask_dilate" if f == "own_dilate" else f) for f, t in zip(_FIELDS, (
        "double", "double", "double", "double", "string", "boolean", "boolean", "boolean", "string", "string", "string", "int", "int", "double"))])


def _sidecars(t):
    rows = t.fx_region.select("image", "mode", "mask_dilate", "region_no", _region_struct().alias("r"))
    return rows.groupBy("image", "mode", "mask_dilate").agg(F.transform(F.array_sort(F.collect_list(F.struct("region_no", "r"))), lambda s: s["r"]).alias("regions"))


def _flat(df):
    """image, mode, mask_dilate and one line per region."""
    r = df.select("image", "mode", "mask_dilate", F.posexplode("regions").alias("i", "r"))
    return r.select("image", "mode", "mask_dilate", big("i").alias("i"), *[F.col(f"r.{'mask_dilate' if f == 'own_dilate' else f}").alias(f) for f in _FIELDS])


_SANE = "case when mode in ('merge', 'replace') then mode else 'merge' end as mode"
_NUMBERED = "(row_number() over (partition by image order by region_no) - 1)::bigint as i"


@query("g9_clean_region", f"select * exclude (image, mode, mask_dilate) from ({CLEANED})")
def g9(t):
    made = t.fx_region.select("region_no", G.clean_region(_region_struct()).alias("r")).filter("r is not null")
    return made.select("region_no", *[F.col(f"r.{'mask_dilate' if f == 'own_dilate' else f}").alias(f) for f in _FIELDS])


_COLS = ", ".join(_FIELDS)


@query("m11_save_regions", f"select image, {_SANE}, greatest(0, least(10, mask_dilate)) as mask_dilate, {_NUMBERED}, {_COLS} from ({CLEANED})")
def m11(t):
    return _flat(regions.save_regions(_sidecars(t)))


@query("s4_read_region_sidecars", f"""select image, {_SANE}, greatest(0, least(6, mask_dilate)) as mask_dilate, count(*)::bigint as n, round(sum(x), 4) as sx from fx_region
  where region_no % 400 % 7 <> 0 group by 1, 2, 3""")
def s4(t):
    text = F.to_json(F.struct("image", "mode", "mask_dilate", "regions"))
    broken = F.regexp_extract("image", r"(\d+)", 1).cast("int") % 7 == 0
    files = _sidecars(t).select("image", F.when(broken, F.lit('{"mode": ')).otherwise(text).alias("value"))
    got = sidecars.parse_sidecars(files)
    return got.select("image", "mode", "mask_dilate", big(F.size("regions")).alias("n"), F.round(F.aggregate("regions", F.lit(0.0), lambda a, r: a + r["x"]), 4).alias("sx"))


@query("s12_write_region_sidecars", f"select image, {_SANE}, greatest(0, least(10, mask_dilate)) as mask_dilate, {_NUMBERED}, {_COLS} from ({CLEANED})")
def s12(t):
    path = snapshots.scratch_path(t.spark, "sidecars")
    sidecars.write_sidecars(regions.save_regions(_sidecars(t)), path)
    return _flat(sidecars.read_sidecar_table(t.spark, path))


@query("m12_clear_regions", "select image, count(*)::bigint as n from fx_region where image not in (select image from fx_region where region_no % 5 = 0) group by 1")
def m12(t):
    left, _ = regions.clear_regions(_sidecars(t), t.fx_region.filter("region_no % 5 = 0").select("image"))
    return left.select("image", big(F.size("regions")).alias("n"))




@query("j16_broadcast_regions", """
with own as (select distinct image, case when mode in ('merge', 'replace') then mode else 'merge' end as m, mode, mask_dilate, count(*) over (partition by image) as n from fx_region),
t as (select x, y, w, h, inpaint_only as io, erase_flat as ef, min(region_no) as region_no from (select round(greatest(0.0, least(1.0, x)), 4) as x, round(greatest(0.0, least(1.0, y)), 4) as y,
   round(greatest(0.0, least(1.0 - greatest(0.0, least(1.0, x)), w)), 4) as w, round(greatest(0.0, least(1.0 - greatest(0.0, least(1.0, y)), h)), 4) as h, inpaint_only, erase_flat, region_no from fx_region where image = 'img7.jpg') where w >= 0.002 and h >= 0.002 group by all),
k as (select image, round(x, 4) as x, round(y, 4) as y, round(w, 4) as w, round(h, 4) as h, inpaint_only as io, erase_flat as ef from fx_region)
select image, case when image like '%3.jpg' then m else mode end as mode, case when image like '%3.jpg' then greatest(0, least(10, mask_dilate)) else mask_dilate end as mask_dilate,
  case when image like '%3.jpg' then n + (select count(*) from t where not exists (select 1 from k where k.image = own.image and k.x = t.x and k.y = t.y and k.w = t.w and k.h = t.h and k.io = t.io and k.ef = t.ef)) else n end::bigint as n from own""")
def j16(t):
    current = _sidecars(t)
    template = current.filter("image = 'img7.jpg'").select("mode", "mask_dilate", "regions")
    got = regions.broadcast_regions(current, template, current.filter("image like '%3.jpg'").select("image"))
    return got.select("image", "mode", "mask_dilate", big(F.size("regions")).alias("n"))


@query("a10_region_mix", """select image, count(*) filter (not inpaint_only and not (trim(text) <> '' or erase_flat))::bigint as ocr,
  count(*) filter (not inpaint_only and (trim(text) <> '' or erase_flat))::bigint as typed, count(*) filter (inpaint_only)::bigint as inpaint_only from fx_region group by 1""")
def a10(t):
    return regions.region_mix(_sidecars(t))


@query("g6_parse_pixel_box", f"""select page_id, region_id, least(a, c) as x1, least(b, d) as y1, greatest(a, c) as x2, greatest(b, d) as y2 from (select page_id, region_id,
  greatest(0.0, least(x2 * 1.5e0, {W}))::double as a, greatest(0.0, least(y2 * 1.0e0, {H}))::double as b, greatest(0.0, least(x1 * 2.0e0, {W}))::double as c, greatest(0.0, least(y1 * 1.0e0, {H}))::double as d from fx_box)
  where abs(a - c) >= 3 and abs(b - d) >= 3""")
def g6(t):
    bbox = F.array(*[e.cast("string") for e in (F.col("x2") * 1.5, F.col("y2") * 1.0, F.col("x1") * 2.0, F.col("y1") * 1.0)])
    return t.fx_box.select("page_id", "region_id", G.pixel_box(bbox, F.lit(W), F.lit(H)).alias("b")).filter("b is not null").select("page_id", "region_id", "b.*")


_UX = "round_even(greatest(0.0, least(1.0, {v})) * {s}, 0)::int"


@query("g7_regions_to_pixels", f"""
with px as (select image, mode, {_UX.format(v='x', s=W)} as x1, {_UX.format(v='y', s=H)} as y1, {_UX.format(v='x + w', s=W)} as x2, {_UX.format(v='y + h', s=H)} as y2 from fx_region),
ok as (select * from px where x2 - x1 >= 2 and y2 - y1 >= 2), det as (select 'img' || (page_id % 400)::varchar || '.jpg' as image, x1, y1, x2, y2 from fx_box)
select image, x1, y1, x2, y2, 'manual' as origin from ok union all select image, x1, y1, x2, y2, 'detected' from det where image not in (select image from ok where mode = 'replace')""")
def g7(t):
    detected = t.fx_box.select(F.concat(F.lit("img"), (F.col("page_id") % 400).cast("string"), F.lit(".jpg")).alias("image"), "x1", "y1", "x2", "y2")
    sizes = t.fx_region.select("image").distinct().withColumns({"width": F.lit(W), "height": F.lit(H)})
    return regions.regions_to_pixels(_sidecars(t), detected, sizes)


@query("g16_crop_rect", f"""select region_no, {_UX.format(v=_CX, s='wd')} as x1, {_UX.format(v=_CY, s='ht')} as y1, {_UX.format(v=f'{_CX} + {_CW}', s='wd')} as x2, {_UX.format(v=f'{_CY} + {_CH}', s='ht')} as y2
  from (select *, 100 + region_no % 50 as wd, 120 as ht from fx_region) where {_CW} >= 0.01 and {_CH} >= 0.01 and {_UX.format(v=f'{_CX} + {_CW}', s='wd')} - {_UX.format(v=_CX, s='wd')} >= 8
  and {_UX.format(v=f'{_CY} + {_CH}', s='ht')} - {_UX.format(v=_CY, s='ht')} >= 8""")
def g16(t):
    made = t.fx_region.select("region_no", G.crop_rect("x", "y", "w", "h", 100 + F.col("region_no") % 50, F.lit(120)).alias("r"))
    return made.filter("r is not null").select("region_no", "r.*")
