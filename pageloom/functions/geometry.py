"""Rectangle arithmetic. A rectangle is a struct of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.text import ColumnLike, col, hex_color, is_blank, strip

SIDES = ("x1", "y1", "x2", "y2")


def rect(x1: ColumnLike, y1: ColumnLike, x2: ColumnLike, y2: ColumnLike) -> Column:
    return F.struct(*[col(v).alias(n) for n, v in zip(SIDES, (x1, y1, x2, y2))])


def rect_of(prefix: str = "") -> Column:
    return rect(*[F.col(prefix + s) for s in SIDES])


def bbox_of_quad(points: ColumnLike) -> Column:
    """Bounding rectangle of an array of (x, y)."""
    xs, ys = F.transform(col(points), lambda p: p["x"]), F.transform(col(points), lambda p: p["y"])
    return rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def expand_rect(r: Column, pad_x: Column | int, pad_y: Column | int, width: Column | int, height: Column | int) -> Column:
    pad_x, pad_y, width, height = (v if isinstance(v, Column) else F.lit(v) for v in (pad_x, pad_y, width, height))
    return rect(
        F.greatest(F.lit(0), r["x1"] - pad_x), F.greatest(F.lit(0), r["y1"] - pad_y),
        F.least(width, r["x2"] + pad_x), F.least(height, r["y2"] + pad_y),
    )


def area(r: Column) -> Column:
    return (r["x2"] - r["x1"]).cast("bigint") * (r["y2"] - r["y1"])


def rects_intersect(a: Column, b: Column) -> Column:
    """Open intersection: touching edges do not count."""
    return (a["x2"] > b["x1"]) & (a["y2"] > b["y1"]) & (b["x2"] > a["x1"]) & (b["y2"] > a["y1"])


def overlap_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(wide, F.lit(0)).cast("bigint") * F.greatest(high, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def coverage(inner: Column, container: Column) -> Column:
    return overlap_area(inner, container) / F.greatest(F.lit(1), area(inner))


def gap(a: Column, b: Column) -> Column:
    """Larger of the horizontal and vertical distance."""
    wide = F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"])
    high = F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"])
    return F.greatest(wide, high, F.lit(0))


def near_limit(a: Column, b: Column) -> Column:
    short = F.least(a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])
    return F.greatest(F.lit(30.0), 1.5 * short)


def is_near(a: Column, b: Column) -> Column:
    return gap(a, b) <= near_limit(a, b)


def is_narrow(r: Column, ratio: float = 4.0) -> Column:
    return F.greatest(F.lit(1), r["y2"] - r["y1"]) / F.greatest(F.lit(1), r["x2"] - r["x1"]) >= ratio


def lines_mergeable(a: Column, b: Column, ratio: float = 1.9, gap_limit: float = 2.0, char_gap: float = 0.6,
                    align_gap: float = 1.5, size_ratio: float = 1.5, aspect_limit: float = 2.0) -> Column:
    """May two axis-aligned text lines belong to one block?"""
    aw, ah, bw, bh = (a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])
    a_font, b_font = F.least(aw, ah), F.least(bw, bh)
    font = F.least(a_font, b_font)
    dx = F.greatest(F.lit(0), F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]))
    dy = F.greatest(F.lit(0), F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]))
    dist = F.sqrt(dx * dx + dy * dy)
    turned = ((aw / ah > aspect_limit) & (bw / bh < 1 / aspect_limit)) | (
        (bw / bh > aspect_limit) & (aw / ah < 1 / aspect_limit))
    centred = F.abs(a["x1"] + F.floor(aw / 2) - b["x1"] - F.floor(bw / 2)) < align_gap
    crossed = ((aw > ah * ratio) & (bh > bw * ratio)) | ((bw > bh * ratio) & (ah > aw * ratio))
    flat = (aw > ah * ratio) | (bw > bh * ratio)
    tall = (ah > aw * ratio) | (bh > bw * ratio)
    tol = font * align_gap
    by_x = (F.abs(a["x1"] - b["x1"]) < tol) | (F.abs(a["x2"] - b["x2"]) < tol)
    by_y = (F.abs(a["y1"] - b["y1"]) < tol) | (F.abs(a["y2"] - b["y2"]) < tol)
    usable = (font > 0) & (dist <= gap_limit * font) & (F.greatest(a_font, b_font) <= size_ratio * font) & ~turned
    return usable & (dist < font * char_gap) & F.when(centred, True).when(crossed, False).when(flat, by_x).when(
        tall, by_y).otherwise(False)


def lines_mergeable_coarse(a: Column, b: Column, gap_limit: float = 2.0, size_tol: float = 0.7) -> Column:
    """Coarse form for lines of one direction."""
    aw, ah, bw, bh = (a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])
    a_font, b_font = F.least(aw, ah), F.least(bw, bh)
    dx = F.greatest(F.lit(0), F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]))
    dy = F.greatest(F.lit(0), F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]))
    same_way = (aw >= ah) == (bw >= bh)
    return same_way & (F.abs(a_font - b_font) <= size_tol * F.least(a_font, b_font)) & (
        F.sqrt(dx * dx + dy * dy) <= gap_limit * F.greatest(a_font, b_font))


def pixel_box(bbox: ColumnLike, width: ColumnLike, height: ColumnLike, min_side: float = 3) -> Column:
    """[x1, y1, x2, y2] clamped to the page, ends sorted; null when a side is under ``min_side``."""
    b = F.transform(col(bbox), lambda v: v.try_cast("double"))
    inside = lambda v, top: F.greatest(F.lit(0.0), F.least(v, col(top).cast("double")))
    xs = [inside(F.get(b, F.lit(i)), width) for i in (0, 2)]
    ys = [inside(F.get(b, F.lit(i)), height) for i in (1, 3)]
    box = rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    whole = (F.size(b) == 4) & ~F.exists(b, lambda v: v.isNull())
    big = (F.greatest(*xs) - F.least(*xs) >= min_side) & (F.greatest(*ys) - F.least(*ys) >= min_side)
    return F.when(whole & big, box)


def unit_to_pixels(x: ColumnLike, y: ColumnLike, w: ColumnLike, h: ColumnLike, width: ColumnLike, height: ColumnLike) -> Column:
    """0..1 box to whole pixels, rounding halves to even."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    px = lambda v, size: F.bround(unit(v) * col(size), 0).cast("int")
    x, y, w, h = col(x), col(y), col(w), col(h)
    return rect(px(x, width), px(y, height), px(x + w, width), px(y + h, height))


def crop_rect(x: ColumnLike, y: ColumnLike, w: ColumnLike, h: ColumnLike, width: ColumnLike, height: ColumnLike) -> Column:
    """Pixel rectangle of a crop frame; null when the frame is under 1 % or the result under 8 pixels."""
    unit = lambda v, top: F.greatest(F.lit(0.0), F.least(top, col(v)))
    one = F.lit(1.0)
    cx, cy = unit(x, one), unit(y, one)
    cw, ch = unit(w, one - cx), unit(h, one - cy)
    px = lambda v, size: F.bround(v * col(size), 0).cast("int")
    box = rect(px(cx, width), px(cy, height), px(cx + cw, width), px(cy + ch, height))
    big = (box["x2"] - box["x1"] >= 8) & (box["y2"] - box["y1"] >= 8)
    return F.when((cw >= 0.01) & (ch >= 0.01) & big, box)


def text_limits(container: Column, covered: ColumnLike) -> Column:
    """Characters per line and lines for a text inside a container; null outside one."""
    wide, high = container["x2"] - container["x1"], container["y2"] - container["y1"]
    return F.when(col(covered) > 0.4, F.struct(
        F.greatest(F.lit(6), F.floor(wide / 8).cast("int")).alias("max_chars"),
        F.greatest(F.lit(1), F.floor(high / 14).cast("int")).alias("max_lines")))


def render_rect(own: Column, container: Column, covered: ColumnLike, width: ColumnLike, height: ColumnLike) -> Column:
    """The container when it covers the text well enough, else the padded text box."""
    pad_x = F.greatest(F.lit(8), F.floor((own["x2"] - own["x1"]) * 0.30).cast("int"))
    pad_y = F.greatest(F.lit(8), F.floor((own["y2"] - own["y1"]) * 0.40).cast("int"))
    padded = expand_rect(own, pad_x, pad_y, col(width), col(height))
    return F.when(F.coalesce(col(covered), F.lit(0.0)) > 0.4, container).otherwise(padded)


def watermark_pad(own: Column, width: ColumnLike, height: ColumnLike) -> Column:
    pad_x = F.floor((own["x2"] - own["x1"]) * 0.10).cast("int") + 6
    pad_y = F.floor((own["y2"] - own["y1"]) * 0.30).cast("int") + 4
    return expand_rect(own, pad_x, pad_y, col(width), col(height))


REGION_TYPE = (
    "struct<x double, y double, w double, h double, text string, inpaint_only boolean, erase_flat boolean,"
    " erase_box boolean, flat_color string, text_color string, font string, font_size int, mask_dilate int,"
    " rotate double>"
)


def clean_region(r: Column) -> Column:
    """Validated copy of a hand-drawn region (a struct of REGION_TYPE), or null when it is degenerate."""
    unit = lambda v, top: F.greatest(F.lit(0.0), F.least(top, v))
    one = F.lit(1.0)
    x, y = unit(r["x"], one), unit(r["y"], one)
    w, h = unit(r["w"], one - x), unit(r["h"], one - y)
    yes = lambda name: F.coalesce(r[name], F.lit(False))
    flag = lambda name: F.when(yes(name), True)
    typed = ~yes("inpaint_only")
    text = strip(F.coalesce(r["text"], F.lit("")))
    font = F.substring_index(F.replace(strip(F.coalesce(r["font"], F.lit(""))), F.lit("\\"), F.lit("/")), "/", -1)
    rotate = F.when(r["rotate"].between(-180, 180) & (F.abs(r["rotate"]) > 0.01), F.round(r["rotate"], 1))
    cleaned = F.struct(
        F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(w, 5).alias("w"), F.round(h, 5).alias("h"),
        F.when(typed & (text != ""), F.left(text, F.lit(L.REGION_TEXT_MAX))).alias("text"),
        flag("inpaint_only").alias("inpaint_only"),
        flag("erase_flat").alias("erase_flat"),
        F.when(typed, flag("erase_box")).alias("erase_box"),
        F.when(yes("erase_flat"), hex_color(r["flat_color"])).alias("flat_color"),
        F.when(typed, hex_color(r["text_color"])).alias("text_color"),
        F.when(typed & F.lower(font).rlike(r"\.(?:ttf|otf)$"), F.left(font, F.lit(80))).alias("font"),
        F.when(typed & r["font_size"].between(6, 200), r["font_size"]).alias("font_size"),
        F.when(typed & r["mask_dilate"].between(0, 10), r["mask_dilate"]).alias("mask_dilate"),
        F.when(typed, rotate).alias("rotate"),
    ).cast(REGION_TYPE)
    usable = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    usable = usable & r["x"].isNotNull() & r["y"].isNotNull() & r["w"].isNotNull() & r["h"].isNotNull()
    return F.when(usable & (w >= L.REGION_MIN_SIDE) & (h >= L.REGION_MIN_SIDE), cleaned)


def clean_regions(regions: ColumnLike) -> Column:
    return F.filter(F.transform(col(regions), clean_region), lambda r: r.isNotNull())


def region_counts(regions: ColumnLike) -> Column:
    """How many regions are to be read, are typed, or are only erased."""
    only = lambda r: F.coalesce(r["inpaint_only"], F.lit(False))
    typed = lambda r: ~only(r) & (~is_blank(r["text"]) | F.coalesce(r["erase_flat"], F.lit(False)))
    count = lambda test: F.size(F.filter(col(regions), test)).cast("bigint")
    return F.struct(
        count(lambda r: ~only(r) & ~typed(r)).alias("ocr"), count(typed).alias("typed"), count(only).alias("inpaint_only"))
