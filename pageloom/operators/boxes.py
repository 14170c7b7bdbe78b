"""Regions of a page: pairing, de-duplication, grouping, derived rectangles.

Rows carry page_id, region_id and integer x1, y1, x2, y2. Pairs are found through a
grid: a rectangle is listed under every tile it reaches, tiles are joined by equality,
and a pair counts only in the tile that holds the corner of its intersection. So a
crowded page spreads over its tiles and no page meets itself as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions.predicates import has_visible_text
from pageloom.functions.text import is_watermark
from pageloom.operators.settle import CELL_ROWS, by_length, first_come, losers_of_duels, losers_to_earlier, seeds_of_groups
from pageloom.session import pin

TILE = 256
#: Tile (i, j) is number i * stride + j: apart as long as sides stay within 32 bits.
_STRIDE = 1 << 32
SIDES = list(G.SIDES)


def _tiles(x1: Column, y1: Column, x2: Column, y2: Column, tile: int) -> Column:
    span = lambda a, b: F.sequence(F.floor(a / tile), F.greatest(F.floor(a / tile), F.floor(b / tile)))
    return F.flatten(F.transform(span(x1, x2), lambda i: F.transform(span(y1, y2), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def near_pairs_of(left: DataFrame, right: DataFrame, reach: Column | int = 0, keys: Sequence[str] = ("page_id",), tile: int = TILE) -> DataFrame:
    """Pairs (a, b) whose rectangles come within ``reach`` (a column of ``left``), each exactly once.

    Columns: keys, a and b (structs of the whole rows).
    """
    r = reach if isinstance(reach, Column) else F.lit(reach)
    grown = [F.col("x1") - r, F.col("y1") - r, F.col("x2") + r, F.col("y2") + r]
    # the keys travel once, beside the rest of the row, and a tile is one number
    plain = lambda df: [c for c in df.columns if c not in keys]
    row = lambda df, side: F.struct(*[F.col(c) if c in keys else F.col(f"_{side}.{c}").alias(c) for c in df.columns]).alias(side)
    packed = lambda t: F.transform(t, lambda p: p["i"] * _STRIDE + p["j"])
    a = left.select(*keys, F.struct(*plain(left)).alias("_a"), r.alias("_r"), F.explode(packed(_tiles(*grown, tile))).alias("_t"))
    b = right.select(*keys, F.struct(*plain(right)).alias("_b"), F.explode(packed(_tiles(*[F.col(s) for s in SIDES], tile))).alias("_t"))
    pairs = a.join(b, [*keys, "_t"])
    g = {n: F.col(f"_a.{n}") + (-F.col("_r") if n.endswith("1") else F.col("_r")) for n in SIDES}
    touch = (g["x1"] <= F.col("_b.x2")) & (F.col("_b.x1") <= g["x2"]) & (g["y1"] <= F.col("_b.y2")) & (F.col("_b.y1") <= g["y2"])
    home = F.floor(F.greatest(g["x1"], "_b.x1") / tile) * _STRIDE + F.floor(F.greatest(g["y1"], "_b.y1") / tile) == F.col("_t")
    return pairs.filter(touch & home).select(*keys, row(left, "a"), row(right, "b"))


def _ordered_pairs(df: DataFrame, reach: Column | int = 0, *columns: str, tile: int = TILE) -> DataFrame:
    """Pairs with what decides them: numbers, sides and the named ``columns``."""
    slim = df.select("page_id", "region_id", *SIDES, *columns)
    return near_pairs_of(slim, slim, reach, tile=tile).filter(F.col("a.region_id") < F.col("b.region_id"))


def _ids(pairs: DataFrame, *extra: Column) -> DataFrame:
    return pairs.select("page_id", F.col("a.region_id").alias("a_id"), F.col("b.region_id").alias("b_id"), *extra)


def overlap_pairs(df: DataFrame, share: float = 0.06) -> DataFrame:
    """Pairs that overlap by more than a share of the smaller one."""
    a, b = F.col("a"), F.col("b")
    least = F.least(G.area(a), G.area(b))
    return _ids(_ordered_pairs(df).filter((least > 0) & (G.overlap_area(a, b) > share * least)))


def near_pairs(df: DataFrame) -> DataFrame:
    """Pairs close to each other, measured by the smaller one's short side."""
    short = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    reach = F.ceil(F.greatest(F.lit(30.0), 1.5 * short)).cast("int")
    return _ids(_ordered_pairs(df, reach).filter(G.is_near(F.col("a"), F.col("b"))))


def mergeable_lines(df: DataFrame, coarse: bool = False) -> DataFrame:
    font = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    test = G.lines_mergeable_coarse if coarse else G.lines_mergeable
    reach = F.ceil(font * (3.4 if coarse else 0.6)).cast("int")
    # a reach of many font sizes crosses small tiles, and a row travels once per tile
    return _ids(_ordered_pairs(df, reach, tile=2 * TILE if coarse else TILE).filter(test(F.col("a"), F.col("b"))))


def best_container(regions: DataFrame, containers: DataFrame) -> DataFrame:
    """Adds container_id, container (rectangle) and covered: the container that covers most, the first of equals."""
    a, b = F.col("a"), F.col("b")
    hits = near_pairs_of(regions, containers).select(
        "page_id", a["region_id"].alias("region_id"), b["region_id"].alias("container_id"),
        G.rect(*[b[s] for s in SIDES]).alias("container"), G.coverage(a, b).alias("covered")).filter(F.col("covered") > 0)
    order = F.struct("covered", (-F.col("container_id")).alias("o"))
    best = hits.groupBy("page_id", "region_id").agg(F.max_by(F.struct("container_id", "container", "covered"), order).alias("c"))
    return regions.join(best, ["page_id", "region_id"], "left").select(
        *regions.columns, "c.container_id", "c.container", F.coalesce("c.covered", F.lit(0.0)).alias("covered"))


def union_boxes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def _mark_area(df: DataFrame, pad: int, width: int, height: int) -> DataFrame:
    marks = union_boxes(df.filter(is_watermark("text", "ocr")), ["page_id"])
    return marks.select("page_id", G.expand_rect(G.rect_of(), pad, pad, width, height).alias("_area"))


def drop_watermark_neighbours(df: DataFrame, width: int, height: int, pad: int = 80) -> DataFrame:
    """Remove site marks and everything near their common area."""
    joined = df.join(_mark_area(df, pad, width, height), "page_id", "left")
    near = F.col("_area").isNotNull() & G.rects_intersect(G.rect_of(), F.col("_area"))
    return joined.filter(~near & ~is_watermark("text", "ocr")).drop("_area")


def erase_regions(df: DataFrame, width: int, height: int, union_pad: int = 90, logo_pad: int = 64) -> DataFrame:
    """Rectangles to erase: each text box, one area around all marks of a page, and each mark on its own."""
    mark = is_watermark("text", "ocr")
    params = lambda kind, k, n, r: [F.lit(kind).alias("kind"), F.lit(k).alias("kernel"), F.lit(n).alias("rounds"), F.lit(r).alias("radius")]
    texts = df.filter(~mark).select("page_id", "region_id", *SIDES, *params("text", 5, 2, 6))
    area = _mark_area(df, union_pad, width, height).select("page_id", F.lit(0).alias("region_id"), "_area.*", *params("wm", 9, 4, 12))
    logos = df.filter(mark).select("page_id", "region_id", G.expand_rect(G.rect_of(), logo_pad, logo_pad, width, height).alias("r"),
                                   *params("wm", 9, 4, 10)).select("page_id", "region_id", "r.*", "kind", "kernel", "rounds", "radius")
    return texts.unionByName(area).unionByName(logos)


def watermark_fill_boxes(df: DataFrame, width: int, height: int) -> DataFrame:
    """Padded boxes of the site marks whose translation shows nothing."""
    chosen = df.filter(~has_visible_text("trans") & is_watermark("text", "render"))
    padded = chosen.select("page_id", "region_id", G.watermark_pad(G.rect_of(), F.lit(width), F.lit(height)).alias("r"))
    return padded.filter((F.col("r.x2") > F.col("r.x1")) & (F.col("r.y2") > F.col("r.y1"))).select("page_id", "region_id", "r.*")


def split_glued_watermarks(lines: DataFrame) -> DataFrame:
    """lines: page_id, region_id, line_no, text, box. Regions with both kinds lose their mark lines; boxes are recomputed."""
    marked = lines.withColumn("_mark", is_watermark("text", "render"))
    per = marked.groupBy("page_id", "region_id").agg(F.count_if("_mark").alias("_m"), F.count(F.lit(1)).alias("_n"))
    mixed = (F.col("_m") > 0) & (F.col("_m") < F.col("_n"))
    kept = marked.join(per, ["page_id", "region_id"]).filter(~(mixed & F.col("_mark")))
    boxes = kept.groupBy("page_id", "region_id").agg(
        *[(F.min if s.endswith("1") else F.max)(s).alias(s) for s in SIDES], F.count(F.lit(1)).alias("lines"),
        F.max(mixed).alias("was_glued"))
    return boxes


def group_size_target(df: DataFrame, floor: int, size: str = "size", body: str = "is_body") -> DataFrame:
    """Common text size of a page: median of the sound body sizes; others are pulled towards it."""
    sound = F.col(body) & (F.col(size) >= floor)
    pages = df.groupBy("page_id").agg(
        F.count_if(F.col(body)).alias("_n"), F.median(F.when(sound, F.col(size))).alias("_sound"),
        F.median(F.when(F.col(body), F.col(size))).alias("_all"))
    target = F.when(F.col("_n") >= 2, F.greatest(F.lit(floor), F.bround(F.coalesce("_sound", "_all"), 0).cast("int")))
    joined = df.join(pages.select("page_id", target.alias("target")), "page_id")
    v, t = F.col(size), F.col("target")
    raised = F.least(t, F.greatest(v + 1, F.floor(v * 1.3).cast("int")))
    new = F.when(t.isNull(), v).when(F.col(body), F.when(t > v, raised).otherwise(t)).otherwise(F.least(v, F.floor(t * 1.8).cast("int")))
    return joined.withColumn("new_size", new)


def union_merged_regions(regions: DataFrame, merges: DataFrame) -> DataFrame:
    """regions: page_id, region_id, box, text, trans. merges: page_id, pos, cont_id, anchor_id.

    The anchor takes the text of each continuation in order, and its box while it stays near; the
    continuation keeps no translation. What is gathered per anchor is one sentence.
    """
    cont = merges.filter("cont_id <> anchor_id").join(
        regions.select("page_id", F.col("region_id").alias("cont_id"), G.rect_of().alias("_c"), F.col("text").alias("_t")), ["page_id", "cont_id"])
    parts = cont.groupBy("page_id", F.col("anchor_id").alias("region_id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "_c", "_t"))).alias("_parts"))
    gone = cont.select("page_id", F.col("cont_id").alias("region_id")).distinct().withColumn("_gone", F.lit(True))
    joined = regions.join(parts, ["page_id", "region_id"], "left").join(gone, ["page_id", "region_id"], "left")

    def step(acc: Column, part: Column) -> Column:
        c = part["_c"]
        wide = G.rect(F.least(acc["x1"], c["x1"]), F.least(acc["y1"], c["y1"]), F.greatest(acc["x2"], c["x2"]), F.greatest(acc["y2"], c["y2"]))
        return F.when(G.is_near(acc, c), wide).otherwise(acc)

    box = F.when(F.col("_parts").isNotNull(), F.aggregate("_parts", G.rect_of(), step)).otherwise(G.rect_of())
    texts = F.when(F.col("_parts").isNotNull(), F.concat("text", F.array_join(F.transform("_parts", lambda p: p["_t"]), ""))).otherwise(F.col("text"))
    return joined.select("page_id", "region_id", texts.alias("text"), F.when(F.col("_gone"), "").otherwise(F.col("trans")).alias("trans"),
                         box.alias("b")).select("page_id", "region_id", "text", "trans", "b.*")


# ---------------------------------------------------------------- order-dependent choices


def _without(df: DataFrame, lost: DataFrame) -> DataFrame:
    lost = lost.withColumn("region_id", F.col("region_id").cast(df.schema["region_id"].dataType))
    return df.join(lost, ["page_id", "region_id"], "left_anti")


def dedupe_overlaps(df: DataFrame, limit: float = 0.5, rows: int = CELL_ROWS) -> DataFrame:
    """Of two boxes that overlap by more than ``limit`` the longer text stays; decided in region order.

    A region that loses stops removing others.
    """
    a, b = F.col("a"), F.col("b")
    sized = df.withColumn("_length", F.length("text"))
    duels = pin(_ordered_pairs(sized, 0, "_length").filter(G.iou(a, b) > limit).select(
        "page_id", a["y1"].alias("y1"), a["x1"].alias("x1"), a["region_id"].cast("long").alias("i"), b["region_id"].cast("long").alias("j"),
        F.coalesce(a["_length"] >= b["_length"], F.lit(False)).alias("i_stays")))
    return _without(df, losers_of_duels(duels, rows))


def dedupe_candidates(df: DataFrame, limit: float = 0.7, rows: int = CELL_ROWS) -> DataFrame:
    """Keep a box unless an earlier kept one overlaps it by more than ``limit`` (below 1).

    All columns of ``df`` travel with their rows, so select what is wanted before. Rows that lie by page already are not dealt out again.
    """
    a, b = F.col("a"), F.col("b")
    whole, long = by_length(df, rows)
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    # of equal boxes only the first can stay, and what it loses to the others lose to as well
    firsts = long.filter(~flat).groupBy("page_id", *SIDES).agg(F.min("region_id").alias("region_id"))
    copies = long.filter(~flat).join(firsts.select("page_id", "region_id", F.lit(True).alias("_first")), ["page_id", "region_id"], "left_anti")
    rivalries = _ordered_pairs(firsts).filter(G.iou(a, b) > limit).select(
        "page_id", a["region_id"].cast("long").alias("earlier"), b["region_id"].cast("long").alias("later"), b["y1"].alias("y1"), b["x1"].alias("x1"))
    lost = losers_to_earlier(rivalries, rows).unionByName(copies.select("page_id", F.col("region_id").cast("long").alias("region_id")))
    return first_come(whole, limit).unionByName(_without(long, lost))


def group_nearby(df: DataFrame, gap: int = 18, overlap: float = 0.15, rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``group_no``: the region (smallest in reading order) a group of near regions starts from.

    A group grows against its own box until nothing more fits. Regions with an unknown side are in no group.
    """
    whole = df.dropna(subset=SIDES)
    seeds = seeds_of_groups(whole, gap, overlap, rows).select(
        "page_id", F.col("region_id").cast(df.schema["region_id"].dataType).alias("region_id"), F.col("seed").cast("int").alias("group_no"))
    return df.join(seeds, ["page_id", "region_id"])


def reading_order() -> list[Column]:
    return [F.col("y1"), F.col("x1")]


