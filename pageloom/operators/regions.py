"""Hand-drawn regions of images: saving, spreading, clearing, placing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import geometry as G
from pageloom.functions.text import ColumnLike, col, let

EMPTY = f"array<{G.REGION_TYPE}>"


def sane_mode(mode: ColumnLike) -> Column:
    m = F.coalesce(col(mode), F.lit("merge"))
    return F.when(m.isin("merge", "replace"), m).otherwise("merge")


def sane_dilate(value: ColumnLike, high: int = 10) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(high), F.coalesce(col(value), F.lit(1))))


def save_regions(submitted: DataFrame) -> DataFrame:
    """submitted: image, mode, mask_dilate, regions. Cleaned rows; an image without a usable region is absent."""
    cleaned = submitted.select("image", sane_mode(F.lower(F.trim("mode"))).alias("mode"), sane_dilate("mask_dilate").alias("mask_dilate"),
                               G.clean_regions("regions").alias("regions"))
    return cleaned.filter(F.size("regions") > 0)


def merge_saved(current: DataFrame, submitted: DataFrame) -> DataFrame:
    """Next snapshot: a submitted image replaces its row, or removes it when nothing usable is left."""
    return current.join(submitted.select("image"), "image", "left_anti").unionByName(save_regions(submitted))


def clear_regions(current: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The remaining rows, and the number of cleared ones."""
    asked = names.select("image").distinct()
    cleared = current.join(asked, "image", "left_semi").agg(F.count(F.lit(1)).alias("cleared"))
    return current.join(asked, "image", "left_anti"), cleared


def _same_box(r: Column) -> Column:
    flag = lambda n: F.coalesce(r[n], F.lit(False)).alias(n)
    return F.struct(*[F.round(r[n], 4).alias(n) for n in "xywh"], flag("inpaint_only"), flag("erase_flat"))


def _lacking(own: Column, offered: Column) -> Column:
    """The offered regions whose box is not among ``own``, each box once, in their order. Boxes are sorted, and equal ones stand together."""
    at = lambda r, i: F.struct(_same_box(r).alias("box"), i.alias("at"))
    boxes = F.array_sort(F.concat(F.transform(own, lambda r: at(r, F.lit(-1))), F.transform(offered, at)))
    new = lambda every: F.filter(every, lambda b, i: (b["at"] >= 0) & ((i == 0) | (F.get(every, i - 1)["box"] != b["box"])))
    return F.transform(F.array_sort(F.transform(let(boxes, new), lambda b: b["at"])), lambda i: F.get(offered, i))


def broadcast_regions(current: DataFrame, template: DataFrame, images: DataFrame, overwrite: bool = False) -> DataFrame:
    """Give the one region set of ``template`` (mode, mask_dilate, regions) to every image of ``images``.

    The template is one row and enters as scalar values. Merging keeps an image's own regions and
    settings and adds the boxes it lacks; other images stay as they are.
    """
    one = template.select(F.struct(sane_mode("mode").alias("mode"), sane_dilate("mask_dilate").alias("dilate"),
                                   G.clean_regions("regions").alias("regions")).alias("t")).scalar()
    target = images.select("image").distinct().join(current, "image", "left").withColumn("_t", one)
    if overwrite:
        new = target.select("image", "_t.mode", F.col("_t.dilate").alias("mask_dilate"), "_t.regions")
    else:
        def add(own: Column) -> Column:
            return F.concat(own, _lacking(own, F.col("_t.regions")))

        own = F.coalesce("regions", F.array().cast(EMPTY))
        new = target.select("image", sane_mode("mode").alias("mode"), sane_dilate("mask_dilate").alias("mask_dilate"),
                            let(own, add).alias("regions"))
    return current.join(images.select("image"), "image", "left_anti").unionByName(new)


def region_mix(current: DataFrame) -> DataFrame:
    return current.select("image", G.region_counts("regions").alias("n")).select("image", "n.*")


def regions_to_pixels(manual: DataFrame, detected: DataFrame, sizes: DataFrame) -> DataFrame:
    """manual: image, mode, regions; detected: image, x1..y2; sizes: image, width, height.

    ``replace`` drops what was detected, ``merge`` keeps it; boxes under two pixels are left out, and an
    image none of whose boxes is usable stays as detected.
    """
    boxes = manual.select("image", "mode", F.explode("regions").alias("r")).join(sizes, "image").select(
        "image", "mode", G.unit_to_pixels("r.x", "r.y", "r.w", "r.h", "width", "height").alias("b"))
    drawn = boxes.filter((F.col("b.x2") - F.col("b.x1") >= 2) & (F.col("b.y2") - F.col("b.y1") >= 2)).select(
        "image", "mode", "b.*", F.lit("manual").alias("origin"))
    replaced = drawn.filter("mode = 'replace'").select("image").distinct()
    kept = detected.select("image", *G.SIDES, F.lit("detected").alias("origin")).join(replaced, "image", "left_anti")
    return kept.unionByName(drawn.drop("mode"))


def split_manual_jobs(images: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with regions, and the images the automatic pass still handles (all but ``replace``)."""
    manual = images.join(sidecars.filter(F.size("regions") > 0).select("image", "mode"), "image")
    return manual, images.join(manual.filter("mode = 'replace'").select("image"), "image", "left_anti")


