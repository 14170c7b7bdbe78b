"""File listings: selection, pending work, order, retention, reports. Rows carry folder, name, length, mtime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.text import ColumnLike, col
from pageloom.functions.times import older_than
from pageloom.functions.urls import extension, folder_of, natural_key, series_root, stem
from pageloom.plans.ordered import any_order_position, top_per_group, with_neighbours


def is_folder_image(name: ColumnLike) -> Column:
    return extension(name).isin(*L.FOLDER_IMAGE_EXTENSIONS)


def list_images(files: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Image files in plain name order; ``subset`` (folder, name) narrows the choice."""
    kept = files.filter(is_folder_image("name"))
    return (kept if subset is None else kept.join(subset, ["folder", "name"], "left_semi")).orderBy("folder", "name")


def pending_outputs(images: DataFrame, outputs: DataFrame, quality: int = 95) -> DataFrame:
    """Images without an output; below full quality a ``.jpg`` twin counts as well."""
    left = images.join(outputs.select("folder", "name"), ["folder", "name"], "left_anti")
    if quality >= 100:
        return left
    own_kind = extension("name").isin("jpg", "jpeg", "webp")
    twin = F.when(~own_kind, F.concat(stem("name"), F.lit(".jpg")))
    twins = outputs.select("folder", F.col("name").alias("_twin"))
    return left.withColumn("_twin", twin).join(twins, ["folder", "_twin"], "left_anti").drop("_twin")


def match_source_image(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``source``: the image of that name, else the first image with the same stem."""
    images = sources.filter(is_folder_image("name"))
    exact = images.select("folder", "name").distinct().withColumn("_exact", F.col("name"))
    by_stem = images.groupBy("folder", F.lower(stem("name")).alias("_stem")).agg(F.min("name").alias("_alike"))
    joined = outputs.join(exact, ["folder", "name"], "left").withColumn("_stem", F.lower(stem("name")))
    return joined.join(by_stem, ["folder", "_stem"], "left").select(*outputs.columns, F.coalesce("_exact", "_alike").alias("source"))


def listing_with_region_counts(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """sidecars: folder, name (of the image), regions (number), mtime."""
    side = sidecars.select("folder", "name", F.col("regions").alias("_n"), F.col("mtime").alias("_m"))
    joined = files.filter(is_folder_image("name")).join(side, ["folder", "name"], "left")
    return joined.select("folder", "name", F.coalesce("_n", F.lit(0)).cast("bigint").alias("count"), F.greatest("mtime", "_m").alias("mtime"))


def explain_selection(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """requested: folder, name; listing adds is_file. Why a named file is or is not usable."""
    joined = requested.join(listing.select("folder", "name", "is_file"), ["folder", "name"], "left")
    reason = F.when(F.col("is_file").isNull(), "not_found").when(~F.col("is_file"), "not_a_file").when(
        ~is_folder_image("name"), "unsupported").otherwise("ok")
    return joined.select(*requested.columns, reason.alias("reason"))


def resolve_config_file(folders: DataFrame, listing: DataFrame, file_name: str) -> DataFrame:
    """First existing of: the folder itself, its parent, the series root; else the place in the series root."""
    at = F.array(F.col("folder"), folder_of("folder"), series_root("folder"))
    tries = folders.select("folder", F.posexplode(at).alias("priority", "_dir"))
    there = listing.filter(F.col("name") == file_name).select(F.col("folder").alias("_dir"))
    found = tries.join(there, "_dir", "left_semi").groupBy("folder").agg(F.min_by("_dir", "priority").alias("_dir"))
    path = F.concat_ws("/", F.coalesce("_dir", series_root("folder")), F.lit(file_name))
    return folders.join(found, "folder", "left").select("folder", path.alias("path"), F.col("_dir").isNotNull().alias("exists"))


def natural_place(files: DataFrame, tie: str = "file_id") -> DataFrame:
    """Adds ``place``, the position in natural name order within the folder."""
    return any_order_position(files, ["folder"], [natural_key("name"), F.col(tie)], "place")


def neighbours_in_order(files: DataFrame, tie: str = "file_id") -> DataFrame:
    """Previous and next name, position and number of siblings."""
    sizes = files.groupBy("folder").agg(F.count(F.lit(1)).alias("siblings"))
    sides = with_neighbours(natural_place(files, tie), ["folder"], "place", 1, 1,
                            lambda w: {"previous": F.lag("name").over(w), "following": F.lead("name").over(w)})
    return sides.join(sizes, "folder")


def newest_then_natural(files: DataFrame, limit: int = 0) -> DataFrame:
    """The newest files by time, shown in natural name order, with the total before the limit."""
    images = files.filter(is_folder_image("name"))
    total = images.agg(F.count(F.lit(1)).alias("n")).scalar()
    chosen = images.orderBy(F.col("mtime").desc(), F.col("name").desc()).limit(limit) if limit > 0 else images
    return chosen.withColumn("total", total).orderBy(natural_key("name"), "name")


def retention_prune(files: DataFrame, now: Column, max_days: int = L.THUMB_MAX_DAYS, max_files: int = L.THUMB_MAX_FILES,
                    tie: str = "file_id") -> DataFrame:
    """Files to delete: too old, or beyond the newest ``max_files`` of their folder."""
    kept = top_per_group(files.select("folder", "mtime", tie), ["folder"], [F.col("mtime").desc(), F.col(tie).desc()], max_files)
    fresh = kept.filter(~older_than("mtime", now, max_days))
    return files.join(fresh.select(tie), tie, "left_anti")


def compression_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row over the files present in both listings (key: file_id)."""
    pairs = before.select("file_id", F.col("length").alias("b")).join(after.select("file_id", F.col("length").alias("a")), "file_id")
    sums = pairs.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"))
    mb = lambda c: F.round(F.col(c) / 1048576, 2)
    saved = F.when(F.col("b") > 0, F.round((F.col("b") - F.col("a")) / F.col("b") * 100, 1)).otherwise(0.0)
    return sums.select("files", F.col("b").alias("bytes_before"), F.col("a").alias("bytes_after"), mb("b").alias("mb_before"),
                       mb("a").alias("mb_after"), saved.alias("saved_pct"))


def crop_report(outcomes: DataFrame, shown: int = 20, key: str = "run_id") -> DataFrame:
    """outcomes: key, name, status. Counts and the first names of each unhappy status, per key."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    totals = outcomes.groupBy(key).agg(*[count(s) for s in ("cropped", "copied", "skipped", "failed", "ignored")])
    few = top_per_group(outcomes.filter(F.col("status").isin("skipped", "failed", "ignored")), [key, "status"], [F.col("name")], shown)
    names = few.groupBy(key).agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("name")))), ",").alias(f"{s}_detail")
        for s in ("skipped", "failed", "ignored")])
    return totals.join(names, key, "left")
