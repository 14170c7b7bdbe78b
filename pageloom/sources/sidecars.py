"""JSON files with the hand-drawn regions of one image each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.geometry import REGION_TYPE
from pageloom.operators.regions import sane_dilate, sane_mode
from pageloom.sources.appended import add_batch, batches, latest, next_batch

SIDECAR_SCHEMA = f"image string, mode string, mask_dilate int, regions array<{REGION_TYPE}>"


def parse_sidecars(files: DataFrame, max_dilate: int = 6) -> DataFrame:
    """files: image, value (JSON text). Unreadable files and empty lists give no row."""
    read = files.select("image", F.from_json("value", SIDECAR_SCHEMA, {"mode": "PERMISSIVE"}).alias("s"))
    rows = read.select("image", sane_mode("s.mode").alias("mode"), sane_dilate("s.mask_dilate", max_dilate).alias("mask_dilate"),
                       F.filter("s.regions", lambda r: r.isNotNull()).alias("regions"))
    return rows.filter(F.size("regions") > 0)


def read_sidecars(spark: SparkSession, path: str, max_dilate: int = 6) -> DataFrame:
    """A folder of ``<image>.json`` files; the API form clamps the mask to 10, the batch form to 6."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    named = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("image"), "value")
    return parse_sidecars(named, max_dilate)


def write_sidecars(regions: DataFrame, path: str) -> None:
    """Add the images present to a container table: rows in ranges of images, so that a file holds many of them and its statistics tell which. What
    is there already stays; of an image's versions the last counts. An image without regions must be absent. One writer at a time."""
    spark = regions.sparkSession
    text = F.to_json(F.struct("image", "mode", "mask_dilate", "regions")).alias("value")
    rows = regions.filter(F.size("regions") > 0).select("image", text)
    add_batch(rows.repartitionByRange("image").sortWithinPartitions("image"), path, next_batch(spark, path))


def read_sidecar_table(spark: SparkSession, path: str, max_dilate: int = 10, images: Sequence[str] = ()) -> DataFrame:
    """What ``write_sidecars`` wrote; with ``images`` only theirs, found by the files' statistics."""
    rows = batches(spark, path, "image string, value string")
    chosen = rows.filter(F.col("image").isin(*images)) if images else rows
    return parse_sidecars(latest(chosen, "image"), max_dilate)


def export_sidecars(spark: SparkSession, path: str, target: str, images: Sequence[str] = ()) -> None:
    """One folder per image with its JSON text, for tools that want single files."""
    rows = batches(spark, path, "image string, value string")
    chosen = rows.filter(F.col("image").isin(*images)) if images else rows
    (latest(chosen, "image").select("image", "value").repartition("image").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("image").text(target))
