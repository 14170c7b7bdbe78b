"""Image jobs: plain borders, crops, equal files. Pixels stay in tasks, one image per row.

Pictures go to Python row by row and not as Arrow batches: an Arrow batch is up to 10,000 rows or 64 MB, of which a worker holds several copies.
Spark hands plain functions 100 rows at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x1 int, y1 int, x2 int, y2 int>"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; an unreadable file becomes a row without pixels instead of failing the job."""
    loaded = spark.read.format("image").option("dropInvalid", "false").load(path)
    return loaded.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data",
                         (F.col("image.height") > 0).alias("readable"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing without contents; the content column is only read where it is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "modificationTime", "length")


def _border(lines: np.ndarray, tolerance: int, share: float, gap: int) -> int:
    """How many lines from the outside in belong to a border of the edge's own colour. lines: n x length x channels."""
    edge = np.median(lines[0], axis=0)
    plain = (np.abs(lines - edge).max(axis=2) <= tolerance).mean(axis=1) >= share
    at = np.flatnonzero(plain)
    if not len(at) or at[0] > gap:
        return 0
    # a run of more than `gap` other lines ends the border
    breaks = np.flatnonzero(np.diff(at) > gap + 1)
    return int(at[breaks[0]] if len(breaks) else at[-1]) + 1


def trim_box(pixels: np.ndarray, tolerance: int = 22, share: float = 0.985, gap: int = 8) -> tuple[int, int, int, int] | None:
    """Box without the plain borders; None when there is none or too little would remain."""
    a = pixels.astype(np.int16)
    high, wide = a.shape[:2]
    sides = [_border(v, tolerance, share, gap) for v in (a, a[::-1], a.swapaxes(0, 1), a[:, ::-1].swapaxes(0, 1))]
    y1, y2, x1, x2 = sides[0], high - sides[1], sides[2], wide - sides[3]
    if sides == [0, 0, 0, 0] or x2 - x1 < 8 or y2 - y1 < 8:
        return None
    return x1, y1, x2, y2


def _pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


_PICTURE = ["readable", "height", "width", "nChannels", "data"]


def _boxed(readable: bool | None, height: int, width: int, channels: int, data: bytes) -> tuple:
    if not readable:
        return None, "unreadable"
    try:
        return trim_box(_pixels(data, height, width, channels)[:, :, :3]), None
    except Exception as exc:  # noqa: BLE001 - reported per row
        return None, f"{type(exc).__name__}: {exc}"


def autotrim_boxes(images: DataFrame) -> DataFrame:
    """origin, box (null when nothing is to be trimmed), error."""
    found = F.udf(_boxed, f"box {BOX}, error string", useArrow=False)
    return images.select("origin", found(*_PICTURE).alias("found")).select("origin", "found.*")


def _cropped(readable: bool | None, height: int, width: int, channels: int, data: bytes, box: tuple | None, error: str | None) -> tuple:
    if not readable or error:
        return "failed", 0, 0, 0, b""
    if box is None:
        return "copied", width, height, channels, bytes(data)
    x1, y1, x2, y2 = box
    if x2 - x1 < 8 or y2 - y1 < 8:
        return "skipped", 0, 0, 0, b""
    part = np.ascontiguousarray(_pixels(data, height, width, channels)[y1:y2, x1:x2])
    return "cropped", part.shape[1], part.shape[0], channels, part.tobytes()


def crop_images(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes: origin, box, error. Status per image and the kept pixels."""
    made = F.udf(_cropped, "status string, width int, height int, nChannels int, data binary", useArrow=False)
    wide = images.join(boxes, "origin", "left")
    return wide.select("origin", made(*_PICTURE, "box", "error").alias("made")).select("origin", "made.*")


def duplicate_images(files: DataFrame) -> DataFrame:
    """files: path, content. Groups of equal content: digest, short form, number of files, first path."""
    keyed = files.select("path", F.sha2("content", 256).alias("digest"), F.left(F.md5("content"), F.lit(8)).alias("short"))
    return keyed.groupBy("digest", "short").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))
