"""Translations as JSON lines, reloaded by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.plans.ordered import dense_position

DUMP_SCHEMA = "page_id bigint, place bigint, trans string"


def dump_translations(df: DataFrame, path: str, keys: Sequence[str] = ("page_id",), pos: str = "seg_no", trans: str = "trans") -> None:
    """One line per segment with its place, sorted; no page has to fit into a single value."""
    placed = dense_position(df.select(*keys, pos, F.col(trans).alias("trans")), keys, pos, "_n")
    lines = placed.select(*keys, (F.col("_n") - 1).alias("place"), "trans")
    lines.repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place").write.mode("overwrite").json(path)


def load_translations(spark: SparkSession, path: str, schema: str = DUMP_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)
