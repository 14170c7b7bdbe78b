"""Tables that are only added to: a folder per batch, written by Spark, merged when read.

A micro-batch of a stream that is replayed after a failure replaces its own folder. What a batch writes follows its own rows and not what came
before; which row of a key counts is decided at reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources.snapshots import folder_exists

BATCH = "batch"


def add_batch(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")


def batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All rows with their ``batch``; with ``before``, of earlier micro-batches only."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([], f"{schema}, {BATCH} bigint")
    found = spark.read.schema(f"{schema}, {BATCH} bigint").option("basePath", path).parquet(path)
    return found if before is None else found.filter(F.col(BATCH) < before)


def next_batch(spark: SparkSession, path: str) -> int:
    """A number above all batches there are, for tables that are not written by a stream."""
    if not folder_exists(spark, path):
        return 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return max((int(n.removeprefix(f"{BATCH}=")) + 1 for n in names if n.startswith(f"{BATCH}=")), default=0)


def latest(rows: DataFrame, *keys: str, first: bool = False) -> DataFrame:
    """The row of the last micro-batch (or the first) of each key."""
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    pick = F.min_by if first else F.max_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), BATCH).alias("_row")).select(*keys, "_row.*")
