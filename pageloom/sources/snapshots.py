"""Versioned table folders: a new version is complete before the pointer names it."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from pageloom.session import checkpoint_dir

TERM_SCHEMA = ("term_id bigint, zh string, vi string, enabled boolean, sources array<string>, created timestamp,"
               " updated timestamp")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder on the shared storage the session names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


class StoreChanged(RuntimeError):
    """Another writer added a version since this one began."""


def _store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _latest(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 without one. The pointer log is a folder of one short file per version, named by number."""
    store, folder = _store(spark, path)
    if not store.exists(folder):
        return 0
    return max((int(f.getPath().getName()) for f in store.listStatus(folder) if f.getPath().getName().isdigit()), default=0)


def current_version(spark: SparkSession, path: str) -> str | None:
    number = _latest(spark, path)
    return spark.read.text(f"{path}/versions/{number:018d}").first()["value"] if number else None


def write_snapshot(df: DataFrame, path: str, partitions: int | None = None) -> str:
    """Write the next version beside the old one, then add its pointer. Readers never see a half table. The pointer's number
    follows the version that was current when the write began and is never overwritten: of two writers the later one fails."""
    spark = df.sparkSession
    number, version = _latest(spark, path) + 1, f"v-{uuid.uuid4().hex}"
    out = df if partitions is None else df.repartition(partitions)
    out.write.mode("errorifexists").parquet(f"{path}/{version}")
    store, folder = _store(spark, path)
    if _latest(spark, path) >= number:
        raise StoreChanged(f"{path} got another version meanwhile")
    try:
        pointer = store.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:018d}"), False)
    except Py4JJavaError as error:
        raise StoreChanged(f"{path} got another version meanwhile") from error
    pointer.write(bytearray(version.encode()))
    pointer.close()
    return version


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    version = current_version(spark, path)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{version}")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path, TERM_SCHEMA)
