"""Journals of runs: append-only, a run that starts anew hides its earlier entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL_SCHEMA = "run_id bigint, seq bigint, ts timestamp, type string, msg string"


def write_journal(journal: DataFrame, path: str) -> None:
    """Write whole runs. The generation replaces what earlier calls wrote for the same runs; no folder per run is needed."""
    stamped = journal.withColumn("generation", F.unix_micros(F.current_timestamp()))
    (stamped.repartitionByRange("run_id", "seq").sortWithinPartitions("run_id", "seq")
     .write.mode("append").parquet(path))


def read_journal(spark: SparkSession, path: str, schema: str = JOURNAL_SCHEMA) -> DataFrame:
    """The newest generation of every run."""
    entries = spark.read.schema(f"{schema}, generation bigint").parquet(path)
    newest = entries.groupBy("run_id").agg(F.max("generation").alias("generation"))
    return entries.join(newest, ["run_id", "generation"], "left_semi").drop("generation")
