"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass 1 scatters records to memory-sized buckets by a seeded hash of the record's place in the input, so that equal or repeated
records spread like any others. Pass 2 takes each bucket as one array, permutes it (Spark's ``shuffle`` is a Fisher-Yates shuffle)
and writes it to the shared folder. The written buckets, one after the other, are the shuffled order; shards are equal stretches of it.

Law: ``rows`` - the counts of any two shards differ by one at most. A bucket is put in the order of its records' numbers before it is
permuted, so the seed decides the result: another run over the same files and split settings, or a task run again, gives the same shards and slots.

Defined cases: null texts count as empty; repeated rows, null ids and ties are separate records; an empty table gives no rows; with
fewer records than shards the last shards in number stay without records here and there; input columns named like an output column
are replaced by it. One record larger than a bucket is a bucket of its own size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import packed, quoted, staged

SHARDS = 40
BUCKET_BYTES = 32 << 20
SEED = 17
OUTPUT = ("size", "shard", "slot")


def shuffled(df: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, reserved: tuple = OUTPUT) -> DataFrame:
    """(bucket, place, size, record): the written result of both passes."""
    size = (F.coalesce(F.octet_length(quoted(text)), F.lit(0)).cast("long") + 16).alias("size")
    total = df.select(size).agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    numbered = df.select(F.monotonically_increasing_id().alias("no"), size, packed(df, *reserved).alias("record"))
    scattered = numbered.select(F.pmod(F.xxhash64(F.lit(seed), F.col("no")), F.lit(buckets)).cast("int").alias("bucket"), F.struct("no", "size", "record").alias("r"))
    # one bucket per partition: nothing but its own records is in memory with it
    arrays = scattered.repartitionById(buckets, "bucket").groupBy("bucket").agg(F.collect_list("r").alias("rs"))
    # records arrive as the network has it; by number they have one order, which the seed permutes
    by_number = F.array_sort("rs", lambda a, b: F.when(a["no"] < b["no"], -1).when(a["no"] > b["no"], 1).otherwise(0))
    return staged(arrays.select("bucket", F.posexplode(F.shuffle(by_number, seed)).alias("place", "r"))
                  .select("bucket", "place", "r.size", "r.record"))


def shard_records(df: DataFrame, shards: int = SHARDS, text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """All columns of ``df`` with size, shard (0 to shards-1) and slot (gapless from 0 in each shard)."""
    order = shuffled(df, text, bucket_bytes, seed)
    # one row per bucket, whatever the number of records
    counts = order.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = staged(counts.select("bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total")))
    placed = (order.join(firsts, "bucket").withColumn("at", F.col("first") + F.col("place"))
              .withColumn("shard", F.expr(f"cast(at * {shards} div total as int)")))
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.select("record.*", "size", "shard", (F.col("at") - start).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
