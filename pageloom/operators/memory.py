"""Translation memory: lookup, retention, saving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import content_key, is_blank
from pageloom.sources.snapshots import folder_exists

CACHE_SCHEMA = "key string, source string, translation string, model string, src_lang string, ts timestamp"


def cache_entries(df: DataFrame, model: str = "", lang: str = "", src: str = "src", trans: str = "trans", ts: str = "ts") -> DataFrame:
    """Entries to store; blanks are never kept, the latest write to a key counts."""
    keyed = df.filter(~is_blank(src) & ~is_blank(trans)).withColumn("key", content_key(src, model, lang))
    return keyed.groupBy("key").agg(
        F.max_by(src, ts).alias("source"), F.max_by(trans, ts).alias("translation"), F.lit(model).alias("model"),
        F.lit(lang).alias("src_lang"), F.max(ts).alias("ts"))


def cache_lookup(requests: DataFrame, cache: DataFrame, model: str = "", lang: str = "", src: str = "src") -> DataFrame:
    """Adds ``cached``: the stored translation, or null for a miss."""
    keyed = requests.withColumn("key", content_key(src, model, lang))
    return keyed.join(cache.select("key", F.col("translation").alias("cached")), "key", "left")


def lru_keep(uses: DataFrame, size: int) -> DataFrame:
    """The most recently used keys (uses: key, ts)."""
    return uses.groupBy("key").agg(F.max("ts").alias("ts")).orderBy(F.col("ts").desc(), "key").limit(size)


def save_cache(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").json(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """Unreadable lines give no entry, a missing folder none at all."""
    if not folder_exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(F.col("key").isNotNull())
