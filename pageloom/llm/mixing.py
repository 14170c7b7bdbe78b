"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its target bytes over its bytes. Each document's count is the inverse of the Poisson distribution
at a uniform number hashed from seed and document id; the document is exploded by its count and everything is shuffled globally by a
hash of (seed, document, replica). Rates above ``CHUNK`` are cut into equal parts with a uniform number each, as a sum of Poisson
counts is Poisson; so no rate is too large for the table of the distribution.

Defined cases: a null source is a source of its own; a source without a given weight gets weight 0 and goes; a null text has size 0;
a source without bytes has rate 0; rows of one document id get one count; a null id is the empty id; an empty table gives no rows;
input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import packed, quoted, staged, unit_md5

SEED = 23
#: Target weights follow bytes to this power: under 1 small sources gain, large ones lose.
ALPHA = 0.7
CHUNK = 16.0


def temperature_weights(sizes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(source, weight) from (source, bytes)."""
    return sizes.select("source", F.pow(F.col("bytes").cast("double"), F.lit(alpha)).alias("weight"))


def source_rates(df: DataFrame, weights: DataFrame | None = None, source: str = "source", text: str = "text",
                 target_bytes: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, bytes, rate): mean repetitions that bring each source to its share of ``target_bytes`` (default: all bytes)."""
    sizes = staged(df.select(quoted(source).alias("source"), F.coalesce(F.octet_length(quoted(text)), F.lit(0)).alias("b"))
                   .groupBy("source").agg(F.sum("b").cast("long").alias("bytes")))
    weights = (weights if weights is not None else temperature_weights(sizes, alpha)).select(F.col("source").alias("w_source"), "weight")
    both = sizes.join(weights, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "bytes", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = both.agg(F.sum("weight").alias("weights"), F.sum("bytes").alias("all_bytes")).first()
    target = float(target_bytes if target_bytes is not None else sums["all_bytes"] or 0)
    share = F.col("weight") / F.lit(float(sums["weights"] or 1.0))
    return both.select("source", "bytes", F.when(F.col("bytes") > 0, share * F.lit(target) / F.col("bytes")).otherwise(F.lit(0.0)).alias("rate"))


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... for a mean up to ``CHUNK``, closed by 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["sums"], F.element_at(acc["sums"], -1) + p).alias("sums"))

    return F.array_append(F.aggregate(F.sequence(F.lit(1), last), start, step)["sums"], F.lit(1.0))


def replicated(df: DataFrame, rates: DataFrame, doc_id: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """All columns of ``df`` with rate, n_copies, replica (from 1) and mix_key, exploded by count, in globally shuffled order."""
    parts = F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int")
    table = staged(rates.select(F.col("source").alias("r_source"), "rate", parts.alias("parts"))
                   .withColumn("cdf", distribution(F.col("rate") / F.col("parts"))))
    rows = df.select(packed(df, "rate", "n_copies", "replica", "mix_key").alias("record"), quoted(doc_id).alias("id"), quoted(source).alias("src"))
    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + F.size(
        F.filter("cdf", lambda c: c <= unit_md5(seed, part, F.col("id")))))
    # sources meet their rates by broadcast while the table is small; a large one is joined by shuffle, where AQE splits hot sources
    counted = (rows.join(table, F.col("src").eqNullSafe(F.col("r_source")))
               .select("record", "id", "rate", count.alias("n_copies")).filter(F.col("n_copies") > 0))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("replica")).cast("binary"))
    copies = (counted.select("record", "id", "rate", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("replica"))
              .select("record.*", "rate", "n_copies", "replica", key.alias("mix_key"))
              .withColumn("__spread", F.monotonically_increasing_id()))
    # the place in the input spreads rows that repeat one id
    return copies.repartition("mix_key", "__spread").sortWithinPartitions("mix_key").drop("__spread")


def mix_sources(df: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                target_bytes: int | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    return replicated(df, source_rates(df, weights, source, text, target_bytes, alpha), doc_id, source, seed)
