"""Job journals: progress, tail, durations, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.plans.ordered import dense_position, running_sum, with_neighbours


def running_progress(journal: DataFrame, amount: Column, keys: Sequence[str] = ("run_id",), pos: str = "seq") -> DataFrame:
    """Cumulative count per run; jobs that follow each other in a run carry on."""
    return running_sum(journal, keys, pos, amount, "done")


def journal_tail(journal: DataFrame, since: int = 0, kept: int = L.JOURNAL_KEPT, keys: Sequence[str] = ("run_id",), pos: str = "seq") -> DataFrame:
    """Entries from position ``since`` (0-based) that the ring still holds, with the total."""
    placed = dense_position(journal, keys, pos, "_n").withColumn("place", F.col("_n") - 1)
    totals = journal.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    joined = placed.join(totals, list(keys))
    return joined.filter(F.col("place") >= F.greatest(F.lit(since), F.col("total") - kept)).drop("_n")


def stage_durations(journal: DataFrame, finished: Column, keys: Sequence[str] = ("run_id",), pos: str = "seq", ts: str = "ts") -> DataFrame:
    """Seconds spent in each state until the next entry; a finishing entry starts no state."""
    placed = dense_position(journal, keys, pos, "_n")
    led = with_neighbours(placed, keys, "_n", 0, 1, lambda w: {"_next": F.lead(ts).over(w)})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = led.filter(F.col("_next").isNotNull() & ~finished)
    return timed.withColumn("seconds", (micros("_next") - micros(ts)) / 1e6).drop("_next", "_n")


def token_totals(journal: DataFrame, amount: str = "amount", keys: Sequence[str] = ("run_id",), pos: str = "seq") -> DataFrame:
    return journal.groupBy(*keys).agg(F.sum(amount).alias("tokens"), F.max_by(amount, pos).alias("last_tokens"))


def run_state(journal: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counters a run shows: done, failed, entries; usable on a stream as well."""
    return journal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("type") == "done").alias("success"),
        F.count_if(F.col("type") == "error").alias("failed"),
        F.sum(F.when(F.col("type") == "progress", F.col("amount")).otherwise(0)).alias("done"))
