"""Unique file names inside folders."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import stem, suffix
from pageloom.plans.ordered import BLOCK_ROWS, dense_position, running_sum, with_neighbours
from pageloom.session import pin

_SLOT = r"^(.+)_([1-9][0-9]{0,17})$"
_FAMILY = ["folder", "name"]
#: Families with contests are sent to every task up to this many contests.
BROADCAST_ROWS = 500_000
#: Contests that are replayed in one call.
LOT_ROWS = 4_096


def _as_slot(names: DataFrame) -> DataFrame:
    """Read ``stem_k.ext`` as slot k of the family ``stem.ext``."""
    s = stem("taken")
    return names.filter(s.rlike(_SLOT)).select(
        "folder", F.concat(F.regexp_extract(s, _SLOT, 1), suffix("taken")).alias("name"),
        F.regexp_extract(s, _SLOT, 2).cast("bigint").alias("slot"), "taken")


def _slots_before(taken: DataFrame, rows: int) -> DataFrame:
    """taken(folder, name, slot) -> the first free rank each taken slot pushes: slot minus the taken ones below it."""
    ranked = dense_position(taken, _FAMILY, "slot", "_nth", rows)
    return ranked.select(*_FAMILY, "slot", (F.col("slot") - F.col("_nth") + 1).alias("_shift_at"))


def assign_unique_names(work: DataFrame, existing: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """First free of ``name.ext``, ``name_1.ext``, ... for every row, in the order of ``idx``.

    ``work`` has folder, name, idx (unique per folder); ``existing`` has folder, name of present files.
    The requests for one name form a family whose slots are handed out in order. A
    slot is lost when the file exists, or when a request for exactly that name came
    earlier. The second case ties families to each other; their contests are replayed tree by tree.
    """
    # written down, as the tests of names would otherwise be made on every request
    firsts = pin(work.groupBy(*_FAMILY).agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_size")))
    long = firsts.filter(F.col("_size") > rows)
    ranked = dense_position(work, _FAMILY, "idx", "_rank", rows, long)
    files = existing.select("folder", F.col("name").alias("taken")).distinct()
    own = files.select("folder", F.col("taken").alias("name"), F.lit(0).cast("bigint").alias("slot"))
    fixed = _as_slot(files).select(*_FAMILY, "slot").unionByName(own).join(firsts.select(*_FAMILY), _FAMILY, "left_semi")

    # a requested name that is also slot k of another requested family, and free on disk
    free = firsts.select("folder", F.col("name").alias("taken"), "_first").join(files, ["folder", "taken"], "left_anti")
    contested = (
        _as_slot(free).join(free, ["folder", "taken"])
        .join(firsts.select(*_FAMILY, "_size"), _FAMILY)
        .select(*_FAMILY, "slot", "taken", F.col("_first").alias("_rival"))
    )
    lost = fixed
    if contests := contested.count():
        # a request that comes after all rivals of its family wins no contested slot, so its place is not needed for them
        until = contested.groupBy(*_FAMILY).agg(F.max("_rival").alias("_until"))
        until = F.broadcast(until) if contests <= BROADCAST_ROWS else until
        early = work.select(*_FAMILY, "idx").join(until, _FAMILY).filter(F.col("idx") < F.col("_until")).drop("_until")
        lost = pin(_settle(contested, fixed, dense_position(early, _FAMILY, "idx", "_rank", rows, long), contests, rows))
    shifted = _slots_before(lost, rows).groupBy(*_FAMILY, "_shift_at").agg(F.count(F.lit(1)).alias("_step"))
    steps = shifted.groupBy(*_FAMILY).agg(F.count(F.lit(1)).alias("_size"))
    long = firsts.select(*_FAMILY, "_size").unionByName(steps).groupBy(*_FAMILY).agg(F.sum("_size").alias("_size")).filter(F.col("_size") > rows)
    events = (
        ranked.withColumn("_at", 2 * F.col("_rank") - 1).withColumn("_step", F.lit(0).cast("bigint"))
        .unionByName(shifted.withColumn("_at", 2 * F.col("_shift_at")).drop("_shift_at"), allowMissingColumns=True)
    )
    placed = running_sum(events, _FAMILY, "_at", F.col("_step"), "_skipped", rows, long).filter(F.col("_rank").isNotNull())
    slot = F.col("_rank") - 1 + F.col("_skipped")
    name = F.when(slot == 0, F.col("name")).otherwise(
        F.concat(stem("name"), F.lit("_"), slot.cast("string"), suffix("name")))
    return placed.withColumn("unique_name", name).drop("_rank", "_at", "_step", "_skipped")


_BARE = r"^(.+?)(?:_[1-9][0-9]{0,17})+$"


def _settle(contested: DataFrame, fixed: DataFrame, ranked: DataFrame, contests: int, rows: int) -> DataFrame:
    """Decide each contested slot: the family keeps it when its request gets there before the rival's first. Returns all lost slots.

    A name is a slot of one family at most (its last ``_k`` taken off), so contests form trees, and all of a tree share the name without any
    ``_k`` at its end. A slot's fate follows from the family's lost slots below it: contested ones, and slot 0 if the family is itself a rival. So a
    tree is replayed from its root down, slot by slot. It needs the requests of those ranks only that can reach a contested slot. Trees are
    dealt into lots of about ``LOT_ROWS`` contests, as a call of Python for each would cost more than the replay.
    """
    numbered = dense_position(contested, _FAMILY, "slot", "_nth", rows)  # from 1
    marks = fixed.withColumn("_lost", F.lit(1).cast("bigint")).unionByName(
        contested.select(*_FAMILY, (F.col("slot")).alias("slot"), F.lit(0).cast("bigint").alias("_lost")))
    summed = running_sum(marks.groupBy(*_FAMILY, "slot").agg(F.sum("_lost").alias("_lost")), _FAMILY, "slot", F.col("_lost"), "_upto", rows)
    asked = numbered.join(summed.select(*_FAMILY, "slot", F.col("_upto").alias("_fixed")), [*_FAMILY, "slot"])
    # with none or all of the contested slots below lost, and slot 0 too
    asked = asked.withColumns({"_high": F.col("slot") + 1 - F.col("_fixed"), "_low": F.greatest(F.lit(1), F.col("slot") + 1 - F.col("_fixed") - F.col("_nth"))})
    # slots near each other are reached by the same ranks, which are listed once
    pieces = with_neighbours(asked, _FAMILY, "_nth", 1, 0, lambda w: {"_before": F.lag("_high").over(w)}, rows)
    ranks = pieces.withColumn("_first", F.greatest("_low", F.coalesce(F.col("_before") + 1, "_low"))).filter("_first <= _high").select(
        *_FAMILY, F.explode(F.sequence("_first", "_high")).alias("_rank"))
    times = ranks.join(ranked.select(*_FAMILY, "_rank", "idx"), [*_FAMILY, "_rank"])
    bare = F.concat(F.when(stem("name").rlike(_BARE), F.regexp_extract(stem("name"), _BARE, 1)).otherwise(stem("name")), suffix("name"))
    lots = contests // LOT_ROWS + 1
    tree = lambda df: df.withColumn("_lot", F.pmod(F.xxhash64("folder", bare), F.lit(lots)))
    slots = tree(asked.select(*_FAMILY, "slot", "taken", "_rival", "_fixed"))
    times = tree(times.select(*[F.col(c).alias(c) for c in [*_FAMILY, "_rank", "idx"]]))
    lost = slots.groupBy("_lot").cogroup(times.groupBy("_lot")).applyInArrow(_replay, "folder string, name string, slot long")
    return fixed.select(*_FAMILY, "slot").unionByName(lost)


def _replay(slots: pa.Table, times: pa.Table) -> pa.Table:
    """The slots that the families of the trees in one lot lose to each other."""
    when = {(f, n, r): t for f, n, r, t in zip(*(times.column(c).to_pylist() for c in ("folder", "name", "_rank", "idx")), strict=True)}
    rows = zip(*(slots.column(c).to_pylist() for c in ("folder", "name", "slot", "taken", "_rival", "_fixed")), strict=True)
    first_lost: set[tuple[str, str]] = set()
    below: dict[tuple[str, str], int] = {}
    out = []
    # a family's own name is decided with its parent, whose name is shorter
    for folder, name, slot, taken, rival, fixed in sorted(rows, key=lambda r: (len(r[1]), r[0], r[1], r[2])):
        gone = fixed + below.get((folder, name), 0) + ((folder, name) in first_lost)
        reached = when.get((folder, name, slot + 1 - gone))
        if reached is not None and reached < rival:
            first_lost.add((folder, taken))
            out.append((folder, taken, 0))
        else:
            below[folder, name] = below.get((folder, name), 0) + 1
            out.append((folder, name, slot))
    columns = zip(("folder", "name", "slot"), (pa.string(), pa.string(), pa.int64()), strict=True)
    return pa.table({c: pa.array([r[i] for r in out], kind) for i, (c, kind) in enumerate(columns)})
