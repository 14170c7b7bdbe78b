"""Order-dependent columns for groups of any size.

A plain window puts a whole group into one task, so one run, folder or series
that holds a third of the rows would decide the length of the job. Here a group of
more than a block's rows is cut into blocks along its order: each block is
handled by its own window, a small table of block totals carries the effect of
the earlier blocks forward. Other groups are one block, however far apart their
positions lie, and have no totals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pageloom.session import pin

BLOCK_ROWS = 65_536


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys and keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys as one struct: equal also where a key is null, so windows and joins share one partitioning."""
    return df.withColumn("_key", F.struct(*keys)).drop(*keys)


def _unkeyed(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"_key.{c}").alias(c) if c in keys else F.col(c) for c in columns])


def _blocks(df: DataFrame, keys: Sequence[str], pos: str, rows: int, long: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """Number the blocks of the groups that have more than ``rows`` rows: one in ``rows`` at most, so their keys go to every task."""
    keyed, block = _keyed(df, keys), F.floor(F.col(pos) / F.lit(rows)).cast("bigint")
    if dense:
        return keyed.withColumns({"_long": F.lit(True), "_block": block})
    if long is None:
        long = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows).select("_key")
    else:
        long = _keyed(long.select(*keys), keys)
    marked = keyed.join(F.broadcast(long.withColumn("_long", F.lit(True))), "_key", "left")
    return marked.withColumn("_block", F.when(F.col("_long"), block).otherwise(F.lit(0).cast("bigint")))


def _carried(blocked: DataFrame, total: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """What the earlier blocks of each group amount to, one row per block that has any."""
    totals = blocked.filter("_long").groupBy("_key", "_block").agg(total.alias("_total"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", combine(F.col("_total")).over(earlier))
    return carry.filter(F.col("_carry").isNotNull()).drop("_total")


def running_sum(
    df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, rows: int = BLOCK_ROWS, long: DataFrame | None = None,
    dense: bool = False,
) -> DataFrame:
    """Sum of ``value`` up to and including the row. ``pos`` is an integer, unique within ``keys``.

    ``long`` has the keys of all groups with more than ``rows`` rows, if they are known; otherwise the rows are counted first. If it is
    empty (looked up at once), no group is cut, and the rows are read once only. Positions that are ``dense`` (see ``dense_position``) fill
    their blocks, so nothing is counted.
    """
    if long is not None and long.isEmpty():
        whole = Window.partitionBy("_key").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        summed = _keyed(df.withColumn("_value", value), keys).withColumn(out, F.sum("_value").over(whole))
        return _unkeyed(summed, keys, [c for c in df.columns if c != out] + [out])
    blocked = _blocks(df.withColumn("_value", value), keys, pos, rows, long, dense)
    inside = Window.partitionBy("_key", "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    carry = _carried(blocked, F.sum("_value"), F.sum)
    joined = blocked.withColumn("_inside", F.sum("_value").over(inside)).join(carry, ["_key", "_block"], "left")
    summed = joined.withColumn(out, F.col("_inside") + F.coalesce(F.col("_carry"), F.lit(0)))
    return _unkeyed(summed, keys, [c for c in df.columns if c != out] + [out])


def dense_position(
    df: DataFrame, keys: Sequence[str], pos: str, out: str = "position", rows: int = BLOCK_ROWS, long: DataFrame | None = None,
) -> DataFrame:
    """1, 2, 3 ... in the order of an integer that is unique within ``keys``."""
    return running_sum(df, keys, pos, F.lit(1).cast("bigint"), out, rows, long)


def carry_last(df: DataFrame, keys: Sequence[str], pos: str, value: Column, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Latest non-null ``value`` at or before the row."""
    blocked = _blocks(df.withColumn("_value", value), keys, pos, rows)
    inside = Window.partitionBy("_key", "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(pos)))
    carry = _carried(blocked, tail, lambda c: F.last(c, ignorenulls=True))
    joined = blocked.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).join(carry, ["_key", "_block"], "left")
    return _unkeyed(joined.withColumn(out, F.coalesce("_inside", "_carry")), keys, [c for c in df.columns if c != out] + [out])


def with_neighbours(
    df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
    columns: Callable[[WindowSpec], dict[str, Column]], rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns over a bounded frame around each row.

    ``pos`` must be dense (see ``dense_position``). The rows next to a block's
    edge are copied into the neighbouring block, so no frame crosses a task.
    """
    if max(before, after) > rows:
        raise ValueError("the frame must fit into one block")
    at = F.col(pos) - 1
    block, offset = F.floor(at / rows).cast("bigint"), at % rows
    homes = [F.struct(block.alias("block"), F.lit(False).alias("copy"))]
    if before:
        homes.append(F.when(offset >= rows - before, F.struct((block + 1).alias("block"), F.lit(True).alias("copy"))))
    if after:
        homes.append(F.when(offset < after, F.struct((block - 1).alias("block"), F.lit(True).alias("copy"))))
    spread = df.withColumn("_home", F.explode(F.array_compact(F.array(*homes)))).select(
        "*", F.col("_home.block").alias("_block"), F.col("_home.copy").alias("_copy")).drop("_home")
    frame = Window.partitionBy(*keys, "_block").orderBy(pos)
    return spread.withColumns(columns(frame)).filter(~F.col("_copy")).drop("_block", "_copy")


def any_order_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "position") -> DataFrame:
    """1, 2, 3 ... in any order (texts, sort keys), which must be total within ``keys``.

    Rows are laid out by range, so a large group spans many tasks. The layout is
    written to the checkpoint folder because it is read twice and a second
    sampling could cut the ranges elsewhere.
    """
    named = {f"_o{i}": c for i, c in enumerate(order)}
    marked = _keyed(df.withColumns(named), keys)
    laid = pin(marked.repartitionByRange("_key", *named).withColumn("_part", F.spark_partition_id()))
    counts = laid.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    inside = Window.partitionBy("_key", "_part").orderBy(*named)
    ranked = laid.withColumn("_inside", F.row_number().over(inside)).join(before, ["_key", "_part"])
    placed = ranked.withColumn(out, (F.col("_inside") + F.col("_before")).cast("bigint"))
    return _unkeyed(placed, keys, [c for c in df.columns if c != out] + [out])


def best_per_group(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` in every group; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: int | None = None) -> DataFrame:
    """The first ``k`` rows of every group.

    Every group is first cut at random into parts and each part keeps its own
    first ``k``; only those meet in the final window.
    """
    parts = spread or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(parts)))
    near = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(near)).filter(F.col("_rank") <= k).drop("_salt", "_rank")
    final = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= k).drop("_rank")
