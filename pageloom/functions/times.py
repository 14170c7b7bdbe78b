"""Time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import ColumnLike, col


def touch_time(now: Column | None = None) -> Column:
    """Write time at second precision; tests pass a fixed one."""
    return F.date_trunc("second", now if now is not None else F.current_timestamp())


def older_than(ts: ColumnLike, now: Column, days: int) -> Column:
    return col(ts) < now - F.make_interval(days=F.lit(days))


def backoff_seconds(attempt: ColumnLike, kind: str = "exponential", base: float = 1.0) -> Column:
    """Wait before an attempt: doubling up to 30, linear up to 60, or one and a half seconds per try."""
    n = col(attempt).cast("double")
    if kind == "exponential":
        return F.when(n > 0, F.least(F.pow(F.lit(2.0), n), F.lit(30.0))).otherwise(0.0)
    if kind == "linear":
        return F.least(F.lit(float(base)) * n, F.lit(60.0))
    return 1.5 * n
