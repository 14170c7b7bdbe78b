"""Stages that call a user's function on batches of texts.

The function gets a list and returns a list of the same length. It is called inside
tasks, one call per batch; a failing batch never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import lexicon as L
from pageloom.functions.predicates import accept_translation
from pageloom.functions.text import is_blank
from pageloom.operators.segments import batch_of
from pageloom.plans.ordered import dense_position
from pageloom.session import pin

BatchFunction = Callable[[list[str]], list[str]]


def _call(fn: BatchFunction, texts: list[str], attempts: int) -> tuple[list[str], str, str | None]:
    """Results, status and the last problem; originals when no attempt gave a list of the right length."""
    problem = None
    for _ in range(attempts):
        try:
            out = fn(texts)
        except Exception as exc:  # noqa: BLE001 - reported per row
            problem = f"{type(exc).__name__}: {exc}"
            continue
        if isinstance(out, list) and len(out) == len(texts):
            return [str(o) for o in out], "ok", None
        problem = "wrong number of results"
    return list(texts), "kept_original", problem


def batch_map(df: DataFrame, fn: BatchFunction, keys: Sequence[str], pos: str, text: str = "src", out: str = "trans",
              size: int = L.SUGGESTION_BATCH, attempts: int = 3) -> DataFrame:
    """Adds ``out``, ``status`` and ``error``. Batches of ``size`` rows in the order of ``pos`` within ``keys``.

    A batch is one row of at most ``size`` texts, so batches spread over all tasks whatever the size of a key.
    """
    numbered = dense_position(df, keys, pos, "_n").withColumn("_batch", batch_of("_n", size))
    batches = numbered.groupBy(*keys, "_batch").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("items"))
    key_fields = [f for f in numbered.schema.fields if f.name in keys]
    item = T.StructType([T.StructField("p", numbered.schema[pos].dataType), T.StructField("r", T.StringType()),
                         T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    schema = T.StructType([*key_fields, T.StructField("items", T.ArrayType(item))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for items in frame["items"]:
                results, status, error = _call(fn, [i["t"] for i in items], attempts)
                answers.append([{"p": i["p"], "r": r, "status": status, "error": error} for i, r in zip(items, results)])
            yield frame[list(keys)].assign(items=answers)

    spread = batches.repartition(*keys, "_batch").drop("_batch").select(*[f.name for f in key_fields], "items")
    done = spread.mapInPandas(run, schema).select(*keys, F.explode("items").alias("i"))
    results = done.select(*keys, F.col("i.p").alias(pos), F.col("i.r").alias(out), F.col("i.status").alias("status"), F.col("i.error").alias("error"))
    return df.drop(out).join(results, [*keys, pos])


def retry_until_valid(df: DataFrame, fn: BatchFunction, keys: Sequence[str], pos: str, rounds: int = 3, text: str = "src",
                      accept: Callable[[str, str], Column] = accept_translation, size: int = L.SUGGESTION_BATCH) -> DataFrame:
    """Translate, then only the rejected rows again, up to ``rounds`` more times; what stays rejected keeps its source.

    Every round is written to the checkpoint folder: the function may answer differently when asked twice.
    """
    todo, settled = df, None
    for turn in range(rounds + 1):
        judged = pin(batch_map(todo, fn, keys, pos, text, "trans", size, attempts=1).withColumns(
            {"accepted": accept(text, "trans"), "rounds": F.lit(turn)}))
        good = judged.filter("accepted")
        settled = good if settled is None else settled.unionByName(good)
        bad = judged.filter("not accepted")
        if turn == rounds or bad.isEmpty():
            kept = bad.withColumn("trans", F.col(text))
            return settled.unionByName(kept)
        todo = bad.select(*df.columns)
    raise AssertionError("unreachable")


def fallback_stage(df: DataFrame, fn: BatchFunction, keys: Sequence[str], pos: str, first: str, text: str, size: int = L.SUGGESTION_BATCH) -> DataFrame:
    """A second function, only for the rows the first left blank; adds ``rescued``."""
    missed = df.filter(is_blank(first))
    second = batch_map(missed, fn, keys, pos, text, "_second", size)
    filled = second.withColumn(first, F.col("_second")).withColumn("rescued", ~is_blank(F.col(first)))
    return df.filter(~is_blank(first)).withColumn("rescued", F.lit(False)).unionByName(filled.select(*df.columns, "rescued"))


#: Rows that are answered together: what a task holds beside the batch it was sent.
SLICE_ROWS = 256


def row_errors(df: DataFrame, fn: Callable[[str], str], text: str, out: str = "result") -> DataFrame:
    """Apply a function per row; a failing row keeps its text and carries status and error."""
    at = df.columns.index(text)
    new = T.StructType([T.StructField(n, T.StringType()) for n in (out, "status", "error")])
    schema = T.StructType([*df.schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows = []
                for t in part.column(at):
                    t = t.as_py()
                    try:
                        rows.append((fn(t), "ok", None))
                    except Exception as exc:  # noqa: BLE001 - reported per row
                        rows.append((t, "failed", f"{type(exc).__name__}: {exc}"))
                answers = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns, *answers], schema.names)

    return df.mapInArrow(run, schema)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Count while the frame is used for something else; read ``observation.get`` after the action."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(n) for n, c in metrics.items()]), watch
