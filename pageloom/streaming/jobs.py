"""Incremental forms. Nothing here waits for event time: the rules count pages and rows, or follow arrival."""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from pageloom.functions import lexicon as L
from pageloom.functions.predicates import has_vietnamese_marks
from pageloom.functions.text import is_blank, strip
from pageloom.operators.context import story_line
from pageloom.operators.journal import run_state
from pageloom.operators.memory import CACHE_SCHEMA, cache_entries, cache_lookup
from pageloom.operators.segments import budgeted_selection, enforce_terms
from pageloom.operators.stages import BatchFunction, batch_map
from pageloom.operators.terms import learn_pending, load_enabled, precedence_union
from pageloom.session import pin
from pageloom.sources.snapshots import read_terms
from pageloom.sources.appended import BATCH, add_batch, batches, latest

BatchSink = Callable[[DataFrame, int], None]

#: Distinct texts that are numbered together before they are cut into calls.
PART_TEXTS = 10_000


def stream_progress(journal: DataFrame) -> DataFrame:
    """Latest counters per run; write in update or complete mode."""
    return run_state(journal)


def stream_distinct(rows: DataFrame, keys: list[str], lateness: str | None = None, ts: str = "ts") -> DataFrame:
    """Drop keys seen before. Without ``lateness`` every key is remembered for ever; with it, state is bounded."""
    if lateness is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def stream_journal(journal: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append every entry to the log files; the tail is read from there. Runs are a column, not folders: they are many."""
    return (journal.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint))


#: Rows and characters of a frame that a state handler returns.
FRAME_ROWS, FRAME_CHARS = 5_000, 4_000_000


def _in_order(frames: Iterator[pd.DataFrame], pos: str) -> Iterator[tuple]:
    """Rows of one key in the order of ``pos``: those of a micro-batch come unordered, and are held as far as it has any of the key, packed
    as Arrow; an object is made of a row when its turn comes."""
    parts = [pa.Table.from_pandas(part, preserve_index=False) for part in frames]
    if not parts:
        return
    parts = pa.concat_tables(parts, promote_options="permissive")
    row = namedtuple("Row", parts.column_names)
    # a stable order: of equal positions the first to come stays first
    order = np.argsort(parts.column(pos).to_numpy(), kind="stable")
    columns = [parts.column(name) for name in parts.column_names]
    for k in order.tolist():
        yield row(*[c[k].as_py() for c in columns])


class RecentContext(StatefulProcessor):
    """Last pairs and last pages of a series as state, told with each segment before it is added.

    A page is added when a segment of the next one comes; until then its lines wait, so a page may go over several micro-batches.
    """

    def __init__(self, pairs: int, pages: int, chars: int):
        self.kept_pairs, self.kept_pages, self.chars = pairs, pages, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getListState("pairs", "pair string")
        self.pages = handle.getListState("pages", "story string")
        self.open_page = handle.getValueState("page", "page_id long, story string")

    def _story(self, lines: str | None, line: str) -> str:
        # what stands further in front than this can never show
        return (line if lines is None else f"{lines} / {line}")[-self.chars - 1:]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pairs, pages = [p[0] for p in self.pairs.get()], [p[0] for p in self.pages.get()]
        page, story = self.open_page.get() if self.open_page.exists() else (None, None)
        out, chars = [], 0
        for row in _in_order(rows, "seg_id"):
            if page is not None and row.page_id != page and story is not None:
                pages = [*pages, story][-self.kept_pages:]
            if row.page_id != page:
                page, story = int(row.page_id), None
            told = " / ".join(pages)
            out.append((key[0], row.seg_id, len(pairs), "\n".join(pairs), "…" + told[-self.chars:] if len(told) > self.chars else told))
            if row.pair is not None:
                pairs = [*pairs, row.pair][-self.kept_pairs:]
            if row.line is not None:
                story = self._story(story, row.line)
            chars += len(out[-1][3]) + len(out[-1][4])
            if len(out) == FRAME_ROWS or chars >= FRAME_CHARS:
                yield pd.DataFrame(out, columns=["series_id", "seg_id", "n", "recent", "pages"])
                out, chars = [], 0
        for state, items in ((self.pairs, pairs), (self.pages, pages)):
            if items:  # an empty list is no state
                state.put([(i,) for i in items])
        self.open_page.update((page, story))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "seg_id", "n", "recent", "pages"])

    def close(self) -> None:
        pass


def stream_recent_context(segments: DataFrame, pairs: int = L.CONTEXT_PAIRS, pages: int = L.CONTEXT_PAGES, chars: int = L.CONTEXT_CHARS) -> DataFrame:
    """segments: series_id, page_id, seg_id, src, trans. With each segment: n and ``recent`` (the pairs before it), ``pages`` (the Vietnamese lines of the
    last pages before its own, the end of them). Batches must arrive in the order of ``seg_id`` within a series, pages one after the other."""
    both = ~is_blank("src") & ~is_blank("trans")
    ready = segments.select(
        "series_id", "page_id", "seg_id", F.when(both, F.concat(strip("src"), F.lit(" => "), strip("trans"))).alias("pair"),
        F.when(has_vietnamese_marks("trans"), story_line("trans", chars)).alias("line"))
    return ready.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=RecentContext(pairs, pages, chars), outputStructType="series_id long, seg_id long, n long, recent string, pages string",
        outputMode="Append", timeMode="None")


_WAITING = "page_id long, seg_id long, src string, trans string"


class LearningBatches(StatefulProcessor):
    """Translated segments of a series, held until ``every`` pages are complete and then released together.

    The pages held and their segments are state; the next page's first segment completes the last one.
    """

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getListState("pages", "page_id long")
        self.waiting = handle.getListState("waiting", _WAITING)
        self.released = handle.getValueState("released", "rounds long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rounds = self.released.get()[0] if self.released.exists() else 0
        held, pages = None, [p[0] for p in self.pages.get()]
        fresh: list[tuple] = []
        for row in _in_order(rows, "seg_id"):
            page = int(row.page_id)
            if page not in pages and len(pages) == self.every:
                held = [tuple(w) for w in self.waiting.get()] if held is None else held
                out = [(key[0], rounds, *w) for w in (*held, *fresh)]
                for at in range(0, len(out), FRAME_ROWS):
                    yield pd.DataFrame(out[at:at + FRAME_ROWS], columns=["series_id", "round", "page_id", "seg_id", "src", "trans"])
                held, fresh, pages, rounds = [], [], [], rounds + 1
            if page not in pages:
                pages.append(page)
            fresh.append((page, int(row.seg_id), row.src, row.trans))
        if held is not None:  # something was released
            self.released.update((rounds,))
            self.waiting.put(fresh)
        else:
            self.waiting.appendList(fresh)
        self.pages.put([(p,) for p in pages])

    def close(self) -> None:
        pass


def stream_learning_batches(segments: DataFrame, every: int = L.LEARN_EVERY_PAGES) -> DataFrame:
    """segments: series_id, page_id, seg_id, src, trans, in the order of ``seg_id`` within a series. Each segment comes out with the ``round`` of its
    series that it belongs to once the round's pages are complete."""
    return segments.select("series_id", "page_id", "seg_id", "src", "trans").groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=LearningBatches(every), outputStructType=f"series_id long, round long, {_WAITING}", outputMode="Append", timeMode="None")


def still_waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Segments of rounds that the stream with this checkpoint has not released, from its state."""
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return state.select(F.col("key.*"), F.col("list_element.*"), F.lit(-1).cast("long").alias("round")).toDF(
        "series_id", "page_id", "seg_id", "src", "trans", "round")


LEARNED_SCHEMA = "pos bigint, zh string, vi string, source string"
Extract = Callable[[DataFrame], DataFrame]


def learned_of(rows: DataFrame, extract: Extract) -> DataFrame:
    """What is learned from released segments; ``extract`` turns chosen pairs (series_id, round, src, trans, seg_id) into pairs (pos, zh, vi, source)."""
    return extract(budgeted_selection(rows, ["series_id", "round"], "seg_id")).select("pos", "zh", "vi", "source")


def learn_sink(path: str, extract: Extract) -> BatchSink:
    """Learns from released rounds and adds what it learned as the micro-batch's part of ``path``."""
    return lambda batch, number: add_batch(learned_of(batch, extract), path, number)


def learn_rest(spark: SparkSession, checkpoint: str, path: str, extract: Extract) -> None:
    """After the last micro-batch: learn from what waits, as one more part (its number is above all others)."""
    add_batch(learned_of(still_waiting(spark, checkpoint), extract), path, 2**62)


def learned_terms(store: DataFrame, path: str, now: Column) -> DataFrame:
    """The store with everything learned so far: of several translations of a new term the one that stands first (pos) counts."""
    return learn_pending(store, batches(store.sparkSession, path, LEARNED_SCHEMA).drop(BATCH), now)


def progress_sink(path: str) -> BatchSink:
    """Keeps the runs that a micro-batch changed (update mode)."""
    return lambda batch, number: add_batch(batch, path, number)


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    return latest(batches(spark, path, "run_id bigint, entries bigint, success bigint, failed bigint, done bigint"), "run_id")


def live_terms_sink(store_path: str, series_terms: DataFrame, write: Callable[[DataFrame, int], None]) -> BatchSink:
    """Enforces the terms approved at the time of each micro-batch; a change counts for later pages only."""

    def sink(batch: DataFrame, batch_no: int) -> None:
        approved = load_enabled(read_terms(batch.sparkSession, f"{store_path}/terms"))
        shared = approved.select("zh", "vi", F.col("term_id").alias("pos"))
        write(enforce_terms(batch, precedence_union(series_terms, shared, ["zh"]), ["series_id", "seg_id"]), batch_no)

    return sink


def cached_translate_sink(cache_path: str, fn: BatchFunction, write: Callable[[DataFrame, int], None], model: str = "", lang: str = "") -> BatchSink:
    """Hits come from the cache, misses go through the function once per distinct text and are added to the cache."""

    def sink(batch: DataFrame, batch_no: int) -> None:
        spark = batch.sparkSession
        looked = pin(cache_lookup(batch, cache_of(spark, cache_path, batch_no), model, lang))
        missing = looked.filter("cached is null").groupBy("key").agg(F.min("src").alias("src"))
        # parts by hash, as many as the batch needs, each numbered from 1
        parts = max(1, math.ceil(missing.count() / PART_TEXTS))
        part = F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")
        keyed = missing.select("key", "src", part).withColumn("pos", F.row_number().over(Window.partitionBy("part").orderBy("key")))
        made = pin(batch_map(keyed, fn, ["part"], "pos").select("key", "src", "trans", F.current_timestamp().alias("ts")))
        add_batch(cache_entries(made.select("src", "trans", "ts"), model, lang), cache_path, batch_no)
        filled = looked.join(made.select("key", F.col("trans").alias("_t")), "key", "left")
        write(filled.select(*batch.columns, F.coalesce("cached", "_t").alias("translation"), F.col("cached").isNotNull().alias("hit")), batch_no)

    return sink


def cache_of(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The cache that micro-batches have added to; of entries for one key the first counts."""
    return latest(batches(spark, path, CACHE_SCHEMA, before), "key", first=True)
