"""Choices that depend on an order, settled in cells.

A decision about a region needs the decisions about its earlier neighbours. Rows are laid out by range of (page, top edge), so a cell is a
strip of a crowded page, or many small pages, and holds a bounded number of rows. In every round a task plays its cell in order as far as what
it knows allows, and only what reaches over a cell's border is handed on. A round leaves little open: pages that lie in one cell are
done in the first, and of a page that spans cells the decisions of at least its first open one become final, so the number of rounds follows the
cells that the longest chain of decisions crosses, and not the rows, pages or groups.

Where a decision takes nothing but a page's own rows, pages that fit a cell need no layout by place: their rows meet in a task, which finds the pairs as
it plays, so neither pairs nor what becomes of them travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import pin

#: Rows of a cell, on average.
CELL_ROWS = 16_384
#: Of pages that fit a cell: regions played at a time, and pairs tested at a time.
BLOCK_ROWS, PIECE_PAIRS = 2_048, 1 << 18
_PLACE = ["page_id", "y1", "x1", "region_id"]


def in_cells(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """Adds ``cell``, counted along ``order``; rows that are equal in all of it share a cell."""
    parts = max(1, math.ceil(df.count() / rows))
    return pin(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("cell", F.spark_partition_id()))


def _lists(table: pa.Table | pa.RecordBatch, *names: str) -> list[list]:
    return [table.column(n).to_pylist() for n in names]


# -- pages that fit a cell ------------------------------------------------------------------------------------------------------


def by_length(df: DataFrame, rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows of pages that fit a cell, and the rest, pinned: rows of longer pages or without a page. Only the pages are counted; those longer than a cell
    are fewer than there are cells, and their numbers are broadcast."""
    sizes = df.groupBy("page_id").agg(F.count(F.lit(1)).alias("_rows"))
    rest = F.col("page_id").isNull() | (F.col("_rows") > rows)
    if not sizes.agg(F.count_if(rest)).first()[0]:
        return df, df.limit(0)
    long = sizes.filter(rest).select("page_id", F.lit(True).alias("_rest"))
    marked = df.join(F.broadcast(long), "page_id", "left")
    apart = F.col("page_id").isNull() | F.col("_rest").isNotNull()
    return marked.filter(~apart).select(*df.columns), pin(marked.filter(apart).select(*df.columns))


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a page ends, of rows in order of page and ``_turn``, and for each row the number of its page in the table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        page = np.cumsum(table.column("_turn").to_numpy() == 1)
        # the last page may go on
        done = int(np.searchsorted(page, page[-1])) if len(page) else 0
        if done:
            yield table.slice(0, done), page[:done]
            held = table.slice(done).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.cumsum(table.column("_turn").to_numpy() == 1)


def _pieces(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with low[i] <= j < high[i], some at a time."""
    counts = np.maximum(high - low, 0)
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - counts[first] + PIECE_PAIRS, "right")))
        n = counts[first:last]
        i = np.repeat(np.arange(first, last), n)
        yield i, np.arange(len(i)) + np.repeat(low[first:last] - (np.cumsum(n) - n), n)
        first = last


def _stay(page: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes (none of them flat; pages ascend, within a page as they are played) overlap no earlier one that stays by more than ``limit``."""
    size = (x2 - x1) * (y2 - y1)
    edges, place = np.unique(np.concatenate([y1, y2]), return_inverse=True)
    top, bottom = page * len(edges) + place[:len(page)], page * len(edges) + place[len(page):]
    stays = np.ones(len(page), bool)

    def rivals(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of a and those of b, in order of their tops, from ``low`` on that begin above its bottom: pairs that overlap by more than the limit."""
        for i, j in _pieces(low, np.searchsorted(top[b], bottom[a])):
            i, j = a[i], b[j]
            wide = np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j])
            met = wide > 0
            i, j, wide = i[met], j[met], wide[met]
            common = wide * (np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]))
            hit = common / (size[i] + size[j] - common) > limit
            yield i[hit], j[hit]

    for start in range(0, len(page), BLOCK_ROWS):
        block = np.arange(start, min(start + BLOCK_ROWS, len(page)))
        begun = int(np.searchsorted(page, page[start]))
        if begun < start:
            # the block goes on with a page: what stays of it before the block is known
            before, mine = begun + np.flatnonzero(stays[begun:start]), block[page[block] == page[start]]
            before, mine = before[np.argsort(top[before])], mine[np.argsort(top[mine])]
            for _, j in rivals(before, mine, np.searchsorted(top[mine], top[before])):
                stays[j] = False
            for i, _ in rivals(mine, before, np.searchsorted(top[before], top[mine], "right")):
                stays[i] = False
            block = block[stays[block]]
        block = block[np.argsort(top[block])]
        pairs = [np.concatenate(p) for p in zip(*rivals(block, block, np.arange(1, len(block) + 1)), strict=True)] or [block[:0]] * 2
        earlier, later = np.minimum(*pairs), np.maximum(*pairs)
        order = np.argsort(earlier)
        for i, j in zip(earlier[order].tolist(), later[order].tolist(), strict=True):
            if stays[i]:
                stays[j] = False
    return stays


def _first_come(limit: float):
    """Rows in order of page and turn, without those that an earlier one which stays overlaps by more than ``limit``."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, page in _whole_pages(batches):
            named = [table.column(n) for n in ("region_id", "x1", "y1", "x2", "y2")]
            x1, y1, x2, y2 = (pc.fill_null(c.cast(pa.int64()), 0).to_numpy() for c in named[1:])
            plays = np.logical_and.reduce([c.is_valid().to_numpy() for c in named]) & (x2 > x1) & (y2 > y1)
            if plays.any() and max((x2 - x1)[plays].max(), (y2 - y1)[plays].max()) >= 1 << 31:
                raise OverflowError("a side of a box is longer than 32 bits hold")
            kept = np.ones(len(page), bool)
            kept[plays] = _stay(page[plays], x1[plays], y1[plays], x2[plays], y2[plays], limit)
            yield from table.drop_columns("_turn").filter(pa.array(kept)).to_batches()

    return play


def first_come(whole: DataFrame, limit: float) -> DataFrame:
    """Rows of ``whole`` (page_id, region_id, integer x1, y1, x2, y2 and others; pages that fit a cell) whose box no earlier one of the page that stays
    overlaps by more than ``limit``. Flat boxes and rows with an unknown side or region stay and remove none."""
    # the window brings a page's rows together, which a task then has whole, in order and beside other pages
    turns = whole.withColumn("_turn", F.row_number().over(Window.partitionBy("page_id").orderBy("region_id")))
    return turns.sortWithinPartitions("page_id", "region_id").mapInArrow(_first_come(limit), whole.schema)


# -- kept unless an earlier kept rival is there -----------------------------------------------------------------------------------


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rivalries (page, earlier, later, known: the earlier one's fate if decided before) of one cell, those of a region together."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None:
        return
    rivals = sorted(zip(*_lists(table, "page_id", "later", "earlier", "known"), strict=True), key=lambda r: r[:3])
    mine = {r[:2] for r in rivals}
    kept: dict[tuple[int, int], bool | None] = {}
    for page, later, earlier, known in rivals:
        if known is None and (page, earlier) in mine:
            known = kept[page, earlier]  # smaller, so played before
        now = kept.get((page, later), True)
        # lost to one that stays for good; open while one is open
        kept[page, later] = False if now is False or known else None if now is None or known is None else True
    yield pa.RecordBatch.from_pydict({"page_id": pa.array([k[0] for k in kept], pa.int64()), "later": pa.array([k[1] for k in kept], pa.int64()),
                                      "keep": pa.array(list(kept.values()), pa.bool_())})


def losers_to_earlier(rivalries: DataFrame, rows: int = CELL_ROWS) -> DataFrame:
    """rivalries: page_id, earlier, later (region numbers), y1, x1 (of the later one). A region stays unless one of its earlier rivals
    stays. Returns page_id, region_id of those that go."""
    contested = rivalries.select("page_id", F.col("later").alias("earlier")).distinct().withColumn("contested", F.lit(True))
    # one without earlier rivals stays
    todo = pin(rivalries.join(contested, ["page_id", "earlier"], "left").select(
        "page_id", "earlier", "later", "y1", "x1", F.when(F.col("contested").isNull(), True).alias("known")))
    lost = None
    while True:
        laid = todo.repartitionByRange(max(1, math.ceil(todo.count() / rows)), "page_id", "y1", "x1", "later")
        solved = pin(laid.select("page_id", "later", "earlier", "known").mapInArrow(_choose, "page_id long, later long, keep boolean"))
        gone = solved.filter(~F.col("keep")).select("page_id", F.col("later").alias("region_id"))
        lost = gone if lost is None else lost.unionByName(gone)
        open_ = solved.filter(F.col("keep").isNull()).select("page_id", "later")
        if open_.isEmpty():
            return lost
        decided = solved.filter(F.col("keep").isNotNull()).select("page_id", F.col("later").alias("earlier"), "keep")
        todo = pin(todo.join(open_, ["page_id", "later"], "left_semi").join(decided, ["page_id", "earlier"], "left").select(
            "page_id", "earlier", "later", "y1", "x1", F.coalesce("known", "keep").alias("known")))


# -- duels in order -----------------------------------------------------------------------------------------------------------

NOBODY, FIRST, SECOND = 0, 1, 2


def _duel(duels: pa.Table, elsewhere: pa.Table) -> pa.Table:
    """Play the duels (page, i, j, i stays) of a cell in order; ``elsewhere``: open duels (page, h, n) of other cells against one of its regions."""
    lost: dict[tuple[int, int], int] = {}
    # smallest first side of an open duel against a region
    threat: dict[tuple[int, int], int] = {}
    for page, h, n in zip(*_lists(elsewhere, "page_id", "i", "j"), strict=True):
        threat[page, n] = min(h, threat.get((page, n), h))
    rows = sorted(zip(*_lists(duels, "page_id", "i", "j", "i_stays"), strict=True))
    results, turn, over, unsure = [], None, False, False
    for page, i, j, stays in rows:
        if turn != (page, i):
            turn, over, unsure = (page, i), False, (page, i) in threat
        if over or (page, i) in lost or lost.get((page, j), i) < i:
            result = NOBODY
        elif unsure or threat.get((page, j), i) < i:
            result, unsure = None, True
            threat[page, j] = min(i, threat.get((page, j), i))
        elif stays:
            result = SECOND
            lost[page, j] = min(i, lost.get((page, j), i))
        else:
            result, over = FIRST, True
        results.append(result)
    columns = list(zip(*rows, strict=True))
    return pa.table({"page_id": pa.array(columns[0], pa.int64()), "i": pa.array(columns[1], pa.int64()), "j": pa.array(columns[2], pa.int64()),
                     "result": pa.array(results, pa.int32())})


def losers_of_duels(duels: DataFrame, rows: int = CELL_ROWS) -> DataFrame:
    """duels: page_id, i < j, i_stays, y1, x1 (of i). Played by i, then j; a region that lost plays no more. Returns page_id, region_id of the losers."""
    todo, lost = duels, None
    while True:
        laid = in_cells(todo, ["page_id", "y1", "x1", "i"], rows)
        sides = laid.select("page_id", F.col("i").alias("n"), F.col("cell").alias("target")).union(laid.select("page_id", "j", "cell")).distinct()
        threats = laid.select("page_id", "i", "j", "cell").join(sides.withColumnRenamed("n", "j"), ["page_id", "j"]).filter("target <> cell").select(
            F.col("target").alias("cell"), *[F.col(c).alias(c) for c in ("page_id", "i", "j")])
        played = pin(laid.select("cell", "page_id", "i", "j", "i_stays").groupBy("cell").cogroup(threats.groupBy("cell")).applyInArrow(
            _duel, "page_id long, i long, j long, result int"))
        second = played.filter(F.col("result") == SECOND).groupBy("page_id", F.col("j").alias("region_id")).agg(F.min("i").alias("turn"))
        gone = second.select("page_id", "region_id").union(played.filter(F.col("result") == FIRST).select("page_id", "i"))
        lost = gone if lost is None else lost.union(gone)
        open_ = played.filter(F.col("result").isNull()).select("page_id", "i", "j")
        if open_.isEmpty():
            return lost.distinct()
        out = second.select("page_id", F.col("region_id").alias("n"), "turn")
        todo = pin(laid.drop("cell").join(open_, ["page_id", "i", "j"], "left_semi")
                   .join(out.select("page_id", F.col("n").alias("i")), ["page_id", "i"], "left_anti")
                   .join(out.select("page_id", F.col("n").alias("j"), "turn"), ["page_id", "j"], "left")
                   .filter(F.col("turn").isNull() | (F.col("turn") >= F.col("i"))).drop("turn"))
        if todo.isEmpty():
            return lost.distinct()


# -- groups that grow ---------------------------------------------------------------------------------------------------------


def _grown(gap: int, share: float):
    """Function over the regions a cell sees; ``taken``: the earlier cell, if any, whose group has the region; ``upto``: last cell seen, ``ends``: last cell
    of the page. Rows: kind 0 an own region and its seed, 1 a later cell's region and the seed that claims it, 2 the cell has to see further."""

    def grow(table: pa.Table) -> pa.Table:
        cell = table.column("target")[0].as_py()
        rows = sorted(zip(*_lists(table, *_PLACE, "x2", "y2", "cell", "taken", "upto", "ends"), strict=True))
        rows = [r for r in rows if r[7] is None or r[7] >= cell]
        out, blind, used = [], False, [False] * len(rows)
        for i, (page, y1, x1, seed, x2, y2, home, _, upto, ends) in enumerate(rows):
            if used[i] or home != cell:
                continue
            used[i] = True
            out.append((0, page, seed, seed))
            grew, first = True, i + 1
            while grew:
                grew, gx1, gy1, gx2, gy2 = False, x1, y1, x2, y2
                limit, k = gy2 + gap, first
                while k < len(rows):
                    r = rows[k]
                    if r[0] != page or r[1] > limit:
                        break
                    if not used[k]:
                        span, common = max(r[4], gx2) - min(r[2], gx1), min(r[4], gx2) - max(r[2], gx1)
                        if gy1 - r[5] <= gap and span > 0 and common > share * span:
                            used[k] = grew = True
                            out.append((int(r[6] != cell), page, r[3], seed))
                            x1, y1, x2, y2 = min(x1, r[2]), min(y1, r[1]), max(x2, r[4]), max(y2, r[5])
                    elif k == first:
                        first += 1
                    k += 1
                # the page goes on where this cell does not see it
                blind |= ends > upto and (k == len(rows) or rows[k][0] != page)
        if blind:
            out.append((2, None, None, None))
        return pa.table({"cell": pa.array([cell] * len(out), pa.int32()), "kind": pa.array([r[0] for r in out], pa.int32()),
                         **{n: pa.array([r[k + 1] for r in out], pa.int64()) for k, n in enumerate(("page_id", "region_id", "seed"))}})

    return grow


def seeds_of_groups(regions: DataFrame, gap: int, share: float, rows: int = CELL_ROWS) -> DataFrame:
    """regions: page_id, region_id, x1, y1, x2, y2. Groups start from the first free region by (y1, x1, region_id) and take in whatever fits their
    box, until nothing does. Returns page_id, region_id, seed.

    A group only takes regions below its seed. So a cell grows the groups that start in it, seeing the following cells as far as they are of its
    last page, and claims what it takes there; the claim of the earliest cell counts. Cells that a changed claim concerns play again.
    """
    laid = in_cells(regions.select("page_id", F.col("region_id").cast("long").alias("region_id"), "x1", "y1", "x2", "y2"), _PLACE, rows)
    ends = pin(laid.groupBy("page_id").agg(F.min("cell").alias("begins"), F.max("cell").alias("ends")).filter("begins < ends"))
    fields = "cell int, kind int, page_id long, region_id long, seed long"
    # Pages that go on, and cells that start one, are no more than there are cells: sent to all tasks, so that the rows of other pages stay where they are.
    crossing = pin(laid.join(F.broadcast(ends.select("page_id")), "page_id", "left_semi"))
    # cells that start a page which goes on, and how many cells further they see
    sights = ends.withColumn("target", F.explode(F.expr("sequence(begins, ends - 1)"))).select(
        "target", "page_id", "ends", F.lit(1).alias("sight"), F.lit(True).alias("dirty"))
    known, dirty = None, None
    while True:
        own = laid.withColumn("target", F.col("cell"))
        widest = sights.agg(F.max("sight")).first()[0] or 1

        def seen_from(df: DataFrame) -> DataFrame:
            """Rows of ``crossing``, once for each earlier cell that sees them."""
            near = df.withColumn("target", F.explode(F.expr(f"sequence(cell - {widest}, cell - 1)")))
            return near.join(F.broadcast(sights.select("target", "page_id", "sight")), ["target", "page_id"]).filter(F.col("cell") <= F.col("target") + F.col("sight")).drop("sight")

        further = seen_from(crossing).select(*laid.columns, "target")
        if known is None:
            seen = own.unionByName(further).withColumn("taken", F.lit(None).cast("int"))
        else:
            claims = known.filter("kind = 1").groupBy("page_id", "region_id").agg(F.min("cell").alias("taken"))
            seen = own.unionByName(further).join(dirty, "target", "left_semi").join(claims, ["page_id", "region_id"], "left")
        seen = seen.join(F.broadcast(sights.select("target", "page_id", "ends", (F.col("target") + F.col("sight")).alias("upto"))), ["target", "page_id"], "left").select(
            "target", *_PLACE, "x2", "y2", "cell", "taken", F.coalesce("upto", F.lit(0)).alias("upto"), F.coalesce("ends", F.lit(0)).alias("ends"))
        played = pin(seen.groupBy("target").applyInArrow(_grown(gap, share), fields))
        new = played if known is None else pin(known.join(dirty.withColumnRenamed("target", "cell"), "cell", "left_anti").unionByName(played))
        first = lambda df: df.filter("kind = 1").groupBy("page_id", "region_id").agg(F.min("cell").alias("by"))
        changed = first(new) if known is None else first(new).join(first(known).withColumnRenamed("by", "before"), ["page_id", "region_id"], "full_outer") \
            .filter(~F.col("by").eqNullSafe(F.col("before")))
        blind = played.filter("kind = 2").select(F.col("cell").alias("target")).distinct().withColumn("blind", F.lit(True))
        # a region's claim concerns its own cell and those that see it
        homes = crossing.select("page_id", "region_id", "cell").join(changed.select("page_id", "region_id"), ["page_id", "region_id"], "left_semi")
        watching = seen_from(homes).select("target")
        dirty = pin(homes.select(F.col("cell").alias("target")).union(watching).union(blind.select("target")).distinct())
        known = new
        if dirty.isEmpty():
            break
        sights = pin(sights.join(blind, "target", "left").select("target", "page_id", "ends", F.when(F.col("blind"), 2 * F.col("sight")).otherwise(F.col("sight")).alias("sight")))
    return known.filter("kind < 2").groupBy("page_id", "region_id").agg(F.min_by("seed", "cell").alias("seed"))
