"""Hard negatives by inner product, with coordinate pruning in buckets of similar length.

Rows become vectors of whole numbers and are laid out by range of (label, length, id) into parts of a bounded size; the rows of one label in
one part are a group. Anchors go to the groups they can meet (equal label for positives, any other for negatives) and whose longest vector is long
enough for the score they need; both sides come together by cogrouping on (part, label, block of anchors), so a task holds one group and
one block at a time and its size does not follow the table.

Inside a task the group's rows, longest first, form buckets. For an anchor that needs a score of at least s, a row of the bucket has to make an angle with
it of at most arccos(s / (anchor length * longest of the bucket)). For each of the anchor's ``FOCUS`` largest coordinates that angle leaves
an interval of values of the row's coordinate; the bucket's list of that coordinate, sorted, gives the rows inside, and only rows in all the intervals are
candidates. Their scores are then computed exactly. What is found raises s for the buckets that follow.

Three searches: the best rows of the anchor's own group give a first bound; all other groups of its label then give the positives;
the other labels give, for each positive, the best rows with a score between ``LOW`` percent of the positive's and the positive's.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; shorter vectors count as if filled up with zeros;
of equal scores the smaller id comes first; rows that repeat an id are rows each, as anchors, positives and negatives; a positive without such negatives has no row, nor
has an anchor without positives; an empty table gives no rows; other columns are not read. Scores are exact as long as they
fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import quoted, staged
from pageloom.llm.vectors import is_sound, matrix, padded, scaled

FACTOR, LOW, TOP = 256, 80, 5
#: Rows of a part, anchors of a block, rows of a length bucket, coordinates looked at per anchor.
PART_ROWS, BLOCK_ROWS, BUCKET_ROWS, FOCUS = 8192, 4096, 2048, 4
#: Room for rounding in lengths and angles.
SLACK = 1e-9
KEY = ["part", "label", "block"]


# -- one group ----------------------------------------------------------------------------------------------------------------

class Bucket:
    """Rows of similar length with sorted lists of their coordinates, each made when it is first asked for."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, at: np.ndarray):
        self.rows, self.at, self.longest = rows, at, float(lengths.max(initial=0.0))
        self.unit = rows / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self.lists:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self.lists[coordinate] = self.unit[order, coordinate], order
        return self.lists[coordinate]

    def candidates(self, unit: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose cosine with ``unit`` can reach ``cosine``; None stands for all."""
        if cosine > 1 + SLACK:
            return np.zeros(0, np.int64)
        widest = math.acos(min(1.0, max(0.0, cosine)))
        hits, lists = np.zeros(len(self.rows), np.int8), 0
        for f in focus.tolist():
            angle = math.acos(min(1.0, max(-1.0, unit[f])))
            values, order = self.sorted_list(f)
            low = values.searchsorted(math.cos(min(math.pi, angle + widest)) - SLACK, "left")
            high = values.searchsorted(math.cos(max(0.0, angle - widest)) + SLACK, "right")
            if high - low < len(values):
                hits[order[low:high]] += 1
                lists += 1
        return None if lists == 0 else np.flatnonzero(hits == lists)


def buckets(rows: np.ndarray, size: int) -> Iterator[Bucket]:
    lengths = np.sqrt((rows.astype(float) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    for i in range(0, len(order), size):
        at = order[i:i + size]
        yield Bucket(rows[at], lengths[at], at)


def search(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray, take: Callable[[int, np.ndarray, np.ndarray], float], bucket_rows: int = BUCKET_ROWS,
           focus: int = FOCUS, together: int = 64) -> int:
    """Call ``take(anchor, rows, scores)`` with rows that may reach the anchor's ``least`` score, bucket by bucket; it returns the score
    needed from then on. Returns how many scores were computed."""
    lengths = np.sqrt((anchors.astype(float) ** 2).sum(1))
    units = anchors / np.where(lengths > 0, lengths, 1.0)[:, None]
    chosen = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :focus]
    reach = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
    number = float if reach < 2**53 else object  # products of whole numbers are exact in doubles up to there
    verified = 0
    for bucket in buckets(rows, bucket_rows):
        held = bucket.rows.astype(number)
        for start in range(0, len(anchors), together):
            some = range(start, min(start + together, len(anchors)))
            found: list[np.ndarray] = []
            for a in some:
                span = lengths[a] * bucket.longest
                if least[a] <= 0:  # every row can reach it
                    found.append(np.arange(len(held)))
                elif span * (1 + SLACK) < least[a]:
                    found.append(np.zeros(0, np.int64))
                else:
                    rows_in = bucket.candidates(units[a], chosen[a], least[a] / span)
                    found.append(np.arange(len(held)) if rows_in is None else rows_in)
            wanted = np.unique(np.concatenate(found))
            if not len(wanted):
                continue
            scores = held[wanted] @ anchors[start:start + len(found)].astype(number).T
            for i, a in enumerate(some):
                if len(found[i]):
                    verified += len(found[i])
                    own = scores[np.searchsorted(wanted, found[i]), i]
                    least[a] = take(a, bucket.at[found[i]], own)
    return verified


def best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the first ``top`` by falling score, then id."""
    if len(scores) > 4 * top and scores.dtype != object:
        last = -np.partition(-scores, top - 1)[top - 1]
        few = np.flatnonzero(scores >= last)
        return few[np.lexsort((ids[few], -scores[few]))[:top]]
    return np.lexsort((ids, -scores))[:top]


class Tops:
    """The first rows so far of one list, with room for ``top``."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.rows = top, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids, rows = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.rows, rows])
        order = best(scores, ids, self.top)
        self.scores, self.ids, self.rows = scores[order], ids[order], rows[order]

    def full(self) -> bool:
        return len(self.scores) == self.top


def _matrices(rows: pa.Table, anchors: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return matrix(rows.column("x"), dims), matrix(anchors.column("x"), dims)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _positives(dims: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search_group(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        numbers, ids = _columns(rows, "row_no", "vec_id")
        (own,) = _columns(anchors, "anchor_no")
        tops = [Tops(top) for _ in own]
        least = anchors.column("least").to_numpy(zero_copy_only=False).astype(float)
        if rows.num_rows and anchors.num_rows:
            bound = least.copy()

            def take(a: int, at: np.ndarray, scores: np.ndarray) -> float:
                use = (numbers[at] != own[a]) & (scores >= bound[a])
                tops[a].add(scores[use], ids[at[use]], numbers[at[use]])
                return max(bound[a], float(tops[a].scores[-1])) if tops[a].full() else bound[a]

            search(*_matrices(rows, anchors, dims), np.where(np.isfinite(least), least, 0.0), take)
        return pa.table({"anchor_no": pa.array(np.repeat(own, [len(t.ids) for t in tops]), pa.int64()),
                         "positive_no": pa.array([int(r) for t in tops for r in t.rows], pa.int64()),
                         "positive_id": pa.array([int(i) for t in tops for i in t.ids], pa.int64()),
                         "positive_score": pa.array([int(s) for t in tops for s in t.scores], pa.int64())})

    return search_group


def _negatives(dims: int, top: int, low: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search_group(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        numbers, ids = _columns(rows, "row_no", "vec_id")
        (own,) = _columns(anchors, "anchor_no")
        wanted = anchors.column("scores").to_pylist()
        # by different score: equal positives share their negatives
        tops = [{int(s): Tops(top) for s in scores if s >= 0} for scores in wanted]

        def needed(a: int) -> float:
            return min((max(-(-low * s // 100), t.scores[-1] if t.full() else -math.inf) for s, t in tops[a].items()), default=math.inf)

        def take(a: int, at: np.ndarray, scores: np.ndarray) -> float:
            for s, t in tops[a].items():
                use = (100 * scores >= low * s) & (scores <= s)
                t.add(scores[use], ids[at[use]], numbers[at[use]])
            return needed(a)

        if rows.num_rows and anchors.num_rows:
            search(*_matrices(rows, anchors, dims), np.array([needed(a) for a in range(len(own))], float), take)
        out = [(int(own[a]), s, int(i), int(score)) for a in range(len(own)) for s, t in tops[a].items() for i, score in zip(t.ids, t.scores, strict=True)]
        return pa.table({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(("anchor_no", "positive_score", "negative_id", "negative_score"))})

    return search_group


# -- the table ----------------------------------------------------------------------------------------------------------------

def index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", factor: int = FACTOR,
          part_rows: int = PART_ROWS) -> tuple[DataFrame, int, int]:
    """Sound rows as written parts: part, row_no (unique), vec_id, label, x, length; the vectors' dimension; one more than the last part's number."""
    label = quoted(label) if isinstance(label, str) else label
    sound = rows.select(quoted(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), quoted(vector).alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_sound(F.col("v")))
    n, dims = sound.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = max(1, math.ceil(n / part_rows))
    x = padded(scaled(F.col("v"), factor), dims, 0)
    ready = sound.select("vec_id", "label", x.alias("x"), F.monotonically_increasing_id().alias("place")).withColumn(
        "length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)))
    # the input's place splits rows that repeat one id and vector
    laid = ready.repartitionByRange(parts, "label", F.desc("length"), "vec_id", "place").select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row_no"), "vec_id", "label", "x", "length")
    stored = staged(laid)
    return stored, dims, (stored.agg(F.max("part")).first()[0] or 0) + 1


def _met(rows: DataFrame, anchors: DataFrame, parts: int, blocks: int, find: Callable, fields: str) -> DataFrame:
    """Cogroup the index with the anchors sent to its groups (part, label: the group's; block)."""
    copies = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else rows.withColumn("block", F.lit(0))
    # work follows the pairs and not the bytes, so the number of tasks is told: up to 16 meetings of a part and a block in each
    tasks = max(min(parts * blocks, 3 * rows.sparkSession.sparkContext.defaultParallelism), parts * blocks // 16)
    # both come from one table: columns of their own keep them apart
    sent = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    return copies.repartition(tasks, *KEY).groupBy(*KEY).cogroup(sent.repartition(tasks, *KEY).groupBy(*KEY)).applyInArrow(find, fields)


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", factor: int = FACTOR,
         low: int = LOW, top: int = TOP, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``vec_id`` of the index. A negative's score lies between ``low`` percent of the positive's and the positive's.
    """
    stored, dims, parts = index(rows, vec_id, vector, label, factor, part_rows)
    groups = stored.groupBy("part", "label").agg(F.max("length").alias("longest"))
    count = stored.filter(is_anchor).count()
    blocks = max(1, math.ceil(count / block_rows))
    anchors = stored.filter(is_anchor).select(F.col("row_no").alias("anchor_no"), F.col("vec_id").alias("anchor_id"), "part", "label", "x", "length",
                                              F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int").alias("block"))
    can_reach = F.col("length") * F.col("longest") * (1 + SLACK) >= F.col("least")

    # positives: the own group first, the rest of the label with the bound it gives
    fields = "anchor_no long, positive_no long, positive_id long, positive_score long"
    near = staged(_met(stored, anchors.withColumn("least", F.lit(float("-inf"))), parts, blocks, _positives(dims, top), fields))
    bound = near.groupBy("anchor_no").agg(F.count(F.lit(1)).alias("n"), F.min("positive_score").cast("double").alias("s"))
    bounded = anchors.withColumnRenamed("part", "own").join(bound, "anchor_no", "left").withColumn(
        "least", F.when(F.col("n") >= top, F.col("s")).otherwise(float("-inf")))
    sent = bounded.join(groups, "label").filter((F.col("part") != F.col("own")) & can_reach).select(*KEY, "anchor_no", "x", "least")
    far = _met(stored, sent, parts, blocks, _positives(dims, top), fields)
    order = Window.partitionBy("anchor_no").orderBy(F.desc("positive_score"), "positive_id", "positive_no")
    positives = staged(near.unionByName(far).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top).drop("n"))

    # negatives: every part, groups of other labels
    scores = positives.groupBy("anchor_no").agg(F.collect_set("positive_score").alias("scores"))  # at most `top`
    wanted = anchors.drop("part").withColumnRenamed("label", "own").join(scores, "anchor_no").withColumn(
        "least", F.array_min(F.filter("scores", lambda s: s >= 0)) * F.lit(low / 100) * (1 - SLACK)).filter(F.col("least").isNotNull())
    sent = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(groups, "part").filter(
        (F.col("label") != F.col("own")) & can_reach).select(*KEY, "anchor_no", "x", "scores")
    found = _met(stored, sent, parts, blocks, _negatives(dims, top, low), "anchor_no long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_no", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return positives.join(ranked, ["anchor_no", "positive_score"]).join(anchors.select("anchor_no", "anchor_id"), "anchor_no").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
