"""Quality classifier by importance resampling: a document's weight is the ratio of two generative models over hashed n-grams, one of
target text, one of the raw corpus; documents are drawn without replacement by Gumbel top-k.

Features of a text: single words and marks, neighbouring pairs, and the shapes of words (case, digits, length class, whether a word
repeats the one before) alone and in runs of three, all hashed to ``BUCKETS`` buckets. The raw model counts every document; the target
model counts a bounded sample of rows labelled good. Counts are added up per task, then over tasks: at most ``BUCKETS`` rows
reach the driver, and a table of that size is sent out.

The number k of documents to draw is the number whose weight per feature reaches a cut; the cut is the one that best separates the half
of the labelled sample that the target model has not seen. Which documents are drawn is decided by weight plus Gumbel noise, hashed from seed and id.

Defined cases: a null or blank text has no features, weight 0, and is drawn like any other; null labels are no labels; a document
with several labels counts once, good only if all its labels are good; without labels of both kinds everything is kept;
documents that tie with the k-th are kept; rows of one id share the noise; an empty table gives no rows; input columns named like
an output column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import packed, quoted, staged

BUCKETS = 1 << 15
#: Labelled rows the target model and the cut are fitted on, at most.
SAMPLE = 20_000
SEED = 31
#: Features' worth of the raw model that is mixed into the target model: a small sample says little about rare buckets.
PRIOR = 10 * BUCKETS
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_BLOCK, _GATHERED = 1 << 18, 1 << 20


class Seen(dict):
    """Token -> hash of its lower case (32 bits) and shape (above them); remembers tokens up to a bound."""

    MOST = 500_000

    def __missing__(self, token: str) -> int:
        first = token[0]
        if not (first.isalpha() or first.isdigit()):
            kind = 8 + zlib.crc32(token[:4].encode("utf-8", "replace")) % 1000
        elif first.isdigit():
            kind = 7
        elif len(token) > 1 and token.isupper():
            kind = 1
        elif token.islower():
            kind = 2
        elif token[1:].islower() or len(token) == 1:
            kind = 3
        else:
            kind = 4
        known = zlib.crc32(token.lower().encode("utf-8", "replace")) | (kind * 4 + min(3, len(token) // 6)) << 32
        if len(self) < self.MOST:
            self[token] = known
        return known


class Features:
    """Bucket numbers of texts."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, Seen().__getitem__

    def blocks(self, text: str | None) -> Iterator[np.ndarray]:
        """Bucket numbers, a bounded stretch of text at a time; neighbours across stretches are kept."""
        text = text or ""
        last, at = np.zeros(0, np.uint64), 0
        while at < len(text):
            # a stretch ends where the token ends that its last place falls into
            rest = _TOKEN.match(text, at + _BLOCK) if at + _BLOCK < len(text) else None
            end = rest.end() if rest else at + _BLOCK
            tokens = _TOKEN.findall(text, at, end)
            at = end
            if tokens:
                part = np.fromiter(map(self.known, tokens), np.uint64, len(tokens))
                yield self._numbers(last, part)
                last = np.concatenate([last, part])[-3:]  # the third tells whether the second repeats it

    def _numbers(self, last: np.ndarray, part: np.ndarray) -> np.ndarray:
        both = np.concatenate([last, part])
        skip = len(last)
        word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
        same = np.zeros(len(both), np.uint64)
        same[1:] = word[1:] == word[:-1]
        shape = shape * np.uint64(2) + same
        k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        pair = word[:-1] * k1 + word[1:] * k2 + np.uint64(1)
        runs = shape[:-2] * k1 + shape[1:-1] * k2 + shape[2:] * k3 + np.uint64(3)
        rows = [word[skip:] * k3, pair[max(0, skip - 1):], shape[skip:] * k2 + np.uint64(2), runs[max(0, skip - 2):]]
        mixed = np.concatenate(rows)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * k1
        return ((mixed >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, counts = Features(), np.zeros((2, BUCKETS), np.int64)
    held: tuple[list, list] = [], []
    n = 0

    def added() -> None:
        for row, parts in zip(counts, held, strict=True):
            if parts:
                row += np.bincount(np.concatenate(parts), minlength=BUCKETS)
                parts.clear()

    for batch in batches:
        for text, good in zip(batch.column("text"), batch.column("good").to_pylist(), strict=True):
            for numbers in features.blocks(text.as_py()):
                held[0].append(numbers)
                if good:
                    held[1].append(numbers)
                n += len(numbers)
            if n >= _GATHERED:
                added()
                n = 0
    added()
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "raw", "target"])


def labelled_sample(labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id") -> DataFrame:
    """(label_id, good, fits): at most about ``sample`` labelled ids, chosen by hash; half of them fit the target model, half the cut. Good: quality 1 and not toxic; ids with quality 1 that
    are toxic are neither."""
    each = (labels.filter(quoted(doc_id).isNotNull() & F.col("quality").isNotNull()).groupBy(quoted(doc_id).alias("label_id"))
            .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")))
    clear = staged(each.filter((F.col("quality") == 0) | (F.col("toxic") == 0)).select("label_id", (F.col("quality") == 1).alias("good")))
    share = min(1.0, sample / max(1, clear.count()))
    h = F.xxhash64("label_id", F.lit(SEED))
    return staged(clear.filter(F.pmod(h, F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).withColumn("fits", F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 0))


def log_ratios(docs: DataFrame, sample: DataFrame, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(target model / raw model) of every bucket."""
    good = F.broadcast(sample.filter("good and fits").select("label_id", "good"))  # at most SAMPLE rows
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text")).join(good, F.col("id") == F.col("label_id"), "left").select(
        "text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = rows.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, BUCKETS))
    for bucket, raw, target in sums.collect():  # one row per bucket
        counts[:, bucket] = raw, target
    n_raw, n_target = counts.sum(axis=1)
    raw = (counts[0] + 1 / BUCKETS) / (n_raw + 1)
    return np.log((counts[1] + PRIOR * raw) / (n_target + PRIOR)) - np.log(raw)


def weigher(ratios: np.ndarray):
    """A column function text -> struct(n_features, log_weight)."""
    sent = ratios.astype(np.float64)

    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features()
        for part in texts:
            rows = []
            for text in part:
                n, total = 0, 0.0
                for numbers in features.blocks(text):
                    n += len(numbers)
                    total += float(sent[numbers].sum())
                rows.append((n, total))
            yield pd.DataFrame(rows, columns=["n_features", "log_weight"])

    weigh.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(weigh, "n_features long, log_weight double")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(unit))


def best_cut(scored: DataFrame, sample: DataFrame) -> float | None:
    """The weight per feature that separates good and bad labelled documents best (mean of both shares); None without both kinds."""
    known = scored.filter("n_features > 0").join(F.broadcast(sample.filter("not fits")), F.col("doc_id") == F.col("label_id"))
    rows = known.select((F.col("log_weight") / F.col("n_features")).alias("w"), "good").groupBy("good").agg(
        F.percentile("w", [i / 1000 for i in range(1001)]).alias("at"), F.count(F.lit(1)).alias("n")).collect()
    marks = {r["good"]: np.array(r["at"]) for r in rows if r["n"]}
    if len(marks) < 2:
        return None
    grid = np.unique(np.concatenate([marks[True], marks[False]]))
    kept = 1 - np.searchsorted(marks[True], grid, side="left") / len(marks[True])
    gone = np.searchsorted(marks[False], grid, side="left") / len(marks[False])
    value = kept + gone
    best = np.flatnonzero(value >= value.max() - 1e-9)
    lowest, highest = grid[best[0]], grid[best[-1]]
    return float((lowest + highest) / 2)


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a long column ``q``, found digit by digit with three small counts."""
    if k <= 0:
        return None
    low, left = None, k
    for shift in (32, 16, 0):
        part = keys if low is None else keys.filter(F.shiftright("q", shift + 16) == low)
        bins = part.groupBy(F.shiftright("q", shift).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()
        for b, n in bins:
            if left <= n:
                low = b
                break
            left -= n
        else:
            return None
    return low


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, k: int | None = None,
             seed: int = SEED) -> tuple[DataFrame, Column, Column]:
    """(scored, key, kept): one row (doc_id, n_features, log_weight, q) per document, written; the key column for any frame with
    log_weight and doc_id; and the condition on ``q`` under which a document is drawn."""
    chosen = labelled_sample(labels, sample)
    ratios = log_ratios(docs, chosen, doc_id, text)
    weigh = weigher(ratios)
    key = F.round((F.col("log_weight") + gumbel(F.col("doc_id"), seed)) * F.lit(float(1 << 20))).cast("long")
    scored = staged(docs.select(quoted(doc_id).alias("doc_id"), weigh(quoted(text)).alias("s")).select("doc_id", "s.*").withColumn("q", key))
    if k is None:
        cut = best_cut(scored, chosen)
        k = scored.filter((F.col("n_features") == 0) | (F.col("log_weight") >= F.lit(cut) * F.col("n_features"))).count() if cut is not None else None
    least = kth_largest(scored.select("q"), k) if k is not None else None
    return scored, weigh, (F.col("q") >= F.lit(least)) if least is not None else F.lit(k is None or k > 0)


def selection(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_features, log_weight, gumbel_key, kept."""
    scored, _, kept = resample(docs, labels, doc_id, text, **options)
    return scored.select("doc_id", "n_features", "log_weight", (F.col("q") / F.lit(float(1 << 20))).alias("gumbel_key"), kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns; texts are weighed again where they lie, which moves none of them."""
    _, weigh, kept = resample(docs, labels, doc_id, text, **options)
    seed = options.get("seed", SEED)
    rows = docs.select(packed(docs).alias("record"), quoted(doc_id).alias("doc_id"), weigh(quoted(text)).alias("s"))
    key = F.round((F.col("s.log_weight") + gumbel(F.col("doc_id"), seed)) * F.lit(float(1 << 20))).cast("long")
    return rows.withColumn("q", key).filter(kept).select("record.*")
