"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Words and pairs of neighbouring words of the training documents are counted over the whole corpus: each task adds up blocks of hashes
before the shuffle, the shuffle adds up the rest. A count c is quantised to level q = 1 + floor(log2 c), and the pairs (n-gram,
1), ..., (n-gram, q) go into a Bloom filter. The filter is built in slices by hash of the n-gram, one task's memory each; a slice has
``BITS`` bits per entry at every size. All slices together are sent to the workers while they fit ``MAX_FILTER_MB``; beyond that they
stay rows of the written model: blocks of texts, ``BLOCK_BYTES`` each, send their distinct n-grams to the slices, the levels found come back
to the block, one byte each, and the block is scored where they meet. Both ways read the same filter and give the same scores.
A count is read by probing levels 1, 2, ... until one is missing; level q stands for the mean of its range. The filter never
misses a stored level; it may report one too many.

p(w | v) = (c(v w) + PRIOR * p(w)) / (c(v) + PRIOR), p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)); pair counts and those of rarer words
come from the filter, the ``FREQUENT`` most frequent words are held exactly (16 bytes each). The first word follows the start mark.

The base score needs the exact count of every token: frequent words are looked up in the table that is sent out anyway; what is left,
rarer words, meets the counts by a join. N, V and counts cover every training document.

Defined cases: a null text is empty and has the end token only; a null id counts as the empty id text, whose checksum 0 holds
it out; rows of one id stay separate and all count; with no training documents all counts are 0; an empty table gives no rows;
other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import quoted, staged

BITS, HASHES = 8, 3
MAX_FILTER_MB = 128
FREQUENT = 1 << 19
PRIOR = 5.0
SMOOTH = 0.1
#: Entries that one task gathers for a slice, about.
SLICE_TOKENS = 500_000
#: Text that asks the slices together, and n-grams in one row of a question.
BLOCK_BYTES, ASKED = 4_000_000, 1 << 10
END, START = b"\n", b"\t"  # no word holds either
_BUFFER, _SEEN, _PART = 1_000_000, 200_000, 1 << 17
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SLICE_FIELDS = "slice int, bits long, filter binary, words array<long>, counts array<long>"
ASK_FIELDS = "block long, slice int, part int, asked binary"
REPLY_FIELDS = "block long, slice int, part int, found binary"
SCORE_FIELDS = "row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<long>"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K1
    return x ^ (x >> np.uint64(29))


class Seen(dict):
    """Token -> even hash; remembers tokens up to a bound."""

    def __missing__(self, token: bytes) -> int:
        h = xxhash.xxh64_intdigest(token) & ~1
        if len(self) < _SEEN:
            self[token] = h
        return h


class Tokens:
    """Token hashes of a text, end token last, in parts of bounded size; word hashes are even, pair hashes odd."""

    def __init__(self):
        self.hash = Seen().__getitem__

    def parts(self, text: str | None) -> Iterator[np.ndarray]:
        """Arrays of hashes; the first entry of each is the token before it (the start mark at first)."""
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
        tokens.append(END)
        last = START
        for at in range(0, len(tokens), _PART):
            part = tokens[at:at + _PART]
            h = np.empty(len(part) + 1, np.uint64)
            h[0] = self.hash(last)
            h[1:] = np.fromiter(map(self.hash, part), np.uint64, len(part))
            yield h
            last = part[-1]


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(before * K2 + h * K3) | np.uint64(1)


def _count(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    tokens, held, n = Tokens(), [], 0

    def emptied() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(slice_of(h, slices).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c)], names=["slice", "h", "n"])

    for batch in batches:
        for text in batch.column("text"):
            for h in tokens.parts(text.as_py()):
                held += [h[1:], pairs(h[:-1], h[1:])]
                n += 2 * len(h)
            if n >= _BUFFER:
                yield emptied()
                held, n = [], 0
    if held:
        yield emptied()


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (mixed(h + K3) >> np.uint64(33)) % np.uint64(slices)


def places(h: np.ndarray, level: int, i: int, bits: np.ndarray) -> np.ndarray:
    """The i-th bit of (n-gram, level) in its slice."""
    g = mixed(h + np.uint64(level * int(K2) % 2**64))
    return (g + np.uint64(i) * (mixed(g + K3) | np.uint64(1))) % bits


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)


def _slice_row(number: int, h: np.ndarray, n: np.ndarray, bits_per_entry: int) -> dict:
    q = levels(n)
    bits = max(64, math.ceil(int(q.sum()) * bits_per_entry / 64) * 64)
    flags = np.zeros(bits, bool)
    m = np.uint64(bits)
    for level in range(1, int(q.max()) + 1):
        part = h[q >= level]
        for i in range(HASHES):
            flags[places(part, level, i, m)] = True
    word = (h & np.uint64(1)) == 0
    return {"slice": number, "bits": bits, "filter": np.packbits(flags, bitorder="little").tobytes(), "words": h[word].view(np.int64), "counts": n[word]}


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by slice; one slice at a time is in memory."""
    current, hs, ns = None, [], []

    def done() -> pa.RecordBatch:
        r = _slice_row(current, np.concatenate(hs), np.concatenate(ns), BITS)
        return pa.RecordBatch.from_arrays([pa.array([r["slice"]], pa.int32()), pa.array([r["bits"]]), pa.array([r["filter"]], pa.binary()),
                                           pa.array([r["words"]], pa.list_(pa.int64())), pa.array([r["counts"]], pa.list_(pa.int64()))],
                                          names=["slice", "bits", "filter", "words", "counts"])

    for batch in batches:
        s, h, n = (batch.column(c).to_numpy() for c in ("slice", "h", "n"))
        cuts = np.flatnonzero(np.diff(s)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True):
            if a == b:
                continue
            if current is not None and s[a] != current:
                yield done()
                hs, ns = [], []
            current = int(s[a])
            hs.append(h[a:b].view(np.uint64))
            ns.append(n[a:b])
    if current is not None:
        yield done()


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """The written model, one row per slice that holds anything with its filter and the exact counts of its words; the number of slices."""
    texts = docs.filter(~held_out(quoted(doc_id))).select(quoted(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") / 5 + 1)).first()[0] or 0  # entries to expect: words and pairs
    slices = max(1, math.ceil(size / SLICE_TOKENS))
    counts = (texts.mapInArrow(lambda batches: _count(batches, slices), "slice int, h long, n long")
              .repartition("slice").groupBy("slice", "h").agg(F.sum("n").alias("n")))
    return staged(counts.sortWithinPartitions("slice").mapInArrow(_build, SLICE_FIELDS)), slices


def probed_levels(filters: np.ndarray, h: np.ndarray, bits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The highest level reached by each n-gram in its slice (bits, first bit in ``filters``), 0 for none."""
    out, left, level, part = np.zeros(len(h), np.uint8), np.arange(len(h)), 1, h
    while len(left):
        for i in range(HASHES):
            at = starts + places(part, level, i, bits)
            there = (filters[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, part, bits, starts = left[there], part[there], bits[there], starts[there]
        out[left] = level
        level += 1
        if level > 62:
            break
    return out


#: Count estimate of a level: the mean of its range, 0 for none.
MEANS = np.array([0.0, *((2.0**q + 2.0**(q - 1) - 1) / 2 for q in range(1, 63))])


class Counts:
    """Counts on a worker: the filter's slices end to end, and the exact table of frequent words."""

    def __init__(self, bits: np.ndarray, filters: bytes, words: np.ndarray, counts: np.ndarray):
        self.bits, self.filters, self.words, self.counts = bits.astype(np.uint64), np.frombuffer(filters, np.uint8), words, counts
        self.starts = np.concatenate([[0], np.cumsum(self.bits)[:-1]]).astype(np.uint64) if len(bits) else np.zeros(0, np.uint64)

    def probed(self, h: np.ndarray) -> np.ndarray:
        """Count estimates from the filter."""
        if not len(self.bits):
            return np.zeros(len(h))
        s = slice_of(h, len(self.bits))
        return MEANS[probed_levels(self.filters, h, self.bits[s], self.starts[s])]

    def frequent(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, -1 for others."""
        if not len(self.words):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], -1)


class Found(Counts):
    """Counts of one block: the n-grams it asked for, sorted, and the levels found."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        super().__init__(np.zeros(0, np.int64), b"", words, counts)

    def probed(self, h: np.ndarray) -> np.ndarray:
        return MEANS[self.levels[np.searchsorted(self.asked, h)]]


class Scorer:
    """Texts are probed together, about ``_PART`` tokens at a time: a probe costs as many array steps for one token as for all."""

    def __init__(self, model: Counts, n_all: int, v_all: int, n_docs: int):
        self.model, self.tokens, self.n_docs = model, Tokens(), n_docs
        self.whole, self.start = n_all + SMOOTH * (v_all + 1), np.uint64(self.tokens.hash(START))

    def scored(self, rows: pa.RecordBatch, parts: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        model, h, k = self.model, np.concatenate(parts), rows.num_rows
        lengths = np.array([len(p) for p in parts])
        owner = np.repeat(np.array(owners), lengths)
        own = np.ones(len(h), bool)
        own[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False  # the token before each part
        exact = model.frequent(h)
        counts = exact.astype(np.float64)
        counts[exact < 0] = model.probed(h[exact < 0])
        counts[~own & (h == self.start)] = self.n_docs
        at = np.flatnonzero(own)
        p = (model.probed(pairs(h[at - 1], h[at])) + PRIOR * (counts[at] + SMOOTH) / self.whole) / (counts[at - 1] + PRIOR)
        known = exact[at] >= 0
        logs = np.where(known, np.log10(np.maximum(exact[at], 0) + SMOOTH), 0.0)
        rare, of = h[at][~known], owner[at]
        total = lambda weights: np.bincount(of, weights, k)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of[~known], minlength=k))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [rows.column("row"), rows.column("doc_id"), rows.column("held_out"), pa.array(np.bincount(of, minlength=k)), pa.array(total(known).astype(np.int64)),
             pa.array(total(logs)), pa.array(total(np.log10(np.minimum(p, 1.0)))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rare.view(np.int64)))],
            names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare"])

    def batch(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, parts, owners, n = 0, [], [], 0
        for i, text in enumerate(batch.column("text")):
            for h in self.tokens.parts(text.as_py()):
                parts.append(h)
                owners.append(i - first)
                n += len(h)
            if n >= _PART:
                yield self.scored(batch.slice(first, i + 1 - first), parts, owners)
                first, parts, owners, n = i + 1, [], [], 0
        if parts:
            yield self.scored(batch.slice(first), parts, owners)


def _score(batches: Iterator[pa.RecordBatch], sent, *totals: int) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(Counts(*sent.value), *totals)
    for batch in batches:
        yield from scorer.batch(batch)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their block: neighbours of ``BLOCK_BYTES`` together, named by the first row's number."""
    block, size = None, 0
    for batch in batches:
        blocks = []
        for row, n in zip(batch.column("row").to_pylist(), pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), strict=True):
            if block is None or size + n > BLOCK_BYTES:
                block, size = row, 0
            size += n
            blocks.append(block)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], names=["block", *batch.schema.names])


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of equal keys, in order, each within its batch."""
    for batch in batches:
        k = batch.column(key).to_numpy()
        cuts = np.flatnonzero(np.diff(k)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
            if a < b:
                yield int(k[a]), batch.slice(a, b - a)


def asked(tokens: Tokens, texts: Iterator[str | None]) -> np.ndarray:
    """The distinct words and pairs of the texts."""
    found = [np.zeros(0, np.uint64)]
    for text in texts:
        for h in tokens.parts(text):
            found += [h, pairs(h[:-1], h[1:])]
    return np.unique(np.concatenate(found))


def _ask(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[pa.RecordBatch]:
    tokens, current, texts = Tokens(), None, []

    def question() -> Iterator[pa.RecordBatch]:
        h = asked(tokens, texts)
        s = slice_of(h, slices).astype(np.int64)
        order = np.argsort(s, kind="stable")
        h, s = h[order], s[order]
        cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)]
        rows = [(current, int(s[a]), part, h[at:min(b, at + ASKED)].tobytes())
                for a, b in zip(cuts, cuts[1:], strict=False) for part, at in enumerate(range(a, b, ASKED))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                         names=["block", "slice", "part", "asked"])

    for block, rows in _by_key(batches, "block"):
        if current is not None and block != current:
            yield from question()
            texts = []
        current = block
        texts += rows.column("text").to_pylist()
    if current is not None:
        yield from question()


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by slice, its filter first; n-grams of a slice without a filter are found nowhere."""
    held, bits, filters = None, None, None
    for number, rows in _by_key(batches, "slice"):
        if rows.column("bits")[0].is_valid:
            held, bits, filters = number, rows.column("bits")[0].as_py(), np.frombuffer(rows.column("filter")[0].as_py(), np.uint8)
            rows = rows.slice(1)
        if not rows.num_rows:
            continue
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("asked")]
        h = np.concatenate(hashes)
        found = probed_levels(filters, h, np.full(len(h), bits, np.uint64), np.zeros(len(h), np.uint64)) if held == number else np.zeros(len(h), np.uint8)
        ends = np.cumsum([len(x) for x in hashes])
        yield pa.RecordBatch.from_arrays([rows.column("block"), rows.column("slice"), rows.column("part"), pa.array([x.tobytes() for x in np.split(found, ends[:-1])], pa.binary())],
                                         names=["block", "slice", "part", "found"])


def _score_blocks(batches: Iterator[pa.RecordBatch], sent, slices: int, *totals: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by block, the replies first, by slice and part; one block at a time is in memory."""
    model = Found(*sent.value)
    scorer = Scorer(model, *totals)
    current, replies, texts = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(texts).combine_chunks().to_batches()
        model.asked = asked(scorer.tokens, (t.as_py() for batch in rows for t in batch.column("text")))
        model.levels = np.empty(len(model.asked), np.uint8)
        model.levels[np.argsort(slice_of(model.asked, slices).astype(np.int64), kind="stable")] = np.frombuffer(b"".join(replies), np.uint8)
        for batch in rows:
            yield from scorer.batch(batch)

    for block, rows in _by_key(batches, "block"):
        if current is not None and block != current:
            yield from done()
            replies, texts = [], []
        current = block
        n = rows.num_rows - rows.column("found").null_count
        replies += rows.column("found").slice(0, n).to_pylist()
        if n < rows.num_rows:
            texts.append(rows.slice(n))
    if current is not None:
        yield from done()


def scored_by_blocks(rows: DataFrame, model: DataFrame, slices: int, sent, totals: tuple, fields: str) -> DataFrame:
    """Scores of the rows from slices that are never together: questions go to the slices, levels come back to the blocks."""
    texts = staged(rows.mapInArrow(_blocked, T.StructType([T.StructField("block", T.LongType()), *rows.schema])))
    questions = texts.mapInArrow(lambda batches: _ask(batches, slices), ASK_FIELDS)
    meeting = model.select("slice", "bits", "filter").unionByName(questions, allowMissingColumns=True).repartition("slice")
    # nulls first: the filter has no block
    replies = meeting.sortWithinPartitions("slice", "block", "part").mapInArrow(_answer, REPLY_FIELDS)
    back = replies.unionByName(texts, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("row").asc_nulls_first(), "slice", "part")
    return back.mapInArrow(lambda batches: _score_blocks(batches, sent, slices, *totals), fields)


def joined_filter(model: DataFrame, slices: int) -> tuple[np.ndarray, bytes]:
    """Bits of each slice and the slices one after the other: Arrow's copy and the joined one are all the driver holds. A slice that no
    n-gram fell into is empty."""
    table = model.select("slice", "bits", "filter").toArrow()
    bits, views = np.full(slices, 64, np.int64), [memoryview(bytes(8))] * slices
    for batch in table.to_batches():
        for k, b, value in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist(), batch.column("filter"), strict=True):
            bits[k], views[k] = b, memoryview(value.as_buffer())
    return bits, b"".join(views)


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, (model, slices) = docs.sparkSession, trained(docs, doc_id, text)
    words = model.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("h"), F.col("w.counts").alias("n"))
    ends = F.when(F.col("h") == F.lit(np.uint64(Seen()[END]).astype(np.int64).item()), F.col("n"))
    n_all, v_all, n_docs = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(ends), F.lit(0))).first()
    # sixteenths of a power of two: a bounded number of bands, whole bands from the top while they fit
    bands = words.groupBy(F.floor(F.log2("n") * 16).alias("band")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("band")).collect()
    least, room = None, frequent
    for band in bands:
        room -= band["k"]
        if room < 0:
            break
        least = band["least"]
    top = words.filter(F.col("n") >= least).toArrow() if least is not None else pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("doc_id"), held_out(quoted(doc_id)).alias("held_out"), quoted(text).alias("text"))
    fields, totals = SCORE_FIELDS.format(kind=rows.schema["doc_id"].dataType.simpleString()), (n_all, v_all, n_docs)
    if (model.agg(F.sum("bits")).first()[0] or 0) <= max_filter_mb * 8e6:
        sent = spark.sparkContext.broadcast((*joined_filter(model, slices), h[order], n[order]))
        scored = staged(rows.mapInArrow(lambda batches: _score(batches, sent, *totals), fields))
    else:
        sent = spark.sparkContext.broadcast((h[order], n[order]))
        scored = staged(scored_by_blocks(rows, model, slices, sent, totals, fields))
    sent.destroy()  # workers live on and would keep the filter
    rare = scored.select("row", F.explode("rare").alias("h")).join(words.select("h", "n"), "h", "left")
    sums = rare.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("more_logs"))
    whole = math.log10(n_all + SMOOTH * (v_all + 1)) if n_all + v_all else math.log10(SMOOTH)
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")
