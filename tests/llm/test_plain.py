"""Plain versions of what SQL cannot express, and the registered queries that have no SQL."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_documents import brute_groups, brute_measures, brute_print, is_held, lm_tokens

from pageloom.llm import lm_scoring, quality_rules
from pageloom.llm import quality_classifier as qc
from pageloom.llm.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the driver's tables")
MASK = (1 << 64) - 1


# -- quality classifier

def plain_features(text):
    """Bucket numbers one token at a time."""
    tokens = re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")
    seen, out = qc.Seen(), []
    words, shapes = [], []
    for i, t in enumerate(tokens):
        known = seen[t]
        word, shape = known & 0xFFFFFFFF, known >> 32
        shape = 2 * shape + (i > 0 and words[-1] == word)
        words.append(word)
        shapes.append(shape)
        k1, k2, k3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
        found = [word * k3, shape * k2 + 2]
        if i:
            found.append(words[-2] * k1 + word * k2 + 1)
        if i > 1:
            found.append(shapes[-3] * k1 + shapes[-2] * k2 + shape * k3 + 3)
        for x in found:
            x &= MASK
            out.append((((x ^ (x >> 29)) * k1 & MASK) >> 32) % qc.BUCKETS)
    return out


def plain_selection(docs, chosen, noise):
    """docs: (id, text); chosen: id -> (good, fits); noise: id -> Gumbel number. Returns id, weight, key, kept per row."""
    features = [plain_features(t) for _, t in docs]
    raw = Counter(x for f in features for x in f)
    target = Counter(x for (d, _), f in zip(docs, features) for x in f if chosen.get(d, (False, False)) == (True, True))
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(b):
        r = (raw[b] + 1 / qc.BUCKETS) / (n_raw + 1)
        return math.log((target[b] + qc.PRIOR * r) / (n_target + qc.PRIOR)) - math.log(r)

    weights = [sum(map(ratio, f)) for f in features]
    held = [(w / len(f), chosen[d][0]) for (d, _), f, w in zip(docs, features, weights) if f and d in chosen and not chosen[d][1]]
    marks = {g: np.percentile([w for w, k in held if k == g], [i / 10 for i in range(1001)]) for g in (True, False) if any(k == g for _, k in held)}
    keys = [round((w + noise[d]) * (1 << 20)) for (d, _), w in zip(docs, weights)]
    if len(marks) < 2:
        return [(d, w, k, True) for (d, _), w, k in zip(docs, weights, keys)]
    grid = sorted(set(marks[True]) | set(marks[False]))
    value = [np.mean(marks[True] >= g) + np.mean(marks[False] < g) for g in grid]
    best = [g for g, v in zip(grid, value) if v >= max(value) - 1e-9]
    cut = (best[0] + best[-1]) / 2
    k = sum(not f or w >= cut * len(f) for f, w in zip(features, weights))
    least = sorted(keys, reverse=True)[k - 1] if k else math.inf
    return [(d, w, key, key >= least) for (d, _), w, key in zip(docs, weights, keys)]


@needs_tables
def test_selection_against_the_plain_version(spark, small_docs, edge_docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").unionByName(
        spark.createDataFrame([(100, 0, 0), (200, 1, 0), (200, 1, 1), (5, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    docs = small_docs.select("doc_id", "text").unionByName(edge_docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    chosen = {r.label_id: (r.good, r.fits) for r in qc.labelled_sample(labels).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    noise = {r.doc_id: r.g for r in docs.select("doc_id", qc.gumbel(F.col("doc_id")).alias("g")).collect()}
    want = plain_selection(rows, chosen, noise)
    got = qc.selection(docs, labels).collect()
    key = lambda r: (str(r[0]), round(r[1], 3))
    got = sorted(((r.doc_id, r.log_weight, round(r.gumbel_key * (1 << 20)), r.kept) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[0] for g in got] == [w[0] for w in want] and len({w[3] for w in want}) == 2
    assert all(g[1] == pytest.approx(w[1], abs=1e-6) and abs(g[2] - w[2]) <= 1 and g[3] == w[3] for g, w in zip(got, want))


def test_stretches_end_at_tokens(monkeypatch):
    text = "Line one\nline_two;;;THREE\tfour" * 50 + "字" * 300 + "\n".join(["word"] * 500)
    monkeypatch.setattr(qc, "_BLOCK", 16)
    parts = list(qc.Features().blocks(text))
    assert Counter(int(x) for p in parts for x in p) == Counter(plain_features(text))
    # four features a token, and no more tokens than a stretch has characters
    assert max(map(len, parts)) <= 4 * 40


# -- registered queries without SQL, on the whole of the smallest tables

@needs_tables
def test_registered_sharding(spark, small_docs):
    rows = QUERIES["op2_sharding"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


@needs_tables
def test_registered_fingerprints(spark, small_docs):
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, SMALL).collect()}
    prints = {r.doc_id: brute_print(r.text) for r in small_docs.collect()}
    assert {d: f for d, (f, _) in rows.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {d: c for d, (_, c) in rows.items()} == {d: c for d, _, c in brute_groups(list(prints.items()))}


@needs_tables
def test_registered_quality_rules(spark, small_docs):
    rows = QUERIES["op8_quality_rules"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    for r in rows:
        n, chars, symbols, lines, repeats = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and r.kept == (not r.base_failed and r.quality > quality_rules.KEEP_ABOVE)
    assert len(rows) == len(texts)


@needs_tables
@pytest.mark.parametrize("name", ["op3_license_windows", "op7_lm_scoring", "op10_quality_classifier"])
def test_registered_queries_give_a_row_per_document(spark, small_docs, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in small_docs.collect())


def test_patterns_of_other_votes_are_refused(spark):
    names = list(quality_rules.rules())
    rows = spark.range(3 ** len(names) + 1).select(*[F.col("id").cast("int").alias(n) for n in names], F.lit(1).alias("n"))
    with pytest.raises(ValueError, match="patterns"):
        quality_rules.LabelModel(names).fit(rows)


# -- language model

K1, K2, K3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def mix(x):
    x = (x ^ (x >> 31)) * K1 & MASK
    return x ^ (x >> 29)


class PlainFilter:
    """Counts kept as levels in a Bloom filter of one set of bits per slice."""

    def __init__(self, counts, slices):
        self.slices, members = slices, {}
        for h, c in counts.items():
            members.setdefault(self.slice(h), []).append((h, c.bit_length()))
        self.bits = {s: max(64, math.ceil(sum(q for _, q in m) * lm_scoring.BITS / 64) * 64) for s, m in members.items()}
        self.set = {s: {p for h, q in m for level in range(1, q + 1) for p in self.places(h, level, self.bits[s])} for s, m in members.items()}

    def slice(self, h):
        return (mix((h + K3) & MASK) >> 33) % self.slices

    def places(self, h, level, bits):
        g = mix((h + level * K2) & MASK)
        return [((g + i * (mix((g + K3) & MASK) | 1)) & MASK) % bits for i in range(lm_scoring.HASHES)]

    def count(self, h):
        s, level = self.slice(h), 0
        while s in self.bits and all(p in self.set[s] for p in self.places(h, level + 1, self.bits[s])):
            level += 1
        return (2.0**level + 2.0 ** (level - 1) - 1) / 2 if level else 0.0


def plain_scores(rows, frequent, slice_tokens):
    hashes = {}
    word = lambda t: hashes.setdefault(t, xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) & ~1)
    pair = lambda a, b: mix((a * K2 + b * K3) & MASK) | 1
    start = word("\t")
    lists = [[word(t) for t in lm_tokens(text)] for _, text in rows]
    train = [(h, text) for h, (doc, text) in zip(lists, rows) if not is_held(doc)]
    words = Counter(x for h, _ in train for x in h)
    grams = words + Counter(pair(a, b) for h, _ in train for a, b in zip([start, *h], h))
    size = sum(len(text.encode()) / 5 + 1 for _, text in train if text is not None)
    model = PlainFilter(grams, max(1, math.ceil(size / slice_tokens)))
    whole = sum(words.values()) + lm_scoring.SMOOTH * (len(words) + 1)
    # whole bands of sixteenths of a power of two, from the top while they fit
    bands, least = Counter(math.floor(math.log2(c) * 16) for c in words.values()), math.inf
    room = frequent
    for band in sorted(bands, reverse=True):
        room -= bands[band]
        if room < 0:
            break
        least = min(c for c in words.values() if math.floor(math.log2(c) * 16) == band)
    count = lambda h: words[h] if words[h] >= least else model.count(h)
    out = []
    for (doc, _), h in zip(rows, lists):
        total, before, c_before = 0.0, start, len(train)
        for x in h:
            c = count(x)
            p = (model.count(pair(before, x)) + lm_scoring.PRIOR * (c + lm_scoring.SMOOTH) / whole) / (c_before + lm_scoring.PRIOR)
            total, before, c_before = total + math.log10(min(p, 1.0)), x, c
        out.append((str(doc), len(h), total))
    return sorted(out, key=lambda r: (r[:2], round(r[2], 3)))


@pytest.mark.parametrize("frequent", [0, 300, 1 << 19])
def test_scores_against_the_plain_model(small_docs, edge_docs, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "SLICE_TOKENS", 30_000)
    docs = small_docs.select("doc_id", "text").limit(60).unionByName(edge_docs.select("doc_id", "text").filter("coalesce(length(text), 0) < 30000"))
    docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)  # one fixed set of rows
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()], frequent, 30_000)
    got = sorted(((str(r.doc_id), r.n_tokens, r.score) for r in lm_scoring.scores(docs, frequent=frequent).collect()), key=lambda r: (r[:2], round(r[2], 3)))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], abs=1e-6) for g, w in zip(got, want))
