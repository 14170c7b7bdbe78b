"""Operators on documents against brute force, and on the edge cases their docstrings define."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from pageloom.llm import decontamination, license_scan, lm_scoring, mixing, quality_classifier, quality_rules, sharding, simhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def item_words(text):
    return WORD.findall((text or "").translate(LOWER))


# -- decontamination

def brute_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = item_words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i:i + 10])].add(str(item) if item is not None else "")
    out = []
    for doc, text in docs:
        words, hit, found = item_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if (got := windows.get(tuple(words[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((doc, len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def hits(docs, items):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontamination.contamination(docs, items).collect()), key=str)


def test_contamination_on_edge_cases(spark, edge_docs):
    items = [(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 W11"), (2, "The of"), (2, "The of"), (3, None), (4, "!!"), (None, "a b c d e f g h i j k"),
             (5, "same text of some words same text of some words same"), (6, "nowhere at all")]
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert hits(edge_docs, spark.createDataFrame(items, "item_id long, text string")) == brute_hits(docs, items)


def test_contamination_of_nothing(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert hits(no_docs, items) == []
    assert {(r[2], r[3]) for r in hits(edge_docs, items.limit(0))} == {(0, ())}


def test_words_near_each_other(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta gamma"), (3, "gamma " + "z " * 30 + "alpha beta")], "doc_id long, text string")
    windows, _ = decontamination.test_windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    index = decontamination.build_index(docs, windows)
    lists = decontamination.lists_by_rarity(index, windows)
    ids = {r.doc_row: r.doc_id for r in index.select("doc_row", "doc_id").collect()}
    near = {(ids[r.doc_row], r.spread) for r in decontamination.proximity_matches(index, lists, slop=3).collect()}
    assert near == {(1, 2), (2, 0)}
    assert {ids[r.doc_row] for r in decontamination.phrase_matches(index, lists).collect()} == {2}


def test_clean_documents_keep_all_columns(spark, edge_docs):
    items = spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    clean = decontamination.clean_documents(edge_docs, items)
    assert clean.columns == edge_docs.columns and clean.count() == edge_docs.count() - 1


def test_only_contaminated_rows_of_an_id_go(spark):
    bad = "so w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 on"
    items = spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    docs = spark.createDataFrame([(None, bad), (None, "clean without an id"), (None, None), (7, bad), (7, "clean of the same id"), (8, "clean")], "doc_id long, text string")
    left = decontamination.clean_documents(docs, items).collect()
    assert Counter(map(tuple, left)) == Counter([(None, "clean without an id"), (None, None), (7, "clean of the same id"), (8, "clean")])


# -- sharding

@pytest.mark.parametrize("bucket_bytes", [1 << 10, 1 << 25])
def test_shards_are_whole_and_even(edge_docs, bucket_bytes):
    rows = sharding.shard_records(edge_docs, 7, bucket_bytes=bucket_bytes).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in edge_docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 16
    sizes = [len(slots[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_the_seed_fixes_the_order(spark, small_docs):
    docs, runs = small_docs, []
    for reducers in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", reducers)
        rows = sharding.shard_records(docs, bucket_bytes=20_000).collect()
        runs.append(sorted((r.doc_id, r.shard, r.slot) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1]
    other = sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_records(docs, bucket_bytes=20_000, seed=5).collect())
    assert other != runs[0]


def test_no_records_no_shards(no_docs):
    assert sharding.shard_records(no_docs).count() == 0


def test_order_is_shuffled(small_docs):
    ids = [r.doc_id for r in sharding.shard_records(small_docs, 4).orderBy("shard", "slot").collect()]
    assert sorted(ids) == list(range(len(ids))) and sum(b == a + 1 for a, b in zip(ids, ids[1:], strict=False)) < len(ids) // 10


# -- mixing

def poisson(rate, u):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while u >= total and k < rate + 12 * math.sqrt(rate) + 24:
        k += 1
        p *= rate / k
        total += p
    return k


def test_copies_follow_the_inverted_distribution(spark, edge_docs):
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 30.0), (None, 2.0)], "source string, weight double")
    rates = {r.source: r.rate for r in mixing.source_rates(edge_docs, weights).collect()}
    want = Counter()
    for r in edge_docs.collect():
        parts = max(1, math.ceil(rates[r.source] / mixing.CHUNK))
        doc = "" if r.doc_id is None else str(r.doc_id)
        us = [int(hashlib.md5(f"{mixing.SEED}:{i}:{doc}".encode()).hexdigest()[:13], 16) / 2**52 for i in range(1, parts + 1)]
        if n := sum(poisson(rates[r.source] / parts, u) for u in us):
            want[r.doc_id, r.text] += n
    got = mixing.mix_sources(edge_docs, weights)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert got.columns.count("rate") == 1 and max(rates.values()) > mixing.CHUNK


def test_expected_bytes_meet_the_targets(small_docs):
    rates = mixing.source_rates(small_docs).collect()
    whole = sum(r.bytes for r in rates)
    assert sum(r.rate * r.bytes for r in rates) == pytest.approx(whole)
    powers = {r.source: r.bytes**mixing.ALPHA for r in rates}
    assert all(r.rate * r.bytes / whole == pytest.approx(powers[r.source] / sum(powers.values())) for r in rates)


def test_nothing_to_mix(no_docs):
    assert mixing.mix_sources(no_docs).count() == 0


# -- SimHash

def brute_print(text):
    words = BLANK.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    """id, fingerprint -> smallest id reachable over links of two bits or fewer."""
    left, out = list(range(len(prints))), {}
    while left:
        group, open_ = [], [left.pop()]
        while open_:
            x = open_.pop()
            group.append(x)
            near = [y for y in left if (prints[x][1] ^ prints[y][1]).bit_count() <= 2]
            left = [y for y in left if y not in near]
            open_ += near
        ids = [prints[x][0] for x in group if prints[x][0] is not None]
        for x in group:
            out[x] = min(ids, default=None)
    return sorted(((prints[x][0], prints[x][1], out[x]) for x in out), key=str)


@pytest.mark.parametrize("dense", [1, 2, 16])
def test_groups_on_edge_cases_and_documents(small_docs, edge_docs, dense):
    docs = small_docs.select("doc_id", "text").unionByName(edge_docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicate_groups(docs, dense=dense).collect()), key=str)
    assert got == brute_groups([(r.doc_id, brute_print(r.text)) for r in docs.collect()])


@pytest.mark.parametrize("dense", [1, 16])
def test_links_of_a_family(spark, dense):
    import random

    rng = random.Random(5)
    seed = rng.getrandbits(64)
    prints = {seed}
    for _ in range(150):
        x = rng.choice(sorted(prints))
        prints.add(x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    roots = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), dense)).collect()}
    want = brute_groups([(signed(p), p) for p in prints])
    assert {i: roots.get(i, i) for i, _, _ in want} == {i: c for i, _, c in want}


def test_one_of_each_group_stays(spark, edge_docs, no_docs):
    more = [(None, "no id and so on and on"), (None, "no id and so on and on"), (None, "another text that has no id either")]
    edge_docs = edge_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    kept = simhash.deduplicated(edge_docs)
    groups = simhash.near_duplicate_groups(edge_docs).collect()
    assert kept.columns == edge_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(g.component_id for g in {g.root: g for g in groups}.values())
    assert simhash.deduplicated(no_docs).count() == 0


def test_every_group_keeps_a_row_though_ids_repeat(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, b), (5, a), (5, b), (5, c), (6, a), (None, c), (None, d), (None, d), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(map(tuple, simhash.deduplicated(docs).collect()))
    assert kept == Counter([(3, b), (5, a), (5, c), (None, d), (None, None)])


# -- licences

def test_licences(spark, edge_docs):
    rows = [(1, "intro\nThis work is licensed under the GNU General Public Licence, Version 3\nend"), (2, "Released under the MIT License. " * 2), (3, "nothing"),
            (4, "All rights reserved.\n\nLicensed under CC BY-NC 4.0."), (5, None)]
    got = {r.doc_id: (r.licenses, r.best, r.best_dice) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (["GPL-3.0"], "GPL-3.0", 1.0) and got[4][0] == ["All-rights-reserved", "CC-BY-NC-4.0"]
    assert got[2][0] == ["MIT"] and got[3] == ([], None, None) and got[5] == ([], None, None)
    assert license_scan.license_scan(edge_docs).count() == edge_docs.count()


def test_size_bounds_lose_no_template():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        for cut in range(1, len(words)):
            part = " ".join(words[:cut])
            grams = license_scan.bigrams(license_scan.normal_words(part), 1 << 30)
            want = max((2 * len(g & grams) / (len(g) + len(grams)), n) for n, g, _, _ in scanner.templates)[0] if grams else 0
            got = scanner.match(part)
            assert (got[1] if got else 0) == (want if want >= license_scan.THRESHOLD else 0), (name, part)


def test_licences_anywhere(spark, edge_docs):
    import textwrap

    mit, gpl = license_scan.TEXTS["MIT-text"], license_scan.TEXTS["GPL-3.0-text"]
    rows = [(1, "intro words " * 50 + "\n" + "\n".join(textwrap.wrap(mit, 72)) + "\n" + "closing words " * 50),
            (2, "Copyright 2020 Foo Incorporated. All rights reserved. Released under the MIT License."),
            (3, "The library is free and is released under the MIT License. See the docs for more."),
            (4, "\n".join(textwrap.wrap(gpl, 70))), (5, "nothing"), (6, None), (7, "This work is licensed under\nthe GNU General\nPublic License, version 2.")]
    got = {r.doc_id: dict(zip(r.licenses, r.dices, strict=True)) for r in license_scan.license_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["MIT-text"] == 1 and got[1]["MIT-permission"] == 1
    assert got[2] == {"All-rights-reserved": 1, "MIT": 1} and got[3] == {"MIT": 1}
    assert got[4]["GPL-3.0-text"] == 1 and got[5] == {} and got[6] == {} and got[7]["GPL-2.0"] == 1
    assert license_scan.license_windows(edge_docs).count() == edge_docs.count()


def test_windows_against_loops():
    import random

    rng = random.Random(3)
    template = "a b c a b d e f g h"
    scanner = license_scan.WindowScanner({"x": template})
    own = license_scan.bigrams(template.encode().split(), 1 << 30)
    for _ in range(200):
        words = [rng.choice("abcdefghz") if rng.random() < 0.25 else w for w in ("z " * rng.randrange(5) + template + " a b c" * rng.randrange(3)).split()]
        cut = [license_scan.bigrams([w.encode() for w in words[i:j]], 1 << 30) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
        want = max(2 * len(own & g) / (len(own) + len(g)) for g in cut)
        got = scanner.scan(" ".join(words))[2]
        assert (got[0] if got else 0) == (want if want >= 0.8 else 0), words


# -- language model

def lm_tokens(text):
    return [*BLANK.findall((text or "").translate(LOWER)), "\n"]


def is_held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


@pytest.mark.parametrize("frequent", [0, 40, 1 << 19])
def test_base_scores(small_docs, edge_docs, frequent):
    docs = small_docs.select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(t for doc, text in rows if not is_held(doc) for t in lm_tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(doc), is_held(doc), len(t := lm_tokens(text)), sum(counts[x] > 0 for x in t), n,
                   round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 4)) for doc, text in rows)
    got = lm_scoring.scores(docs, frequent=frequent).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    if frequent:
        held = [r for r in got if r.held_out and r.n_tokens > 50]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score <= 0 for r in got)


@pytest.mark.parametrize("frequent", [0, 1 << 19])
def test_a_filter_beyond_the_bound_gives_the_same_scores(small_docs, edge_docs, monkeypatch, frequent):
    docs = small_docs.select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    monkeypatch.setattr(lm_scoring, "SLICE_TOKENS", 20_000)
    want, got = (Counter((*r[:5], round(r.base_score, 6), round(r.score, 9)) for r in lm_scoring.scores(docs, frequent=frequent, max_filter_mb=mb).collect()) for mb in (256, 0))
    assert got == want and any(r[-1] < -1 for r in want)


def test_model_of_nothing(no_docs, edge_docs):
    assert lm_scoring.scores(no_docs).count() == 0
    only_held = edge_docs.filter(lm_scoring.held_out(F.col("doc_id")))
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in lm_scoring.scores(only_held).collect())


def test_filter_never_misses_a_level():
    import numpy as np

    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64)) & ~np.uint64(1)
    h = np.unique(h)
    n = rng.integers(1, 5000, len(h))
    row = lm_scoring._slice_row(0, h, n, 8)
    model = lm_scoring.Counts(np.array([row["bits"]]), row["filter"], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    q = lm_scoring.levels(n)
    mean = (2.0**q + 2.0 ** (q - 1) - 1) / 2
    assert (model.probed(h) >= mean).all() and (model.probed(h) == mean).mean() > 0.9
    assert (model.probed(np.setdiff1d(rng.integers(0, 2**63, 5000, dtype=np.uint64), h)) > 0).mean() < 0.06


# -- quality rules

def brute_measures(text):
    text = text or ""
    words = BLANK.findall(text)
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_measures(small_docs, edge_docs):
    docs = small_docs.select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    got = quality_rules.judged(docs).collect()
    pairs = sorted(((str(r.doc_id), *brute_measures(r.text)) for r in docs.collect()))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == pairs
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality > 0.5)


def test_expectation_maximisation_against_loops(small_docs):
    votes = list(quality_rules.rules())
    rows = quality_rules.judged(small_docs).collect()
    prior, chance = quality_rules.PRIOR, {y: {r: list(quality_rules.START[y]) for r in votes} for y in ("good", "bad")}

    def good(row):
        a, b = prior, 1 - prior
        for r in votes:
            a, b = a * chance["good"][r][row[r] + 1], b * chance["bad"][r][row[r] + 1]
        return a / (a + b)

    for _ in range(quality_rules.STEPS):
        ps = [good(r) for r in rows]
        weights = {"good": ps, "bad": [1 - p for p in ps]}
        prior = (sum(ps) + quality_rules.PRIOR) / (len(ps) + 1)
        chance = {y: {r: [(sum(w for w, row in zip(weights[y], rows, strict=True) if row[r] == v) + quality_rules.START[y][v + 1]) / (sum(weights[y]) + 1)
                          for v in (-1, 0, 1)] for r in votes} for y in weights}
    assert all(r.quality == pytest.approx(good(r), abs=1e-6) for r in rows)


def test_rules_know_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs).collect()}
    good, bad = ([kept[d] for d, q in labels.items() if q == x] for x in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_no_documents_no_verdicts(no_docs):
    assert quality_rules.judged(no_docs).count() == 0


# -- quality classifier

def test_resampling_knows_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    seen = {r.doc_id for r in fit.collect()}
    kept = {r.doc_id: r.kept for r in quality_classifier.selection(docs, fit).collect()}
    rows = [r for r in labels.collect() if r.doc_id not in seen and not r.toxic]
    good, bad = ([kept[r.doc_id] for r in rows if r.quality == x] for x in (1, 0))
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.15


def test_top_k_takes_the_largest_keys(edge_docs, spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, None), (6, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    for k in (0, 1, 5, 10_000):
        rows = quality_classifier.selection(edge_docs, labels, k=k).collect()
        keys = sorted((r.gumbel_key for r in rows), reverse=True)
        least = keys[k - 1] if 0 < k <= len(keys) else (keys[-1] if k else math.inf)
        assert all(r.kept == (r.gumbel_key >= least) for r in rows)


def test_without_labels_everything_stays(edge_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.accepted(edge_docs, none).count() == edge_docs.count()
    assert quality_classifier.accepted(edge_docs, none).columns == edge_docs.columns
    assert quality_classifier.selection(no_docs, none).count() == 0


def test_blocks_make_the_features_of_the_whole(monkeypatch):
    text = "The quick, brown FOX jumped 12 times!! " * 40
    whole = Counter(int(x) for part in quality_classifier.Features().blocks(text) for x in part)
    monkeypatch.setattr(quality_classifier, "_BLOCK", 7)
    assert Counter(int(x) for part in quality_classifier.Features().blocks(text) for x in part) == whole
