"""Hard negatives, token files and whitening against brute force, and on the edge cases their docstrings define."""

from __future__ import annotations

import math
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import hard_negatives, token_files, whitening
from pageloom.llm.catalog import END_ID, QUERIES

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="session")
def edge_vectors(spark):
    """Nulls everywhere, non-finite components, short and empty vectors, many copies of one vector, repeated ids and rows, a column whose name clashes."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(0, 0.3, 6)], int(rng.integers(0, 3)), "x") for i in range(150)]
    rows += [(200 + i, [0.5, 0.25, -0.5, 0.125, 0.0, 0.25], i % 2, "y") for i in range(60)]
    rows += [(7, rows[3][1], 1, "r")] * 2 + [rows[100]] * 3
    rows += [(300, [0.4, 0.2], 1, "s"), (301, [], 2, "s"), (302, [0.0] * 6, 1, "z"), (400, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0], 9, "l")]
    rows += [(500, None, 1, "n"), (600, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1, "n"), (700, [NAN] * 6, 1, "n"), (800, [INF, 0.0, 0.0, 0.0, 0.0, 0.0], 1, "n"),
             (900, [0.1] * 6, None, "n"), (None, [0.1] * 6, 1, "n")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, Least string").repartition(3)


def sound(rows, factor, shift):
    dims = max((len(r.embedding) for r in rows if usable(r)), default=0)
    return [(r, [math.floor(factor * float(c)) + shift for c in r.embedding] + [shift] * (dims - len(r.embedding))) for r in rows if usable(r)]


def usable(r):
    return r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)


# -- hard negatives

def brute_negatives(rows):
    own = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, x)
           for r, x in sound(rows, 256, 0) if r.vec_id is not None and r.label is not None]
    out = []
    for a, (aid, alabel, ax) in enumerate(own):
        if aid % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(ax, x)), i, label) for k, (i, label, x) in enumerate(own) if k != a)
        for score, pid, _ in [s for s in scored if s[2] == alabel][:5]:
            fit = [s for s in scored if s[2] != alabel and 80 * -score <= 100 * -s[0] <= 100 * -score][:5]
            out += [(aid, pid, k + 1, i, -score, -s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out)


def mined(df, **sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=label, **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"part_rows": 20, "block_rows": 2}])
def test_negatives_against_loops(edge_vectors, sizes):
    want = brute_negatives(edge_vectors.collect())
    assert want and mined(edge_vectors, **sizes) == want


def test_negatives_of_nothing(edge_vectors):
    assert mined(edge_vectors.limit(0)) == [] == mined(edge_vectors.filter("vec_id = 100 or vec_id is null"))


def test_coordinate_lists_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 100, (40, 16))
    rows = np.floor(np.vstack([c + rng.normal(0, 4, (50, 16)) for c in centres]) * rng.choice([0.5, 1.0, 3.0], (2000, 1))).astype(np.int64)
    anchors = rows[::50]
    need = 0.9 * (anchors.astype(float) ** 2).sum(1)
    seen = [set() for _ in anchors]

    def take(a, at, scores):
        seen[a].update(at[scores >= need[a]].tolist())
        return need[a]

    verified = hard_negatives.search(rows, anchors, need.copy(), take, bucket_rows=128)
    assert [set(np.flatnonzero(rows @ q >= n).tolist()) for q, n in zip(anchors, need)] == seen
    assert verified < 0.5 * len(rows) * len(anchors)


def test_scores_beyond_doubles_stay_exact():
    rows, anchors = np.array([[2**30 + 1, 1], [2**30, 0], [5, -7]]), np.array([[2**30 + 3, 3]])
    got = {}
    hard_negatives.search(rows, anchors, np.array([0.0]), lambda a, at, scores: got.update(zip(at.tolist(), map(int, scores))) or 0.0)
    assert got == {i: int(r[0]) * (2**30 + 3) + int(r[1]) * 3 for i, r in enumerate(rows)}


# -- token files

@pytest.fixture(scope="session")
def tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = str(public.path("word_bpe_49k.json"))
    return path, tokenizers.Tokenizer.from_file(path)


def brute_ids(docs, plain):
    return [(d, plain.encode(t or "", add_special_tokens=False).ids + [END_ID]) for d, t in docs]


def digests(pairs):
    return sorted((str(d), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in pairs)


@pytest.mark.parametrize("by_word", [True, False])
def test_token_files_against_whole_texts(spark, edge_docs, tokenizer, by_word):
    extra = spark.createDataFrame([(301, "<|endoftext|> a<|startoftext|>b we're 12 ABĆ x y ẛ̣ ǅ"), (302, "x" * 5000 + " " + "naïve\x0bword\x1cword")],
                                  "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text", "Shard").unionByName(extra, allowMissingColumns=True)
    files = token_files.write_token_files(docs, tokenizer[0], END_ID, by_word=by_word)
    rows = token_files.read_token_files(files, tokens=True).collect()
    want = brute_ids([(r.doc_id, r.text) for r in docs.collect()], tokenizer[1])
    assert digests((r.doc_id, r.tokens) for r in rows) == digests(want) == sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows)
    rows.sort(key=lambda r: r.start)
    starts = np.cumsum([0] + [r.n_tokens for r in rows])
    assert [r.start for r in rows] == starts[:-1].tolist()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    # the files themselves: nothing but ids, one after the other
    flat = np.concatenate([np.memmap(f.file.removeprefix("file://") + ".bin", "<u2", "r") for f in files.orderBy("part").collect()])
    assert flat.tolist() == [i for r in rows for i in r.tokens]


def test_long_texts_are_cut_at_blanks(tokenizer, monkeypatch):
    text = ("Some words, isn't it? " * 40 + "y" * 300 + "\n") * 3
    assert "".join(token_files.pieces_of(text, 50)) == text
    encoder = token_files.Encoder(Path(tokenizer[0]).read_text(encoding="utf-8"), END_ID, True)
    pieces = list(token_files.pieces_of(text, 50))
    ids, counts = encoder.encode(pieces, [False] * (len(pieces) - 1) + [True])
    assert ids.tolist() == brute_ids([(0, text)], tokenizer[1])[0][1] and counts.sum() == len(ids)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 3)  # forgetting words changes nothing
    assert [encoder.encode([p], [False])[0].tolist() for p in pieces] == [tokenizer[1].encode(p, add_special_tokens=False).ids for p in pieces]


def test_token_files_of_nothing_and_broken_ones(spark, no_docs, tokenizer, tmp_path):
    assert token_files.read_token_files(token_files.write_token_files(no_docs, tokenizer[0], END_ID)).count() == 0
    files = token_files.write_token_files(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tokenizer[0], END_ID, folder=str(tmp_path / "t"))
    name = files.first().file
    Path(name + ".bin").write_bytes(b"\0\0")
    with pytest.raises(ValueError, match="ids and offsets differ"):
        token_files.TokenFile(name)


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the driver's tables")
def test_registered_token_files(spark, small_docs, tokenizer):
    rows = QUERIES["op12_token_files"](spark, SMALL).collect()
    want = brute_ids(sorted((r.doc_id, r.text) for r in small_docs.collect()), tokenizer[1])
    starts = np.cumsum([0] + [len(ids) for _, ids in want]).tolist()
    assert sorted(tuple(r) for r in rows) == [(d, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (d, ids), s in zip(want, starts)]


# -- whitening

def check_whitening(rows, got, wanted=16):
    own = sound(rows, 64, 1_000_000)
    fit = sorted({tuple(x) for _, x in own})
    if not fit:
        assert got == []
        return
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1]
    k = int((values > 1e-12 * values[0]).sum()) if n > 1 else 0
    k = min(k, wanted)
    assert len(got) == k * len(own)
    if not k:
        return
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(r.vec_id), sum((n * c - s) ** 2 for c, s in zip(x, sums))) for r, x in own)
    assert {r.n for r in got} == {n} and {r.identity_error <= 1e-4 for r in got} == {True}
    for c in range(1, k + 1):
        assert all(r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) for r in got if r.component == c)
    # the products of whitened rows do not depend on signs or on the basis inside equal eigenvalues
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    plain = {str(r.vec_id): (np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ p) / np.sqrt(e) for r, x in own}
    for c in range(1, k + 1):
        mine = {str(r.vec_id): r.whitened for r in got if r.component == c}
        a, b = np.array([mine[i] for i in sorted(mine)]), np.array([plain[i][c - 1] for i in sorted(mine)])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_against_numpy(edge_vectors):
    # ids that repeat with different vectors would not be told apart below
    rows = edge_vectors.filter("coalesce(vec_id, -1) not in (7)")
    check_whitening(rows.collect(), whitening.whitened(rows).collect())


def test_whitening_of_little(edge_vectors):
    for part in (edge_vectors.limit(0), edge_vectors.filter("vec_id = 500"), edge_vectors.filter("vec_id between 200 and 220"), edge_vectors.filter("vec_id in (1, 2, 9)")):
        check_whitening(part.collect(), whitening.whitened(part).collect())


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the driver's tables")
def test_registered_whitening(spark):
    check_whitening(spark.read.parquet(f"{SMALL}/embeddings.parquet").collect(), QUERIES["op13_whitening"](spark, SMALL).collect())


@pytest.mark.parametrize("step", [0.0, 0.3, 1.0, 3.0])
def test_no_cut_between_eigenvalues_that_differ_by_rounding(step):
    near = 1 + step * np.finfo(float).eps * np.arange(12)
    for k in range(1, 13):
        assert whitening.Inertia(np.diag(near)).cut(k)[1] == 12
        shift, found = whitening.Inertia(np.diag([*near, 0.5, 0.4])).cut(k)
        assert found == 12 and 0.5 < shift < 1
    assert len(whitening.eigenpairs(np.diag(near), 16)[0]) == 12


@pytest.mark.parametrize("spectrum", [
    [5.0] * 3 + [4.0] * 20 + [1.0] * 10, 2.0 ** -np.arange(40.0), [1e9] + [1.0] * 30, [1.0], [0.0, 0.0, 3.0], np.linspace(1, 2, 60), [7.0] * 12])
def test_eigenpairs(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    v = q @ np.diag(spectrum) @ q.T
    values, vectors = whitening.eigenpairs(v, 16)
    assert np.allclose(values, sorted((s for s in spectrum if s > 0), reverse=True)[:16], rtol=1e-10, atol=1e-12 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * max(spectrum) * d


def test_inertia_counts():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((30, 30))
    v = v + v.T
    values, inertia = np.linalg.eigvalsh(v), whitening.Inertia(v)
    assert all(inertia.above(s) == (values > s).sum() for s in np.linspace(values[0] - 1, values[-1] + 1, 200))
    for k in range(1, 31):
        shift, above = inertia.cut(k)
        assert above == k == (values > shift).sum()


def test_deviation_beyond_64_bits_is_null(spark):
    rows = spark.createDataFrame([(i, [float(10**8 * i), 1.0 * i]) for i in range(40)], "vec_id long, embedding array<double>")
    got = whitening.whitened(rows).collect()
    assert any(r.deviation is None for r in got) and len(got) == 40  # the rows lie on a line
