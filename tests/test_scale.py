"""Block-wise operators equal plain windows, also when one key holds most rows and blocks are tiny."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pageloom.functions import text
from pageloom.operators import context
from pageloom.plans import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows, at = [], {}
    for i in range(1500):
        key = 0 if rng.random() < 0.7 else rng.randint(1, 20)
        at[key] = at.get(key, 0) + rng.randint(1, 5)
        rows.append((key, at[key], rng.randint(0, 9), None if rng.random() < 0.6 else f"v{i}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, pos long, v int, s string").repartition(5)


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(tuple, a.select(cols).collect()), key=str) == sorted(map(tuple, b.select(cols).collect()), key=str)


def w():
    return Window.partitionBy("k").orderBy("pos")


def test_running_sum(skewed):
    same(ordered.running_sum(skewed, ["k"], "pos", F.col("v"), "out", rows=16),
         skewed.withColumn("out", F.sum("v").over(w().rowsBetween(Window.unboundedPreceding, 0))))


def test_dense_position(skewed):
    same(ordered.dense_position(skewed, ["k"], "pos", "out", rows=16), skewed.withColumn("out", F.row_number().over(w())))


def test_carry_last(skewed):
    same(ordered.carry_last(skewed, ["k"], "pos", F.col("s"), "out", rows=16),
         skewed.withColumn("out", F.last("s", True).over(w().rowsBetween(Window.unboundedPreceding, 0))))


def test_neighbours_across_blocks(skewed):
    placed = ordered.dense_position(skewed, ["k"], "pos", "n", rows=16)
    cols = lambda f: {"a": F.lag("v").over(f), "b": F.lead("v", 2).over(f), "c": F.collect_list("v").over(f.rowsBetween(-3, -1))}
    same(ordered.with_neighbours(placed, ["k"], "n", 3, 2, cols, rows=8), placed.withColumns(cols(w())))


def test_any_order(skewed):
    order = [F.col("v"), -F.col("pos")]
    same(ordered.any_order_position(skewed, ["k"], order, "out"),
         skewed.withColumn("out", F.row_number().over(Window.partitionBy("k").orderBy(*order))))


def test_top_and_best(skewed):
    rank = F.row_number().over(Window.partitionBy("k").orderBy("v", "pos"))
    same(ordered.top_per_group(skewed, ["k"], [F.col("v"), F.col("pos")], 4, spread=3), skewed.withColumn("r", rank).filter("r <= 4").drop("r"))
    same(ordered.best_per_group(skewed, ["k"], F.struct("v", "pos")), skewed.withColumn("r", rank).filter("r = 1").drop("r"))


def test_recent_items(skewed):
    got = context.recent_items(skewed, ["k"], "pos", F.col("s"), 3, "out")
    want = skewed.withColumn("out", F.slice(F.reverse(F.collect_list("s").over(w().rowsBetween(Window.unboundedPreceding, -1))), 1, 3)).withColumn("out", F.reverse("out"))
    same(got, want)


def test_result_does_not_depend_on_partitions(spark, skewed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        few = ordered.running_sum(skewed.repartition(2), ["k"], "pos", F.col("v"), "out", rows=16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    many = ordered.running_sum(skewed.repartition(11), ["k"], "pos", F.col("v"), "out", rows=16).collect()
    assert sorted(map(tuple, few), key=str) == sorted(map(tuple, many), key=str)


def test_null_keys_survive(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("a", 1, 5)], "k string, pos long, v int")
    got = ordered.running_sum(rows, ["k"], "pos", F.col("v"), "out", rows=1).collect()
    assert sorted((r.k or "", r.pos, r.out) for r in got) == [("", 1, 1), ("", 2, 3), ("a", 1, 5)]


@pytest.mark.parametrize("build", [text.strip_outer_quotes, text.ensure_terminal_punct, lambda c: text.strip_artifacts(c, "chat"), text.list_breaks])
def test_idempotent(spark, build):
    rows = spark.createDataFrame([(s,) for s in ("'\"a\"'", "「b", "c <|1|> |x", "1. a 2. b", "", " ", "d.", "</s>e")], "t string")
    assert all(r.a == r.b for r in rows.select(build("t").alias("a")).select("a", build("a").alias("b")).collect())


def test_slots_have_the_asked_size(spark):
    rows = spark.createDataFrame([(["a"], "x\ny\nz", 2), ([], "", 3), (["a", "b", "c"], "", 1)], "p array<string>, r string, n int")
    assert [r.s for r in rows.select(text.align_slots("p", "r", "n").alias("s")).collect()] == [["x", "y"], ["", "", ""], ["a"]]


def test_terms_in_a_very_long_source(spark):
    from pageloom.operators.segments import enforce_terms

    words = [f"词{i}語" for i in range(40)]
    src = "".join(f"{chr(0x4E00 + i % 5000)}" for i in range(100_000)) + "".join(words)
    rows = spark.createDataFrame([(1, 1, src, " ".join(words)), (1, 2, "词", "词1語"), (1, 3, None, "词1語"), (2, 4, src, "词1語")], "series_id long, seg_id long, src string, trans string")
    terms = spark.createDataFrame([(1, w, f"T{i}.", i) for i, w in enumerate(words)] + [(1, "缺", "none", 99), (1, "", "blank", 100)], "series_id long, zh string, vi string, pos int")
    got = {r.seg_id: r.enforced for r in enforce_terms(rows, terms, ["seg_id"], ["series_id"]).collect()}
    assert got == {1: " ".join(f"T{i}." for i in range(40)), 2: "词1語", 3: "词1語", 4: "词1語"}


def test_of_two_writers_the_later_one_fails(spark, monkeypatch):
    import pytest

    from pageloom.sources import snapshots

    path, df = snapshots.scratch_path(spark, "store"), spark.range(3)
    assert snapshots.current_version(spark, path) is None
    first = snapshots.write_snapshot(df, path)
    latest = snapshots._latest
    seen = iter([0])  # this writer began before the first version was there
    monkeypatch.setattr(snapshots, "_latest", lambda *a: next(seen, latest(*a)))
    with pytest.raises(snapshots.StoreChanged):
        snapshots.write_snapshot(df, path)
    monkeypatch.undo()
    assert snapshots.current_version(spark, path) == first
    second = snapshots.write_snapshot(df.limit(1), path)
    assert snapshots.current_version(spark, path) == second and snapshots.read_snapshot(spark, path, "id bigint").count() == 1
