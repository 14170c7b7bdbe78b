"""Work that follows the input: splits of small files, texts that repeat, rows and batches of bounded size."""

from __future__ import annotations

from pyspark.sql import functions as F

import random
import time
import tracemalloc
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.catalog import page_regions
from pageloom.catalog.registry import Tables
from pageloom.functions import geometry as G
from pageloom.operators import boxes, images, naming, regions, segments, settle, stages
from pageloom.plans import ordered
from pageloom.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_small_tables_are_dealt_out_to_all_cores(spark):
    t = Tables(spark, SMALL)
    for df in (t.part, t.fx_seg, t.fx_region, t.events, t.orders):
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_terms_are_enforced_in_repeated_texts(spark):
    rows = [(i % 2, 1, "red ring", "red ring said") for i in range(6)] + [(9, None, "red", "red"), (9, 1, None, "red"), (9, 1, "", "red"), (9, 2, "red", "red")]
    df = spark.createDataFrame(rows, "seg_id long, k long, src string, trans string")
    terms = spark.createDataFrame([(1, "red", "đỏ", 1), (1, "red ring", "nhẫn", 2)], "k long, zh string, vi string, pos long")
    got = segments.enforce_terms(df, terms, ["seg_id"], ["k"])
    assert got.columns == [*df.columns, "enforced"]
    assert sorted(r.enforced for r in got.collect()) == ["nhẫn said"] * 6 + ["red"] * 4


def test_many_regions_are_spread_without_pairing_them(spark):
    boxes = [(i % 997 / 1000.0, i % 7 / 10.0, i % 3 == 0) for i in range(6_000)]
    shape = T._parse_datatype_string(f"image string, mode string, mask_dilate int, regions {regions.EMPTY}")
    blank = (None,) * 7
    row = lambda x, y, only: (x, y, 0.003, 0.03, None, only or None, False, *blank)
    one = lambda image, of: spark.createDataFrame([(image, "merge", 1, [row(*b) for b in of])], shape)
    own, template = one("a", boxes[::2]), one("t", boxes + boxes[1:9]).drop("image")
    begun = time.monotonic()
    made = regions.broadcast_regions(own, template, own.select("image")).first()
    assert time.monotonic() - begun < 20
    want = boxes[::2] + [b for b in dict.fromkeys(boxes) if b not in set(boxes[::2])]
    assert [(r.x, r.y, bool(r.inpaint_only)) for r in made.regions] == want


def test_failing_rows_are_answered_in_slices(spark):
    seen = spark.range(1000, numPartitions=1).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id").cast("string")).alias("t"))

    made = stages.row_errors(seen, lambda x: x + "!", "t", "out")
    assert made.columns == ["id", "t", "out", "status", "error"]
    assert all((r.out, r.status) == ((f"{r.id}!", "ok") if r.t else (None, "failed")) for r in made.collect())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and stages.SLICE_ROWS < 1000


def test_pairs_travel_without_what_does_not_decide_them(spark):
    rows = [(1, i, i * 40 % 900, i * 70 % 1200, i * 40 % 900 + 150, i * 70 % 1200 + 30, "text " * 50) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, region_id int, x1 int, y1 int, x2 int, y2 int, text string")
    pairs = {(r.a_id, r.b_id) for r in boxes.mergeable_lines(df, coarse=True).collect()}
    for tile in (64, 4096):
        wide = boxes._ordered_pairs(df, 200, tile=tile)
        assert pairs == {(r.a_id, r.b_id) for r in boxes._ids(wide.filter(G.lines_mergeable_coarse(F.col("a"), F.col("b")))).collect()}
    whole = boxes.near_pairs_of(df, df, 10, tile=64)
    assert whole.columns == ["page_id", "a", "b"] and whole.select("a.*").columns == df.columns
    assert whole.filter("a.page_id = 1 and b.text is not null").count() == whole.count() >= 60
    distinct = len({(r.a, r.b) for r in whole.select(F.col("a.region_id").alias("a"), F.col("b.region_id").alias("b")).collect()})
    assert distinct == whole.count()


def test_coarse_lines_list_fewer_tiles(spark):
    df = spark.createDataFrame([(1, 1, 300, 300, 450, 340)], "page_id long, region_id int, x1 int, y1 int, x2 int, y2 int")
    plan = boxes.mergeable_lines(df, coarse=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "512" in plan and "_g" not in plan


def test_rows_of_a_key_are_held_packed():
    frames = [pd.DataFrame({"seg_id": [5, 1], "pair": ["e", None]}), pd.DataFrame({"seg_id": [3, 1], "pair": ["c", "second"]}), pd.DataFrame({"seg_id": [9], "pair": [None]})]
    got = jobs._in_order(iter(frames), "seg_id")
    assert [(r.seg_id, r.pair) for r in got] == [(1, None), (1, "second"), (3, "c"), (5, "e"), (9, None)]
    assert list(jobs._in_order(iter([]), "seg_id")) == []
    many = (pd.DataFrame({"seg_id": range(i, 20_000, 20), "pair": [f"{i} đ" * 100 for _ in range(i, 20_000, 20)]}) for i in range(20))
    tracemalloc.start()
    rows = jobs._in_order(many, "seg_id")
    assert next(rows).seg_id == 0
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    # as objects the texts alone are 15 MB
    assert held < 5_000_000 and sum(1 for _ in rows) == 19_999


def test_pictures_reach_python_in_small_batches(spark):
    plain, framed = bytes([9]) * (20 * 20 * 3), bytearray([250]) * (20 * 20 * 3)
    for y in range(4, 16):
        framed[(y * 20 + 4) * 3:(y * 20 + 16) * 3] = bytes(range(100, 136))
    rows = [("a", 20, 20, 3, bytes(framed), True), ("b", 20, 20, 3, plain, True), ("c", -1, -1, -1, b"", False), ("d", 20, 20, 3, b"x", True), ("e", 20, 20, 3, plain, None)]
    made = spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, data binary, readable boolean")
    boxes_ = images.autotrim_boxes(made)
    done = images.crop_images(made, boxes_)
    found = {r.origin: (tuple(r.box) if r.box else None, r.error) for r in boxes_.collect()}
    assert found["a"] == ((4, 4, 16, 16), None) and found["b"] == (None, None) and found["c"] == found["e"] == (None, "unreadable")
    assert found["d"][0] is None and found["d"][1].startswith("ValueError")
    got = {r.origin: (r.status, r.width, r.height, r.nChannels, len(r.data)) for r in done.collect()}
    assert got == {"a": ("cropped", 12, 12, 3, 432), "b": ("copied", 20, 20, 3, 1200), **{o: ("failed", 0, 0, 0, 0) for o in "cde"}}
    for df in (boxes_, done):  # an Arrow batch holds up to 10,000 pictures, a plain one 100
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "MapInPandas" not in plan and "Arrow" not in plan


def test_only_rows_of_pages_that_go_on_are_seen_from_other_cells(spark, monkeypatch):
    pinned = []
    monkeypatch.setattr(settle, "pin", lambda df, real=settle.pin: pinned.append(real(df)) or pinned[-1])
    rows = [(p, r, 5, 30 * r, 60, 30 * r + 20) for p in range(40) for r in range(4)]
    df = spark.createDataFrame(rows, "page_id long, region_id int, x1 int, y1 int, x2 int, y2 int")
    got = boxes.group_nearby(df, rows=16).collect()
    assert len(got) == 160 and {r.group_no for r in got} == {0}
    laid, crossing = [d for d in pinned if "y2" in d.columns][:2]
    on = {p for p, n in laid.groupBy("page_id").agg(F.countDistinct("cell")).collect() if n > 1}
    assert laid.count() == 160 and {r.page_id for r in crossing.collect()} == on and crossing.count() == 4 * len(on) < 160


def first_come(rows, limit):
    """Brute force: places of the rows that stay. Rows: page, region, x1, y1, x2, y2."""
    kept, chosen = [], {}
    for k, (page, region, x1, y1, x2, y2) in sorted(enumerate(rows), key=lambda r: [v is not None and v for v in r[1][:2]]):
        plays = None not in rows[k] and x2 > x1 and y2 > y1
        size = plays and (x2 - x1) * (y2 - y1)
        for a, b, c, d, other in chosen.get(page, []) if plays else []:
            common = max(0, min(x2, c) - max(x1, a)) * max(0, min(y2, d) - max(y1, b))
            if common / (size + other - common) > limit:
                break
        else:
            kept.append(k)
            if plays:
                chosen.setdefault(page, []).append((x1, y1, x2, y2, size))
    return sorted(kept)


def scattered(rng, pages, most):
    """Boxes with copies, flat ones and ones with an unknown region or side."""
    rows = []
    for page in pages:
        for region in rng.sample(range(1000), rng.randint(1, most)):
            x, y = rng.randint(-9, 60), rng.randint(-9, 60)
            rows.append((page, region, x, y, x + rng.randint(-1, 30), y + rng.randint(-1, 30)))
            if rng.random() < 0.1:
                rows.append((page, region + 1000, *rows[-1][2:]))
    return rows + [tuple(None if k == hole else v for k, v in enumerate((r[0], r[1] + 5000, *r[2:]))) for hole, r in enumerate(rows[:6]) if hole]


_BOXES = "page_id long, region_id int, x1 int, y1 int, x2 int, y2 int"


def test_pages_that_fit_a_cell_are_played_where_they_meet(spark, monkeypatch):
    pinned = []
    monkeypatch.setattr(settle, "pin", lambda df, real=settle.pin: pinned.append(real(df)) or pinned[-1])
    rng = random.Random(11)
    rows = scattered(rng, range(-20, 40), 60)
    frame = lambda: spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], _BOXES + ", k int")
    df = frame()
    made = boxes.dedupe_candidates(df, 0.3)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Generate" not in plan
    assert made.columns == df.columns and sorted(r.k for r in made.collect()) == first_come(rows, 0.3)
    assert [d.count() for d in pinned] == [0, 0]  # no pairs are written down
    rows += scattered(rng, [None], 60)
    for cell in (25, 50):  # pages of both kinds
        pinned.clear()
        assert sorted(r.k for r in boxes.dedupe_candidates(frame(), 0.3, cell).collect()) == first_come(rows, 0.3)
        assert pinned[0].count() == sum(n for page, n in Counter(r[0] for r in rows).items() if page is None or n > cell)


def test_numbering_and_choosing_share_an_exchange(spark):
    plan = page_regions.j11(Tables(spark, "/root/testdata/sf0.01"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_whole_pages_are_played_in_blocks_and_pieces(monkeypatch):
    rng = random.Random(12)
    rows = sorted(scattered(rng, [-7, 0, 3, 4, 2**40], 150), key=lambda r: [v is not None and (1, v) or (0, 0) for v in r[:2]])
    names = ["page_id", "region_id", "x1", "y1", "x2", "y2"]
    turns = [sum(r[0] == rows[k][0] for r in rows[:k + 1]) for k in range(len(rows))]
    table = pa.table({**{n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)}, "k": pa.array(range(len(rows))), "_turn": pa.array(turns)})
    want = {limit: first_come(rows, limit) for limit in (0.0, 0.25, 0.6)}
    assert len(want[0.0]) < len(want[0.25]) < len(want[0.6]) < len(rows)
    for batch, block, piece in ((1, 1, 1), (7, 5, 3), (40, 16, 1000), (10_000, 2_048, 1 << 18)):
        monkeypatch.setattr(settle, "BLOCK_ROWS", block)
        monkeypatch.setattr(settle, "PIECE_PAIRS", piece)
        for limit, kept in want.items():
            got = [k for b in settle._first_come(limit)(iter(table.to_batches(batch))) for k in b.column("k").to_pylist()]
            assert got == kept
    assert list(settle._first_come(0.5)(iter([]))) == []


def test_small_groups_are_one_block_however_far_apart_their_rows_lie(spark):
    rows = spark.range(1000).select((F.col("id") % 200).alias("k"), (F.col("id") * 1000).alias("pos"), F.lit("x").alias("s"))
    blocks = ordered._blocks(rows, ["k"], "pos", 16).select("_key", "_block")
    assert blocks.count() == 1000 and blocks.distinct().count() == 200
    longer = rows.withColumn("k", F.when(F.col("k") < 100, 0).otherwise(F.col("k")))
    assert ordered._blocks(longer, ["k"], "pos", 16).filter("_key.k = 0").select("_block").distinct().count() > 400
    want = longer.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("pos")).cast("bigint"))
    none, some = longer.select("k").limit(0), longer.filter("k = 0").select("k").distinct()
    for long in (None, none, some):
        assert sorted(ordered.dense_position(longer, ["k"], "pos", "n", 16, long).collect()) == sorted(want.collect())


def test_contests_rank_only_what_comes_before_the_rivals(spark, monkeypatch):
    names = ["a.jpg", "a.jpg", "a_1.jpg", "a_1.jpg", "a_2.jpg"] + ["a.jpg", "a_1.jpg", "b.jpg"] * 300
    work = spark.createDataFrame([(f"/f{f}", n, i) for f in range(30) for i, n in enumerate(names)], "folder string, name string, idx long")
    ranked, settle_ = [], naming._settle
    monkeypatch.setattr(naming, "_settle", lambda *given: ranked.append(given[2].count()) or settle_(*given))
    monkeypatch.setattr(naming, "LOT_ROWS", 25)
    got = naming.assign_unique_names(work, spark.createDataFrame([("/f1", "a_3.jpg")], "folder string, name string"))
    assert ranked == [30 * 2]
    for folder, there in (("/f0", set()), ("/f1", {"a_3.jpg"}), ("/f29", set())):
        taken, want = set(there), {}
        for i, n in enumerate(names):
            want[i] = next(c for k in range(2000) if (c := n if k == 0 else n.replace(".", f"_{k}.")) not in taken)
            taken.add(want[i])
        assert {r.idx: r.unique_name for r in got.filter(F.col("folder") == folder).collect()} == want
