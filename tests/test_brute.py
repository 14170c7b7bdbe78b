"""Operators SQL cannot express, against plain loops on small random data."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import predicates, text
from pageloom.functions import lexicon as L
from pageloom.operators import boxes, segments
from pageloom.operators.naming import assign_unique_names


# ---------------------------------------------------------------- repeated text


def repeats(sample: str, t: int = 5) -> bool:
    import itertools
    import re

    if len(sample.strip()) < t:
        return False
    longest = lambda xs: max((len(list(g)) for _, g in itertools.groupby(xs)), default=0)
    if longest(sample) >= t or longest(re.findall(r"[一-鿿]|\S+", sample)) >= t:
        return True
    words = sample.split()
    if len(words) < 2 * t:
        return False
    for i in range(len(words) - t + 1):
        phrase, rest = " ".join(words[i:i + t // 2]), " ".join(words[i + t // 2:])
        if phrase in rest and sample.count(phrase) >= 3:
            return True
    return False


def test_repetition(spark):
    rng = random.Random(3)
    words = ["好", "好好", "a", "an", "than", "word", "好x", "x好", "，"]
    samples = ["好 好好 好 好", "x好 好 好 好 好", "好word word word word word", "aaaaa", "ab ab ab ab ab", "than all an all an all a b c d e", "", "    "]
    for _ in range(400):
        samples.append("".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(3, 16))))
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    for r in rows.select("s", predicates.is_repetitive("s").alias("v")).collect():
        assert r.v == repeats(r.s), r.s


# ---------------------------------------------------------------- brackets


def repaired(sample: str) -> str:
    opens, closes = dict(L.BRACKETS), {c for _, c in L.BRACKETS}
    sample = sample.strip(L.WHITESPACE)
    if not any(ch in opens or ch in closes for ch in sample):
        return sample
    partner, waiting = {}, []
    for i, ch in enumerate(sample):
        if ch in opens:
            waiting.append(i)
        elif ch in closes and waiting:
            o = waiting.pop()
            partner[o], partner[i] = sample[o], opens[sample[o]]
    return "".join(partner.get(i, "") if ch in opens or ch in closes else ch for i, ch in enumerate(sample)).strip(L.WHITESPACE)


def test_brackets(spark):
    rng = random.Random(5)
    samples = ["don't", "(a]", "】a(", "", "a", '"x"', "(「a)」", "$1 (\\)"]
    samples += ["".join(rng.choice("ab()[]「」'\"<>»«（） $\\") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    for r in rows.select("s", text.repair_brackets("s").alias("v")).collect():
        assert r.v == repaired(r.s), r.s


# ---------------------------------------------------------------- boxes


def random_boxes(seed: int, pages: int = 6, per_page: int = 40):
    rng = random.Random(seed)
    out = []
    for p in range(pages):
        for i in range(per_page):
            x, y = rng.randint(0, 300), rng.randint(0, 300)
            out.append((p, i, x, y, x + rng.randint(20, 90), y + rng.randint(20, 90), "x" * rng.randint(1, 6)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, region_id int, x1 int, y1 int, x2 int, y2 int, text string")


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    return w * h / (size(a) + size(b) - w * h)


def by_page(rows):
    pages = {}
    for r in rows:
        pages.setdefault(r[0], []).append(r)
    return pages


def survivors(rows, limit):
    kept = set()
    for page, rs in by_page(rows).items():
        alive = [True] * len(rs)
        for i, a in enumerate(rs):
            for j in range(i + 1, len(rs)):
                if alive[i] and alive[j] and iou(a, rs[j]) > limit:
                    alive[j if len(a[6]) >= len(rs[j][6]) else i] = False
        kept |= {(page, r[1]) for r, ok in zip(rs, alive) if ok}
    return kept


def ids(df):
    return {(r.page_id, r.region_id) for r in df.select("page_id", "region_id").collect()}


@pytest.mark.parametrize("cell", [16_384, 9], ids=["one cell", "many cells"])
def test_dedupe_overlaps(spark, cell):
    rows = random_boxes(1)
    got = ids(boxes.dedupe_overlaps(frame(spark, rows), 0.2, cell))
    assert got == survivors(rows, 0.2) and len(got) < len(rows)


@pytest.mark.parametrize("cell", [16_384, 9], ids=["one cell", "many cells"])
def test_dedupe_candidates(spark, cell):
    rows = random_boxes(2)
    rows += [(0, 100 + i, *rows[3 + i % 2][2:]) for i in range(30)]  # copies
    rows += [(1, 200 + i, 5, 5, 5, 90, "flat") for i in range(3)]
    kept = set()
    for page, rs in by_page(rows).items():
        chosen = []
        for r in rs:
            if all(iou(r, c) <= 0.2 for c in chosen):
                chosen.append(r)
        kept |= {(page, r[1]) for r in chosen}
    assert ids(boxes.dedupe_candidates(frame(spark, rows), 0.2, cell)) == kept


def shuffled_chain(n, step=10):
    """Boxes of 20 down a page, each over half of the one before, in blocks whose numbers run against each other."""
    order = sorted(range(n), key=lambda i: (i // 50 % 2, i))
    return [(0, i, 0, order[i] * step, 20, order[i] * step + 20, "x" * (1 + i % 3)) for i in range(n)]


def count_rounds(monkeypatch, name):
    from pageloom.operators import settle

    made, plain = [], getattr(settle, name)
    monkeypatch.setattr(settle, name, lambda *a: made.append(1) or plain(*a))
    return made


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rows = shuffled_chain(2000)
    kept = []
    for r in rows:
        if all(iou(r, c) <= 0.3 for c in kept if abs(r[3] - c[3]) < 20):
            kept.append(r)
    want = {(r[0], r[1]) for r in kept}
    frame_ = frame(spark, rows)
    pins = count_rounds(monkeypatch, "pin")
    assert ids(boxes.dedupe_candidates(frame_, 0.3, 250)) == want
    assert len(pins) <= 2 * 2000 // 250 + 2
    pins.clear()
    assert ids(boxes.dedupe_candidates(frame_, 0.3)) == want
    assert len(pins) == 2  # the rivalries, one round
    pins.clear()
    assert ids(boxes.dedupe_overlaps(frame_, 0.3, 250)) == survivors(rows, 0.3)
    assert len(pins) <= 3 * 2000 // 250 + 3


def test_a_crowded_band_is_grouped_in_cells(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(0, i, x, y, x + rng.randint(10, 90), y + rng.randint(8, 30), "t") for i in range(20_000) for x, y in [(rng.randint(0, 900), rng.randint(0, 60_000))]]
    rows += [(p, i, 10 * i, 5, 10 * i + 8, 20, "t") for p in range(1, 30) for i in range(10)]
    pins = count_rounds(monkeypatch, "pin")
    got = {(r.page_id, r.region_id): r.group_no for r in boxes.group_nearby(frame(spark, rows), rows=2500).collect()}
    assert got == swept(rows)
    assert len(pins) <= 4 * 9  # four tables a round, a round for each of the cells at most


def grouped(rows, gap=18, share=0.15):
    out = {}
    for page, rs in by_page(rows).items():
        left = sorted(rs, key=lambda r: (r[3], r[2], r[1]))
        while left:
            group, left = [left[0]], left[1:]
            grew = True
            while grew:
                x1, y1, x2, y2 = min(r[2] for r in group), min(r[3] for r in group), max(r[4] for r in group), max(r[5] for r in group)
                near = [r for r in left if max(r[3] - y2, y1 - r[5]) <= gap and (min(r[4], x2) - max(r[2], x1)) / (max(r[4], x2) - min(r[2], x1)) > share]
                group += near
                left = [r for r in left if r not in near]
                grew = bool(near)
            for r in group:
                out[(page, r[1])] = group[0][1]
    return out


def swept(rows, gap=18, share=0.15):
    """``grouped`` for many regions: candidates end at the group's lower edge."""
    out = {}
    for page, rs in by_page(rows).items():
        rs = sorted(rs, key=lambda r: (r[3], r[2], r[1]))
        used = [False] * len(rs)
        for i, seed in enumerate(rs):
            if used[i]:
                continue
            group, used[i], grew = [seed], True, True
            while grew:
                x1, y2, x2 = min(r[2] for r in group), max(r[5] for r in group), max(r[4] for r in group)
                grew = False
                for k in range(i + 1, len(rs)):
                    r = rs[k]
                    if r[3] - y2 > gap:
                        break
                    if not used[k] and (min(r[4], x2) - max(r[2], x1)) / (max(r[4], x2) - min(r[2], x1)) > share:
                        used[k] = grew = True
                        group.append(r)
            out.update({(page, r[1]): seed[1] for r in group})
    return out


@pytest.mark.parametrize("cell", [16_384, 10], ids=["one cell", "many cells"])
def test_group_nearby(spark, cell):
    rng = random.Random(4)
    rows = [(p, i, x, y, x + rng.randint(10, 60), y + rng.randint(8, 20), "t") for p in range(3) for i in range(25) for x, y in [(rng.randint(0, 500), rng.randint(0, 700))]]
    got = {(r.page_id, r.region_id): r.group_no for r in boxes.group_nearby(frame(spark, rows), rows=cell).collect()}
    assert got == grouped(rows)


def test_a_crowded_page_gives_every_pair_once(spark):
    rows = random_boxes(7, pages=1, per_page=120)
    pairs = boxes.near_pairs_of(frame(spark, rows), frame(spark, rows), 15, tile=64)
    got = [(r.a.region_id, r.b.region_id) for r in pairs.select("a", "b").collect()]
    wanted = {(a[1], b[1]) for a in rows for b in rows if a[2] - 15 <= b[4] and b[2] <= a[4] + 15 and a[3] - 15 <= b[5] and b[3] <= a[5] + 15}
    assert len(got) == len(set(got)) and set(got) == wanted


# ---------------------------------------------------------------- names


def named(work, existing):
    taken = {f: {n for g, n in existing if g == f} for f in {w[0] for w in work}}
    out = {}
    for folder, name, idx in sorted(work, key=lambda w: w[2]):
        dot = name.rfind(".")
        stem, suffix = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        k, candidate = 0, name
        while candidate in taken[folder]:
            k += 1
            candidate = f"{stem}_{k}{suffix}"
        taken[folder].add(candidate)
        out[(folder, idx)] = candidate
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    pool = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "a_3.jpg", "b", "b_1", "a_10.jpg", "c.tar.gz", "c.tar_1.gz"]
    work = [(f"/f{rng.randint(0, 1)}", rng.choice(pool), i) for i in range(120)]
    existing = [(f"/f{rng.randint(0, 1)}", rng.choice(pool)) for _ in range(rng.randint(0, 8))]
    got = assign_unique_names(spark.createDataFrame(work, "folder string, name string, idx long"),
                              spark.createDataFrame(existing, "folder string, name string"), rows=7)
    assert {(r.folder, r.idx): r.unique_name for r in got.collect()} == named(work, existing)


@pytest.mark.parametrize("shape", ["slots of one name", "names of names", "far apart"])
def test_long_contests_take_two_tables(spark, monkeypatch, shape):
    """A thousand names that contest each other: the requests are replayed, the number of written tables stays."""
    from pageloom.operators import naming

    rng = random.Random(11)
    if shape == "slots of one name":
        names = ["a.jpg"] * 1200 + [f"a_{k}.jpg" for k in range(1, 1001)]
    elif shape == "names of names":
        names = ["a" + "_1" * k + ".jpg" for k in range(1000)] * 2
    else:
        names = ["a.jpg"] * 3000 + [f"a_{k}.jpg" for k in range(3, 4000, 97)] + [f"a_{k}_1.jpg" for k in range(3, 4000, 97)] * 3
    rng.shuffle(names)
    work = [("/f", n, i) for i, n in enumerate(names)]
    pins, plain = [], naming.pin
    monkeypatch.setattr(naming, "pin", lambda df: pins.append(1) or plain(df))
    there = [("/f", "a_7.jpg"), ("/f", "a_2_1.jpg")]
    got = assign_unique_names(spark.createDataFrame(work, "folder string, name string, idx long"), spark.createDataFrame(there, "folder string, name string"), rows=500)
    assert {(r.folder, r.idx): r.unique_name for r in got.collect()} == named(work, there)
    assert len(pins) == 2


# ---------------------------------------------------------------- terms


def test_a_short_term_does_not_cost_the_long_ones(spark):
    """Rows at the join: places and matches, whatever else begins with the short term."""
    rng = random.Random(3)
    terms = [("天" + "".join(rng.choice("地玄黄宇宙洪荒") for _ in range(rng.randint(3, 6))), f"t{i}", i) for i in range(3000)]
    terms = list({t[0]: t for t in terms}.values())
    texts = ["天" * 300 + rng.choice(terms)[0] for _ in range(5)]
    seg = spark.createDataFrame([(i, s, s) for i, s in enumerate(texts)], "seg_id long, src string, trans string")

    def run(some):
        df = segments.enforce_terms(seg, spark.createDataFrame(some, "zh string, vi string, pos long"), ["seg_id"])
        got = {r.seg_id: r.enforced for r in df.collect()}
        want = {}
        for i, text_ in enumerate(texts):
            out = text_
            for zh, vi, _ in sorted((t for t in some if t[0] in text_), key=lambda t: (-len(t[0]), t[2])):
                out = out.replace(zh, vi) if zh in out and vi.lower() not in out.lower() else out
            want[i] = out
        assert got == want
        plan = df._jdf.queryExecution().executedPlan()
        rows, nodes = 0, [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan]
        while nodes:
            node = nodes.pop()
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                rows = max(rows, node.metrics().apply("numOutputRows").value())
            children = node.children()
            nodes += [children.apply(k) for k in range(children.size())]
            if "QueryStage" in node.nodeName():
                nodes.append(node.plan())
        return rows

    plain = run(terms)
    assert run([*terms, ("天", "trời", 9999)]) <= plain + sum(map(len, texts))


def test_longer_terms_first_and_only_where_left(spark):
    seg = spark.createDataFrame([(1, "青云宗弟子在青云山", "青云宗 ở 青云 sơn"), (2, "李雷", "李雷 Lý Lôi"), (3, "无", "青云")], "seg_id long, src string, trans string")
    terms = spark.createDataFrame([("青云", "Thanh Vân", 1), ("青云宗", "Thanh Vân Tông", 2), ("李雷", "lý lôi", 3)], "zh string, vi string, pos long")
    got = {r.seg_id: r.enforced for r in segments.enforce_terms(seg, terms, ["seg_id"]).collect()}
    # the shorter term's translation is already part of the longer one's
    assert got == {1: "Thanh Vân Tông ở 青云 sơn", 2: "李雷 Lý Lôi", 3: "青云"}


def test_split_sentences_follow_the_rules(spark):
    rows = [(1, 0, "他拿起手中的剑"), (1, 1, "朝我刺来。"), (1, 2, "他们一起放弃挣扎吧"), (1, 3, "然后就结束"), (1, 4, "短句"), (1, 5, "也是一个分段的句子，"), (1, 6, "没有说完")]
    seg = spark.createDataFrame(rows, "page_id long, seg_no long, src string")
    yes = spark.createDataFrame([(1, 5, True)], "page_id long, seg_no long, yes boolean")
    got = {r.seg_no: (r.pair_kind, r.island) for r in segments.sentence_islands(seg, yes).collect()}
    assert [got[i][0] for i in range(7)] == ["forced", None, "ask", "forced", None, "ask", None]
    assert [got[i][1] for i in range(7)] == [1, 1, 2, 3, 3, 4, 4]


def test_continuations(spark):
    rows = [(1, 0, "a", "[cont]"), (1, 1, "b", "Một"), (1, 2, "c", "[cont.] "), (1, 3, "d", "[continued] hai"), (1, 4, "e", ""), (1, 5, "f", "[CONT]")]
    got = segments.continuation_fill(spark.createDataFrame(rows, "page_id long, seg_no long, src string, trans string"))
    assert [(r.filled, r.anchor_no) for r in got.orderBy("seg_no").collect()] == [
        ("‍", None), ("Một", None), ("‍", 1), ("hai", None), ("", None), ("‍", 3)]


def test_plain_borders(spark):
    import numpy as np

    from pageloom.operators.images import trim_box

    rng = np.random.default_rng(1)
    picture = np.full((120, 50, 3), 250, np.uint8)
    picture[10:110, 6:40] = rng.integers(0, 200, (100, 34, 3))
    assert trim_box(picture) == (6, 10, 40, 110)
    picture[4] = 0  # a stray line inside the border is skipped
    assert trim_box(picture) == (6, 10, 40, 110)
    assert trim_box(np.full((40, 40, 3), 7, np.uint8)) is None
    assert trim_box(rng.integers(0, 255, (40, 40, 3)).astype(np.uint8)) is None


def test_row_errors_keep_the_row(spark):
    from pageloom.operators.stages import batch_map, retry_until_valid, row_errors

    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "bad"), (2, 0, "y")], "page_id long, seg_no long, src string")

    def careful(t):
        if t == "bad":
            raise ValueError("no")
        return t * 2

    got = {r.src: (r.result, r.status) for r in row_errors(rows, careful, "src").collect()}
    assert got == {"x": ("xx", "ok"), "bad": ("bad", "failed"), "y": ("yy", "ok")}
    short = batch_map(rows, lambda xs: xs[:1] if len(xs) > 1 else xs, ["page_id"], "seg_no").collect()
    assert {r.status for r in short if r.page_id == 1} == {"kept_original"} and {r.status for r in short if r.page_id == 2} == {"ok"}
    tried = retry_until_valid(rows, lambda xs: [x + "!" if x != "bad" else x for x in xs], ["page_id"], "seg_no", 1, accept=lambda s, r: F.col(r).endswith("!"))
    assert {(r.trans, r.accepted) for r in tried.collect()} == {("x!", True), ("y!", True), ("bad", False)}
