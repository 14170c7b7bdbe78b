"""Work that has to follow the size of a text, a page or a micro-batch: results against loops, and long inputs within seconds."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions import predicates, text
from pageloom.operators import extract
from pageloom.sources import appended, sidecars
from pageloom.streaming import jobs


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").repartition(2)
    return [r.v for r in df.select("i", fn("s").alias("v")).orderBy("i").collect()]


def seconds(spark, value, fn):
    column(spark, ["warm up"], fn)
    start = time.time()
    out = column(spark, [value], fn)[0]
    return time.time() - start, out


def phrase_loop(s, t=5):
    words, size = s.split(), t // 2
    if len(s.strip()) < t:
        return False
    if any(s[i] == s[i + 1] == s[i + 2] == s[i + 3] == s[i + 4] for i in range(len(s) - 4)):
        return True
    if any(len(set(words[i:i + t])) == 1 for i in range(len(words) - t + 1)):
        return True
    return len(words) >= 2 * t and any(
        s.count(p := " ".join(words[i:i + size])) >= 3 and p in " ".join(words[i + size:]) for i in range(len(words) - t + 1))


def test_phrases_inside_longer_words(spark):
    rng = random.Random(9)
    samples = ["xab cdy ab cd ab cdz 1 2 3 4 5", "ab cd xab cdx xab cdx 1 2 3 4", "a b c d e f g h i j", "1 2 3 4 5 6 ab cd xab cd ab cd", "bab ab ab ab c d e f g h i"]
    samples += [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(8, 22))) for _ in range(400)]
    got = column(spark, samples, predicates.is_repetitive)
    assert got == [phrase_loop(s) for s in samples] and {True, False} == set(got)


@pytest.mark.parametrize("threshold", [3, 4, 7])
def test_phrases_of_other_sizes(spark, threshold):
    rng = random.Random(threshold)
    samples = [" ".join(rng.choice(["ab", "xab", "cd", "cdy", "e", "f", "gh"]) for _ in range(rng.randint(6, 30))) for _ in range(150)]

    def loop(s):
        words, size = s.split(), threshold // 2
        if any(s[i:i + threshold] == s[i] * threshold for i in range(len(s) - threshold + 1)) or any(
                len(set(words[i:i + threshold])) == 1 for i in range(len(words) - threshold + 1)):
            return True
        return len(words) >= 2 * threshold and any(
            s.count(p := " ".join(words[i:i + size])) >= 3 and p in " ".join(words[i + size:]) for i in range(len(words) - threshold + 1))

    assert column(spark, samples, lambda s: predicates.is_repetitive(s, threshold)) == [loop(s) for s in samples]


def test_units_against_loops(spark):
    rng = random.Random(8)
    samples = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(800)] + ["aabaaabaa", "😀a😀a😀", "é"]

    def unit(s):
        return next((s[:p] for p in range(1, len(s) // 2 + 1) if s[p:] == s[:-p]), s)

    assert column(spark, samples, text.repeat_unit) == [unit(s) for s in samples]


def test_running_sums(spark):
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 63, 64, 65, 300):
        values = [rng.randint(-1, 1) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        want = [sum(values[:i + 1]) for i in range(n)]
        assert df.select(text.running_sums(F.col("v"), 4).alias("s")).first().s == want


def test_glued_lines_against_loops(spark):
    rng = random.Random(3)
    pool = ["", "a", "bb", "ccc", "end.", "x-", " y ", "z  ", "long line here", "?"]
    samples = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def glued(s):
        s = s.strip()
        lines = [x.rstrip() for x in s.splitlines()]
        if len(lines) < 2:
            return s
        done = []
        for line in lines:
            short = line.strip()
            if done and short and len(short) <= 2 and not (done[-1] and done[-1][-1] in "!?.,:;-"):
                done[-1] += short
            else:
                done.append(line)
        return "\n".join(done)

    got = column(spark, samples, text.normalize_newlines)
    assert got == [glued(s) for s in column(spark, samples, text.strip_artifacts)]


def test_long_texts_take_seconds(spark):
    rng = random.Random(4)
    took, out = seconds(spark, " ".join("w" + "q".join(f"{i:06d}") + "z" for i in range(200_000)), predicates.is_repetitive)
    assert took < 12 and out is False
    took, _ = seconds(spark, "".join(rng.choice("()[]「」a") for _ in range(100_000)), text.repair_brackets)
    assert took < 10
    took, out = seconds(spark, "ab" * 500_000, text.repeat_unit)
    assert took < 4 and out == "ab"
    took, _ = seconds(spark, "\n".join(rng.choice(["a", "bb", "ccc."]) for _ in range(200_000)), text.normalize_newlines)
    assert took < 8


def test_gallery_links_against_loops(spark):
    rng = random.Random(5)
    pages = []
    for p in range(30):
        links = [(rng.randint(1, 4), "".join(rng.choice("ab/: ") for _ in range(rng.randint(0, 6))).strip()) for _ in range(rng.randint(0, 12))]
        pages.append((p, "https://h.x/", "".join(f'<a href="/photos-index-aid-{i}.html?{k}">{t}</a>' for k, (i, t) in enumerate(links)), links))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id int, url string, html string")
    got = {r.page_id: [(i.item_id, i.url.rsplit("?", 1)[1]) for i in r.g] for r in df.select("page_id", extract.gallery_items("html", "url").alias("g")).collect()}
    from pageloom.functions.urls import sanitize_name
    clean = {r.s: r.v for r in spark.createDataFrame([(t,) for t in {t for p in pages for _, t in p[3]} | {""}], "s string").select("s", sanitize_name("s").alias("v")).collect()}
    for p, _, _, links in pages:
        best = {}
        for k, (i, t) in enumerate(links):
            title = clean[t] if t else f"gallery_{i}"
            if i not in best or len(t) > len(best[i][0]):
                best[i] = (title, k)
        assert got[p] == [(str(i), str(k)) for i, (_, k) in best.items()]


# ---------------------------------------------------------------- tables that are only added to


def size_of(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_batches_are_replaced_when_replayed_and_merged_when_read(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda rows, n: appended.add_batch(spark.createDataFrame(rows, "k long, v string"), path, n)
    put([(1, "a"), (2, "b")], 0)
    put([(1, "x")], 1)
    put([(1, "c"), (3, "d")], 1)
    rows = appended.batches(spark, path, "k long, v string")
    assert {tuple(r) for r in appended.latest(rows, "k").collect()} == {(1, "c"), (2, "b"), (3, "d")}
    assert {tuple(r) for r in appended.latest(rows, "k", first=True).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert appended.batches(spark, path, "k long, v string", before=1).count() == 2 and appended.next_batch(spark, path) == 2
    assert appended.batches(spark, str(tmp_path / "none"), "k long, v string").count() == 0


def test_what_a_micro_batch_writes_follows_its_rows(spark, tmp_path):
    """Cache and progress: ten equal micro-batches, the last no larger than the first."""
    cache, out = str(tmp_path / "cache"), []
    sink = jobs.cached_translate_sink(cache, lambda xs: [x[::-1] for x in xs], lambda df, n: out.extend(df.collect()), "m", "zh")
    runs = jobs.progress_sink(str(tmp_path / "runs"))
    for n in range(10):
        sink(spark.createDataFrame([(i, f"batch {n} text {i}") for i in range(50)] + [(99, "batch 0 text 7")], "seg_id long, src string"), n)
        runs(spark.createDataFrame([(1, n, 0, 0, n)], "run_id bigint, entries bigint, success bigint, failed bigint, done bigint"), n)
    sizes = [size_of(f"{cache}/batch={n}") for n in range(10)]
    assert max(sizes[1:]) < 1.2 * sizes[0]
    assert jobs.latest_progress(spark, str(tmp_path / "runs")).collect()[0].entries == 9
    assert all(r.translation == r.src[::-1] for r in out) and sum(r.hit for r in out) == 9
    # a micro-batch that is run again does not see its own entries as hits
    out.clear()
    sink(spark.createDataFrame([(1, "batch 9 text 1")], "seg_id long, src string"), 9)
    assert [(r.translation, r.hit) for r in out] == [("1 txet 9 hctab", False)]


def test_sidecars_of_many_images_lie_in_few_files(spark, tmp_path):
    path = str(tmp_path / "boxes")
    region = "struct(0.1d as x, 0.1d as y, 0.2d as w, 0.2d as h)"
    typed = f"from_json(to_json(array({region})), 'array<{sidecars.REGION_TYPE}>') as regions"
    make = lambda n, mode: spark.range(n).selectExpr("concat('img', id, '.png') as image", f"'{mode}' as mode", "3 as mask_dilate", typed)
    sidecars.write_sidecars(make(2000, "merge"), path)
    assert len(list(Path(path).rglob("*.parquet"))) <= 16
    sidecars.write_sidecars(make(3, "replace"), path)
    got = {r.image: r.mode for r in sidecars.read_sidecar_table(spark, path).collect()}
    assert len(got) == 2000 and {i for i, m in got.items() if m == "replace"} == {"img0.png", "img1.png", "img2.png"}
    one = sidecars.read_sidecar_table(spark, path, images=["img7.png"])
    assert [r.image for r in one.collect()] == ["img7.png"]
    assert "PushedFilters" in one._jdf.queryExecution().toString() and "img7.png" in one._jdf.queryExecution().toString()
    sidecars.export_sidecars(spark, path, str(tmp_path / "single"), ["img1.png", "img5.png"])
    assert sorted(f.name for f in (tmp_path / "single").iterdir() if f.is_dir()) == ["image=img1.png", "image=img5.png"]


def test_learning_releases_whole_rounds(spark, tmp_path):
    """Pages that go over several micro-batches, a series that ends early, and what still waits, in any cut of the input."""
    rows = [(s, p, p * 10 + k, f"s{s}p{p}k{k}", "v") for s in (1, 2) for p in range(7 if s == 1 else 2) for k in range(3)]
    rows.sort(key=lambda r: r[2])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for cut in (5, 13):
        folder = tmp_path / f"in{cut}"
        for i in range(0, len(rows), cut):
            spark.createDataFrame(rows[i:i + cut], "series_id long, page_id long, seg_id long, src string, trans string").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("series_id long, page_id long, seg_id long, src string, trans string").option("maxFilesPerTrigger", 1).parquet(str(folder))
        got, point = [], str(tmp_path / f"at{cut}")
        query = jobs.stream_learning_batches(stream, 3).writeStream.outputMode("append").option("checkpointLocation", point).foreachBatch(
            lambda df, n: got.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted((r.series_id, r.round, r.seg_id) for r in got) == sorted((s, p // 3, seg) for s, p, seg, *_ in rows if s == 1 and p < 6)
        rest = jobs.still_waiting(spark, point).collect()
        assert sorted((r.series_id, r.seg_id) for r in rest) == sorted((s, seg) for s, p, seg, *_ in rows if s == 2 or p == 6)


def test_character_class_is_the_set(spark):
    chars = L.VIETNAMESE_MARKS + L.VIETNAMESE_MARKS.upper()
    every = [chr(c) for c in range(32, 0x2000)]
    hits = column(spark, every, lambda s: F.col(s).rlike(L.VIETNAMESE_MARK))
    assert {c for c, hit in zip(every, hits) if hit} == set(chars)


def test_texts_without_leftovers_are_not_searched_for_each(spark):
    body = "\n".join(f"the plain line number {i} of a long text" for i in range(300_000))
    steps = [(L.ARTIFACT_THOUGHT["chat"], ""), *L.ARTIFACT_STEPS, (L.ARTIFACT_MARKER, ""), (r"\|", "")]
    passes, _ = seconds(spark, body, lambda s: F.length(text.resub(s, steps)))
    took, again = seconds(spark, body, predicates.needs_retry)
    assert again and took < 2.5 * passes, (took, passes)


def test_run_of_blanks_before_a_line_end(spark):
    took, out = seconds(spark, "a" + " " * 200_000 + "x \t \ny", lambda s: F.regexp_replace(text.strip_artifacts(s), " +", " "))
    assert out == "a x\ny" and took < 10, took


@pytest.mark.parametrize("variant", ["chat", "translate", "common"])
def test_retry_by_lines_is_retry_of_the_cleaned_text(spark, variant):
    rng = random.Random(3)
    parts = ["the", "cat", "ab", "www.x.com", "a c g", "你好", "な", "ế", "é", "\n", "\n", "\r\n", " \n", " ", " ", "<think>", "</think>", "</", "<|1|>", "|", "[INST]", "x"]
    samples = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 4, 8, 20]))) for _ in range(1500)]
    foreign = L.HAN if variant == "chat" else L.JAPANESE

    def plain(s):
        cleaned = text.clean_watermark_lines(text.strip_artifacts(s, variant), variant=variant)
        return text.let(cleaned, lambda c: F.when(F.length(text.strip(c)) < 4, False).when(c.rlike(foreign), True).when(
            c.rlike(L.VIETNAMESE_MARK), False).otherwise(c.rlike(L.TWO_ENGLISH_WORDS)))

    got = column(spark, samples, lambda s: predicates.needs_retry(s, variant))
    assert got == column(spark, samples, plain) and {True, False} == set(got)
