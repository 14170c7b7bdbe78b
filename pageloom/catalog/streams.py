"""Streaming and image jobs over data that Spark derives from the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pageloom.catalog import sql_parts as S
from pageloom.catalog import flow  # noqa: F401  registers the page context first
from pageloom.catalog.registry import ORACLES, query
from pageloom.catalog.sql_parts import trim
from pageloom.catalog.term_store import flat, mutated_by, now, store
from pageloom.functions import lexicon as L
from pageloom.operators import images, journal
from pageloom.plans.ordered import best_per_group
from pageloom.session import pin
from pageloom.sources import snapshots
from pageloom.streaming import jobs

big = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


#: Rows of a file and of a micro-batch.
FILE_ROWS, BATCH_ROWS = 100_000, 2_000_000


def staged(df, name: str, order: str, parts: int = 2):
    """Write a table in ``order`` as successive sets of files and read it back as a stream, one set per micro-batch. ``parts`` sets
    at least; beyond that their number, and that of their files, follows the rows."""
    spark = df.sparkSession
    path = snapshots.scratch_path(spark, name)
    rows = df.count()
    parts = max(parts, math.ceil(rows / BATCH_ROWS))
    files = max(1, math.ceil(rows / parts / FILE_ROWS))
    laid = pin(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    for part in range(parts):
        # the file source takes files by age; the rows of a part are dealt out evenly, so that each of its tasks writes a file
        laid.filter(F.col("_part") == part).drop("_part").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def run(writer, spark):
    """Run a stream over what is there and stop."""
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()


def _table(spark, name: str):
    return snapshots.scratch_path(spark, name), snapshots.scratch_path(spark, f"{name}-offsets")


@query("st2_stream_progress", """select run_id, count(*)::bigint as entries, count(*) filter (type = 'done')::bigint as success, count(*) filter (type = 'error')::bigint as failed,
  sum(case when type = 'progress' then amount else 0 end)::bigint as done from fx_ev group by 1""")
def st2(t):
    path, offsets = _table(t.spark, "progress")
    source = staged(t.fx_ev.select("run_id", "seq", "type", "amount"), "ev", "seq")
    run(jobs.stream_progress(source).writeStream.outputMode("update").option("checkpointLocation", offsets).foreachBatch(jobs.progress_sink(path)), t.spark)
    return jobs.latest_progress(t.spark, path)


@query("st3_stream_distinct_urls", "select distinct url from fx_att")
def st3(t):
    path, offsets = _table(t.spark, "seen")
    source = staged(t.fx_att.select("url", "idx"), "att", "idx")
    run(jobs.stream_distinct(source, ["url"]).writeStream.format("parquet").option("path", path).option("checkpointLocation", offsets), t.spark)
    return t.spark.read.parquet(path).select("url")


@query("st4_stream_journal", """select run_id, seq, total, place from (select run_id, seq, count(*) over (partition by run_id) as total, (row_number() over (partition by run_id order by seq) - 1)::bigint as place from fx_ev)
  where place >= total - 25""")
def st4(t):
    path, offsets = _table(t.spark, "log")
    source = staged(t.fx_ev.select("run_id", "seq", "type", "state"), "entries", "seq")
    run(jobs.stream_journal(source, path, offsets), t.spark)
    log = t.spark.read.schema("seq bigint, type string, state string, run_id bigint").parquet(path)
    return journal.journal_tail(log, 0, 25).select("run_id", "seq", "total", "place")


@query("st5_stream_recent_context", f"""
with w6 as ({ORACLES["w6_page_context"]})
select c.series_id, c.seg_id, coalesce(len(r), 0)::bigint as n, coalesce(array_to_string(r, chr(10)), '') as recent, w6.context as pages from (select series_id, page_id, seg_id,
  (list({trim('src')} || ' => ' || {trim('trans')}) filter ({trim('src')} <> '' and {trim('trans')} <> '') over (partition by series_id order by seg_id rows between unbounded preceding and 1 preceding))[-12:] as r from fx_ctx) c
join w6 on c.series_id = w6.series_id and c.page_id = w6.page_id""")
def st5(t):
    path, offsets = _table(t.spark, "context")
    _rocksdb(t.spark)
    source = staged(t.fx_ctx.select("series_id", "page_id", "seg_id", "src", "trans"), "ctx", "seg_id")
    run(jobs.stream_recent_context(source).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", offsets), t.spark)
    return t.spark.read.parquet(path)


def _rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _extract(chosen):
    """Stand-in for the outside extraction: the source is the term."""
    return chosen.select(F.col("seg_id").alias("pos"), F.col("src").alias("zh"), F.col("trans").alias("vi"),
                         F.concat(F.lit("series "), F.col("series_id").cast("string")).alias("source"))


#: Rounds of four pages, in each the pairs that fit the budget.
_LEARNED = f"""select seg_id as pos, {trim('src')} as zh, {trim('trans')} as vi, false as enabled, 'series ' || series_id::varchar as source from (
  select *, row_number() over w as rn, sum(length(src) + length(trans) + {L.LEARN_PAIR_OVERHEAD}) over w as s from (
    select series_id, round, src, arg_min(trans, seg_id) as trans, min(seg_id) as seg_id from (
      select *, (dense_rank() over (partition by series_id order by page_id) - 1) // 4 as round from fx_seg)
    where src <> '' and trans <> '' group by all) window w as (partition by series_id, round order by length(src), seg_id))
where rn <= {L.LEARN_MAX_PAIRS} and s <= {L.LEARN_MAX_CHARS} and {trim('src')} <> '' and {trim('trans')} <> ''"""


@query("st1_stream_learn_terms", "with learned as (" + _LEARNED + "), " + mutated_by("learned"))
def st1(t):
    root = snapshots.scratch_path(t.spark, "learn")
    _rocksdb(t.spark)
    source = staged(t.fx_seg.select("series_id", "page_id", "seg_id", "src", "trans"), "segs", "seg_id")
    released = jobs.stream_learning_batches(source, every=4)
    run(released.writeStream.outputMode("append").option("checkpointLocation", f"{root}/offsets").foreachBatch(jobs.learn_sink(f"{root}/learned", _extract)), t.spark)
    jobs.learn_rest(t.spark, f"{root}/offsets", f"{root}/learned", _extract)
    return flat(jobs.learned_terms(store(t), f"{root}/learned", now()))


@query("st6_stream_live_terms")
def st6(t):
    root = snapshots.scratch_path(t.spark, "live")
    short = store(t).withColumn("zh", F.regexp_replace("zh", "^宗| \\d+$", ""))
    snapshots.write_snapshot(best_per_group(short, ["zh"], F.col("term_id")), f"{root}/terms")
    own = t.sql("select split_part(p_name, ' ', 1) as zh, min(p_type) as vi, min(p_partkey) as pos from part group by 1")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    source = staged(t.fx_seg.select("series_id", "page_id", "seg_id", "src", "trans"), "segs", "seg_id", 2)
    run(source.writeStream.option("checkpointLocation", f"{root}/offsets").foreachBatch(jobs.live_terms_sink(root, own, write)), t.spark)
    return t.spark.read.parquet(f"{root}/out").select("series_id", "seg_id", "enforced")


@query("st7_stream_cached_translate", "select page_id, seg_no, reverse(src) as translation from (select page_id, seg_no, trans as src from fx_conv)")
def st7(t):
    root = snapshots.scratch_path(t.spark, "cached")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    sink = jobs.cached_translate_sink(f"{root}/cache", lambda xs: [x[::-1] for x in xs], write, "m", "zh")
    rows = t.fx_conv.select("page_id", "seg_no", F.col("trans").alias("src"))
    run(staged(rows, "conv", "page_id", 2).writeStream.option("checkpointLocation", f"{root}/offsets").foreachBatch(sink), t.spark)
    return t.spark.read.parquet(f"{root}/out").select("page_id", "seg_no", "translation")


# ---------------------------------------------------------------- images made from pages


def _pictures(t):
    """One picture per page in the image source's shape: a plain border around noise that follows the page."""
    size = F.struct(F.lit(48).alias("h"), (F.lit(40) + F.col("page_id") % 16).cast("int").alias("w"), (F.col("page_id") % 11).cast("int").alias("b"))
    rows = t.pages.select("page_id", "url", size.alias("s")).select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("origin"), "s.*")
    inside = lambda x, y: (x >= F.col("b")) & (x < F.col("w") - F.col("b")) & (y >= F.col("b")) & (y < F.col("h") - F.col("b"))
    pixel = lambda x, y: F.when(inside(x, y), F.lpad(F.hex((x * 37 + y * 101 + F.col("page_id") * 13) % 180), 2, "0")).otherwise("FA")
    dot = lambda i: F.repeat(pixel(i % F.col("w"), F.floor(i / F.col("w"))), F.lit(3))
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), dot), ""))
    return rows.select("page_id", "origin", F.col("h").alias("height"), F.col("w").alias("width"), F.lit(3).alias("nChannels"), data.alias("data"), F.lit(True).alias("readable"))


@query("i1_autotrim_boxes", """select page_id, case when b > 0 then b end as x1, case when b > 0 then b end as y1, case when b > 0 then w - b end as x2, case when b > 0 then 48 - b end as y2
  from (select page_id, (40 + page_id % 16)::int as w, (page_id % 11)::int as b from pages)""")
def i1(t):
    made = _pictures(t)
    boxes = images.autotrim_boxes(made.drop("page_id"))
    return made.select("page_id", "origin").join(boxes, "origin").select("page_id", "box.*")


@query("i2_crop_images", """select page_id, case when b > 0 then 'cropped' else 'copied' end as status, w - 2 * b as width, 48 - 2 * b as height
  from (select page_id, (40 + page_id % 16)::int as w, (page_id % 11)::int as b from pages)""")
def i2(t):
    made = _pictures(t)
    done = images.crop_images(made.drop("page_id"), images.autotrim_boxes(made.drop("page_id")))
    return made.select("page_id", "origin").join(done, "origin").select("page_id", "status", "width", "height")


@query("i3_duplicate_images", """select md5(text)[:8] as short, sha256(text) as digest, count(*)::bigint as files, min('doc/' || doc_id::varchar) as first_path from documents group by 1, 2""")
def i3(t):
    made = t.documents.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    return images.duplicate_images(made)


@query("s3_read_image_pixels")
def s3(t):
    """Picture files written by tasks, then read by Spark's image source; one of them is broken on purpose."""
    from pageloom.sources.pictures import write_png_files

    path = snapshots.scratch_path(t.spark, "pictures")
    write_png_files(_pictures(t), path, F.col("page_id") % 10 == 3)
    read = images.read_images(t.spark, path)
    return read.select(F.regexp_extract("origin", r"(\d+)\.png$", 1).cast("bigint").alias("page_id"), "readable", "width", "height", big(F.length("data")).alias("size"))
