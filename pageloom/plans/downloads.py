"""What to download, under which name, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.predicates import http_outcome
from pageloom.functions.times import backoff_seconds
from pageloom.functions.urls import url_filename
from pageloom.operators.extract import extract_media_urls
from pageloom.operators.naming import assign_unique_names
from pageloom.session import pin


def pending_downloads(work: DataFrame, existing: DataFrame) -> DataFrame:
    """Work whose file is not there yet; an empty file counts as missing."""
    there = existing.filter(F.col("length") > 0).select("folder", "name")
    return work.join(there, ["folder", "name"], "left_anti")


def plan_downloads(pages: DataFrame, existing: DataFrame, folder: Column, scripts: DataFrame | None = None) -> DataFrame:
    """folder, page_id, idx, total, url, name, unique_name for every file still to fetch."""
    media = extract_media_urls(pages.withColumn("folder", folder), scripts, keep=["folder"])
    work = media.select("folder", "page_id", F.col("ord").alias("idx"), "total", "url", url_filename("url", "ord").alias("name"))
    # naming reads its work several times; the pages must not be parsed again each time
    return assign_unique_names(pin(pending_downloads(work, existing)), existing)


def resolve_attempts(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Final outcome per (run, url): the first success, skip or permanent failure, else the last allowed try.

    Two keyed aggregates in one pass, combined before the shuffle.
    """
    judged = attempts.filter(F.col("attempt_no") <= max_retries).withColumn("_what", http_outcome("http_status", "content_type", "url"))
    # network failures have no status; what they said is carried along
    said = F.col("error") if "error" in attempts.columns else F.lit(None).cast("string")
    row = F.struct("idx", "folder", "referer", "attempt_no", "http_status", "_what", said.alias("_said"))
    ends = F.when(F.col("_what") != "retryable", F.col("attempt_no"))
    best = judged.groupBy("run_id", "url").agg(
        F.min_by(row, ends).alias("ended"), F.max_by(row, "attempt_no").alias("latest"), F.min(ends).alias("_at"))
    final = best.select("run_id", "url", F.when(F.col("_at").isNotNull(), F.col("ended")).otherwise(F.col("latest")).alias("r"))
    what = F.col("r._what")
    spent = (what == "retryable") & (F.col("r.attempt_no") >= max_retries)
    return final.select(
        "run_id", "url", "r.idx", "r.folder", "r.referer", (F.col("r.attempt_no") + 1).cast("bigint").alias("tries"),
        F.when(what.isin("success", "skipped"), what).when(spent | (what == "permanent"), "failed").otherwise("retrying").alias("outcome"),
        F.when(~what.isin("success", "skipped"), F.coalesce(F.concat(F.lit("HTTP "), F.col("r.http_status").cast("string")), F.col("r._said"))).alias("error"),
        F.when((what == "retryable") & ~spent, backoff_seconds(F.col("r.attempt_no") + 1)).alias("next_wait"))


def download_summary(resolved: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col("outcome") == name)
    done = count("success") + count("failed") + count("skipped")
    return resolved.groupBy("run_id").agg(count("success").alias("success"), count("failed").alias("failed"),
                                          count("skipped").alias("skipped"), done.alias("done"))


def retry_items(failed: DataFrame, default_folder: str, default_referer: str) -> DataFrame:
    """Failed rows with their target filled in."""
    filled = lambda name, default: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))
    return failed.withColumns({"folder": filled("folder", default_folder), "referer": filled("referer", default_referer)})


def retry_groups(failed: DataFrame, default_folder: str, default_referer: str) -> DataFrame:
    """Groups that share folder and referer, ordered by ``first_idx``; the rows stay in ``retry_items``."""
    items = retry_items(failed, default_folder, default_referer)
    return items.groupBy("run_id", "folder", "referer").agg(F.count(F.lit(1)).alias("items"), F.min("idx").alias("first_idx"))


def next_retry_batch(attempts: DataFrame, max_retries: int, default_folder: str, default_referer: str) -> DataFrame:
    """Input of the next run: what failed in the last one, with the target filled in."""
    failed = resolve_attempts(attempts, max_retries).filter(F.col("outcome") == "failed")
    return retry_items(failed, default_folder, default_referer).select("run_id", "url", "idx", "folder", "referer")
