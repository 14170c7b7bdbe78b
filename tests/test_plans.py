"""What the plans must and must not contain."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pageloom.catalog.registry import Tables
from pageloom.operators import boxes, extract
from pageloom.plans import downloads

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the driver's tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_has_no_shuffle_of_its_own(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert "Exchange" not in plan(extract.extract_media_urls(pages))


def test_pair_search_is_an_equality_join(spark):
    text = plan(boxes.overlap_pairs(Tables(spark, SMALL).fx_box))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_attempts_are_combined_before_the_shuffle(spark):
    text = plan(downloads.resolve_attempts(Tables(spark, SMALL).fx_att))
    assert "partial_min_by" in text and "partial_max_by" in text


def test_only_needed_columns_are_read(spark):
    pages = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.col("lang") == "fr").select("doc_id")
    text = plan(pages)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text and "EqualTo(lang,fr)" in text


@pytest.mark.parametrize("word", ["localCheckpoint", "crossJoin", ".toPandas(", ".rdd.map"])
def test_words_the_library_does_not_use(word):
    root = Path(__file__).resolve().parents[1] / "pageloom"
    assert not [p for p in root.rglob("*.py") if word in p.read_text(encoding="utf-8")]
