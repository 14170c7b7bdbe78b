"""Every text query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import digest, duck  # noqa: E402

from pageloom.llm.catalog import ORACLES, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    cur = duck(SMALL).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[1] == digest(columns, cur.fetchall())[1]


def test_pipeline_runs_over_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert len(corpus_pipeline.STAGES) == 5 and rows
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_stages_keep_the_columns_of_documents(spark, edge_docs):
    import corpus_pipeline

    docs = edge_docs.filter("doc_id is not null")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in docs.collect()}
        assert all(r == rows[r.doc_id] for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
