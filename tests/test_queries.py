"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import check, duck

from pageloom.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_sql(spark, con, name):
    status, ok, detail = check(spark, con, SMALL, name)
    assert ok, f"{status} {detail}"


def test_flagship_query(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and len({(r.folder, r.unique_name) for r in rows}) == len(rows)
