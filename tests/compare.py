"""Run registered queries next to their SQL: ``python tests/compare.py <sf dir> [name part ...]``."""

from __future__ import annotations

import hashlib
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return repr(value) if isinstance(value, (list, tuple, dict)) else str(value)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join("∅" if r[i] is None else plain(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def check(spark, con, sf_dir, name):
    from pageloom.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return f"rows {len(got[1])}", True, ""
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = digest(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return "columns", False, f"{sorted(df.columns)} / {sorted(cols)}"
    if got[0] != want[0]:
        a, b = set(got[1]), set(want[1])
        show = lambda s: [x.replace("\x1f", " | ")[:300] for x in sorted(s)[:3]]
        return "values", False, f"{len(got[1])}/{len(want[1])} rows\n  spark {show(a - b)}\n  duck  {show(b - a)}"
    return f"match {len(got[1])}", True, ""


if __name__ == "__main__":
    from pageloom import build_session
    from pageloom.catalog import ORACLES, QUERIES

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in QUERIES:
        if parts and not any(name.lower().startswith(p.lower()) for p in parts):
            continue
        start = time.time()
        try:
            status, ok, detail = check(spark, con, sf_dir, name)
        except Exception as exc:  # noqa: BLE001
            status, ok, detail = "ERROR", False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {status} {time.time() - start:.1f}s {detail}", flush=True)
    print("failures", bad)
