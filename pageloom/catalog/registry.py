"""Queries by operator name, each with the SQL it must agree with (where SQL can say it)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pageloom.catalog.views import VIEWS
from pageloom.session import ship_package, spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()

#: Tables whose rows are much work each or are many: a few MB on disk are one or two splits, whatever they cost.
SPREAD_TABLES = ("documents", "pages", "conversations", "part", "orders", "lineitem", "events")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Put the fixture views a statement needs in front of it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in wanted:
                need(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} as (\n{VIEWS[n]}\n)" for n in wanted)
    if sql.lstrip().lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{sql.lstrip()[len('with recursive'):]}"
    if sql.lstrip().lower().startswith("with "):
        return f"with {ctes},\n{sql.lstrip()[len('with '):]}"
    return f"with {ctes}\n{sql}"


class Tables:
    """The driver's tables and the fixture views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship_package(spark)
        # the SQL side reads timestamps as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(df) if name in SPREAD_TABLES else df
        if name in VIEWS:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        for name in TABLES:
            if re.search(rf"\b{name}\b", full):
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(full)


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
