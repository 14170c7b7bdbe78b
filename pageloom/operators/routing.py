"""Which listing plan an address belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.predicates import host_is
from pageloom.functions.text import ColumnLike, col, let
from pageloom.functions.urls import url_part


def route_of(url: ColumnLike) -> Column:
    """article_listing, article, gallery_listing, gallery or generic; the first that fits."""
    path, query = url_part(url, "path"), url_part(url, "query")
    searching = path.startswith("/search/") | F.rtrim(path, F.lit("/")).isin("/search", "/search/index.php")
    listing = query.rlike(r"(?:^|&)s=") | path.startswith("/category/")
    return let(url_part(col(url), "authority"), lambda host: (
        F.when(host_is(host, L.ARTICLE_HOSTS) & listing, "article_listing").when(host_is(host, L.ARTICLE_HOSTS), "article")
        .when(host_is(host, L.GALLERY_HOSTS) & searching, "gallery_listing").when(host_is(host, L.GALLERY_HOSTS), "gallery")
        .otherwise("generic")))


def route_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("route", route_of(url))
