"""Visit plans of listing pages, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import ColumnLike, chars, col, rstrip, strip
from pageloom.functions.urls import article_page_url, gallery_page_url, sanitize_name, slide_url
from pageloom.operators.extract import article_items, gallery_items, max_page_no, own_page_no
from pageloom.plans.ordered import best_per_group


def shared_prefix(a: Column, b: Column) -> Column:
    """Longest common beginning of two texts."""
    differs = F.array_position(F.zip_with(chars(a), chars(b), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differs > 0, F.left(a, (differs - 1).cast("int"))).otherwise(a)


def common_prefix(title: ColumnLike, cut_at_blank: bool = False) -> Column:
    """Aggregate: common beginning of all titles.

    It is the common beginning of the smallest and the largest title, so two mergeable aggregates do.
    Plain form: right-trimmed. ``cut_at_blank``: only with several titles, cut back to the last blank.
    """
    raw = rstrip(shared_prefix(F.min(col(title)), F.max(col(title))))
    if not cut_at_blank:
        return F.coalesce(raw, F.lit(""))
    at = F.length(raw) - F.length(F.substring_index(raw, " ", -1))
    cut = F.when(raw.contains(" ") & (at > 1), F.left(raw, at)).otherwise(raw)
    return F.coalesce(F.when(F.count(col(title)) > 1, cut), F.lit(""))


def sub_folder(title: ColumnLike, prefix: ColumnLike, fallback: Column | None = None) -> Column:
    """What a title says beyond the common beginning, as a folder name."""
    title, prefix = col(title), col(prefix)
    rest = F.when(prefix != "", strip(F.substring(title, F.length(prefix) + 1, F.length(title)))).otherwise(title)
    name = sanitize_name(rest)
    return F.coalesce(F.nullif(name, F.lit("")), fallback if fallback is not None else title)


def _folders(items: DataFrame, output: str, style: str) -> DataFrame:
    prefixes = items.groupBy("listing_id").agg(common_prefix("title", style == "article").alias("prefix"))
    joined = items.join(prefixes, "listing_id")
    series = F.when(strip("prefix") != "", sanitize_name("prefix"))
    folder = F.concat_ws("/", F.lit(output), series, sub_folder("title", "prefix"))
    return joined.withColumn("folder", folder)


def plan_listing(listings: DataFrame, pages: DataFrame, style: str = "gallery", output: str = "output") -> DataFrame:
    """listings: listing_id, url. pages: url, html. One row per item to visit.

    ``page_no`` and ``ord`` give the visit order: highest page first, each page from its end.
    """
    html = pages.select(F.col("url").alias("page_url"), "html")
    mode = "query" if style == "gallery" else "path"
    first = listings.join(html.withColumnRenamed("page_url", "url"), "url")
    own = own_page_no("url") if style == "gallery" else F.lit(1).cast("bigint")
    sized = first.select("listing_id", "url", own.alias("own_page"), F.greatest(own, max_page_no("html", mode)).alias("last_page"))
    numbered = sized.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "last_page")).alias("page_no"))
    make = gallery_page_url if style == "gallery" else article_page_url
    same = (F.col("page_no") == F.col("own_page")) if style == "gallery" else (F.col("last_page") == 1)
    wanted = numbered.withColumn("page_url", F.when(same, F.col("url")).otherwise(make("url", "page_no")))
    fetched = wanted.join(html, "page_url")
    base = F.col("page_url") if style == "gallery" else F.col("url")
    read = gallery_items("html", base) if style == "gallery" else article_items("html", base)
    items = fetched.select("listing_id", "page_no", F.posexplode(read).alias("ord", "i")).select(
        "listing_id", "page_no", F.col("ord").cast("bigint").alias("ord"), "i.*")
    if style == "article":
        # the visit meets a repeated article first on the highest page, lowest place first from its end
        items = best_per_group(items, ["listing_id", "url"], F.struct(-F.col("page_no"), -F.col("ord")))
    else:
        items = items.withColumn("url", slide_url("url")).filter(F.col("url").isNotNull())
    return _folders(items, output, style)


def visit_order(page_no: ColumnLike = "page_no", ord_col: ColumnLike = "ord") -> list[Column]:
    """Highest page first, each page from its end (ascending sort keys)."""
    return [-col(page_no), -col(ord_col)]
