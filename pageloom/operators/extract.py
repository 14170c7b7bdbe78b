"""Media addresses and listing items of web pages.

A page is read within its row: the scan feeds projections and one generate, there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import html as H
from pageloom.functions import lexicon as L
from pageloom.functions.parsing import script_url_lists, srcset_urls
from pageloom.functions.text import ColumnLike, col, let, strip
from pageloom.functions.urls import is_image_url, resolve_url, sanitize_name, url_part


_CANDIDATES = "array<struct<raw string, origin string, ready boolean, typed boolean>>"


def _candidate(raw: Column, origin: str, ready: Column | bool = False, typed: Column | bool = False) -> Column:
    flag = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(raw.alias("raw"), F.lit(origin).alias("origin"), flag(ready).alias("ready"), flag(typed).alias("typed"))


def _tag_candidates(tags: Column) -> Column:
    """Source attributes of all tags, then their srcset lists."""
    read = F.transform(tags, H.attributes)

    def sources(attrs: Column) -> Column:
        typed = F.coalesce(H.attribute(attrs, "type"), F.lit("")).contains("image")
        names = F.array(*[F.lit(n) for n in L.SOURCE_ATTRIBUTES])
        return F.transform(names, lambda n: _candidate(strip(F.coalesce(H.attribute(attrs, n), F.lit(""))), "attribute", typed=typed))

    def sets(attrs: Column) -> Column:
        return F.transform(srcset_urls(F.coalesce(H.attribute(attrs, "srcset"), F.lit(""))), lambda r: _candidate(r, "srcset"))

    return let(read, lambda tags_read: F.concat(F.flatten(F.transform(tags_read, sources)), F.flatten(F.transform(tags_read, sets))))


def _script_candidates(items: Column, origin: str) -> Column:
    return F.transform(items, lambda i: _candidate(i["raw"], origin, i["ready"]))


def first_of(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order: sorted by key and place the first of each key stays, then places order what is left."""

    def first(seen: Column) -> Column:
        ranked = F.array_sort(F.transform(seen, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
        fresh = let(ranked, lambda r: F.filter(r, lambda e, n: (n == 0) | ~F.get(r, n - 1)["k"].eqNullSafe(e["k"])))
        return F.transform(F.array_sort(F.transform(fresh, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])

    return let(items, first)


def media_array(html: ColumnLike, base: ColumnLike, external: Column | None = None) -> Column:
    """Distinct (url, origin) of a page in the order of first sight: attributes, srcset, inline scripts, script files."""
    found = [_tag_candidates(H.tags(H.markup(html), "img", "source")), _script_candidates(F.flatten(F.transform(H.inline_scripts(html), script_url_lists)), "inline")]
    if external is not None:
        found.append(_script_candidates(external, "script"))
    usable = F.filter(F.concat(*[f.cast(_CANDIDATES) for f in found]), lambda c: (c["raw"] != "") & (c["ready"] | ~c["raw"].startswith("data:")))
    full = F.transform(usable, lambda c: F.struct(
        F.when(c["ready"], c["raw"]).otherwise(resolve_url(base, c["raw"])).alias("url"), c["origin"].alias("origin"),
        (c["ready"] | c["typed"]).alias("sure")))

    return first_of(F.filter(full, lambda f: f["sure"] | is_image_url(f["url"])), lambda f: f["url"])


def external_scripts(pages: DataFrame) -> DataFrame:
    """Addresses of script files on the page's own host: page_id, ord, script_url."""
    sources = F.transform(H.tags("html", "script"), lambda t: strip(F.coalesce(H.attribute_of(t, "src"), F.lit(""))))
    listed = pages.select("page_id", "url", F.posexplode(F.filter(sources, lambda s: s != "")).alias("ord", "raw"))
    full = listed.withColumn("script_url", resolve_url("url", "raw"))
    same_host = url_part("script_url", "authority") == url_part("url", "authority")
    return full.filter(same_host).select("page_id", "ord", "script_url")


def extract_media_urls(pages: DataFrame, scripts: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """page_id, ord (from 1), total, url, origin and the ``keep`` columns of the page.

    ``scripts`` (script_url, text) stands for fetched script files.
    """
    source, external = pages, None
    if scripts is not None:
        # a script is read once, however many pages name it; only its short list of addresses meets the pages
        lists = scripts.select("script_url", script_url_lists("text").alias("items")).filter(F.size("items") > 0)
        found = external_scripts(pages).join(lists, "script_url").groupBy("page_id").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "items"))), lambda s: s["items"])).alias("_items"))
        source = pages.join(found, "page_id", "left")
        external = F.coalesce("_items", F.array().cast("array<struct<raw:string,ready:boolean>>"))
    numbered = let(media_array("html", "url", external), lambda found: F.transform(found, lambda m, i: F.struct(
        (i + 1).cast("bigint").alias("ord"), F.size(found).cast("bigint").alias("total"), m["url"].alias("url"), m["origin"].alias("origin"))))
    return source.select("page_id", *keep, F.explode(numbered).alias("m")).select("page_id", *keep, "m.*")


def register_media_view(spark: SparkSession, pages: str, view: str = "explode_media") -> None:
    """For SQL users: a view page_id, ord, total, url, origin over a table or view of pages (page_id, url, html)."""
    extract_media_urls(spark.table(pages)).createOrReplaceTempView(view)


def article_media(pages: DataFrame) -> DataFrame:
    """page_id, title, ord, url of an article page: its own section, else the whole page."""
    heading = H.inner_text(F.coalesce(F.get(H.blocks("html", "h1", "post-title"), F.lit(0)), F.lit("")))

    def urls(m: Column) -> Column:
        section = F.coalesce(F.get(H.blocks(m, "article", "post-content"), F.lit(0)), m)
        raw = F.transform(H.tags(section, "img"), lambda t: let(H.attributes(t), lambda a: strip(F.coalesce(
            F.nullif(H.attribute(a, "data-src"), F.lit("")), H.attribute(a, "src"), F.lit("")))))
        full = F.transform(F.filter(raw, lambda r: (r != "") & ~r.startswith("data:")), lambda r: resolve_url("url", r))
        return F.array_distinct(F.filter(full, is_image_url))

    read = pages.select("page_id", heading.alias("title"), F.posexplode(let(H.markup("html"), urls)).alias("i", "url"))
    return read.select("page_id", "title", (F.col("i") + 1).cast("bigint").alias("ord"), "url")


def article_items(html: ColumnLike, base: ColumnLike) -> Column:
    """Distinct (item_id, title, url) of a listing page of articles, in page order."""
    heads = F.flatten(F.transform(H.blocks(H.markup(html), "article", "post-item"), lambda a: H.blocks(a, "h2", "entry-title")))
    links = F.transform(F.flatten(F.transform(heads, H.anchors)), lambda a: let(resolve_url(base, a["href"]), lambda u: F.struct(
        u.alias("item_id"),
        F.coalesce(F.nullif(strip(F.coalesce(a["title"], F.lit(""))), F.lit("")), F.nullif(a["text"], F.lit("")), u).alias("title"),
        u.alias("url"))))
    return first_of(links, lambda x: x["url"])


def gallery_items(html: ColumnLike, base: ColumnLike) -> Column:
    """Best (item_id, title, url) per gallery of a listing page, in order of first sight.

    A later link replaces an earlier one when its text is longer than the stored title
    (a made-up title counts with its own length).
    """
    pattern = r"/photos-index-aid-(\d+)\.html"
    links = F.transform(
        F.filter(H.anchors(H.markup(html)), lambda a: a["href"].rlike(pattern)),
        lambda a: F.struct(F.regexp_extract(a["href"], pattern, 1).alias("id"), a["text"].alias("text"), a["href"].alias("href")))

    title = lambda f: F.when(f["text"] != "", sanitize_name(f["text"])).otherwise(F.concat(F.lit("gallery_"), f["id"]))
    keep = lambda f: F.struct(title(f).alias("title"), f["href"].alias("href"))

    def best(sorted_links: Column) -> Column:
        # links of one gallery stand together; each run is folded once
        begins = F.filter(F.transform(sorted_links, lambda f, n: F.when((n == 0) | (F.get(sorted_links, n - 1)["id"] != f["id"]), n + 1)), lambda n: n.isNotNull())

        def fold(run: Column) -> Column:
            won = F.aggregate(run, keep(F.get(run, F.lit(0))), lambda acc, f: F.when(F.length(f["text"]) > F.length(acc["title"]), keep(f)).otherwise(acc))
            return let(won, lambda w: F.struct(F.get(run, F.lit(0))["i"].alias("i"), F.get(run, F.lit(0))["id"].alias("item_id"), w["title"].alias("title"),
                                               resolve_url(base, w["href"]).alias("url")))

        runs = let(begins, lambda bs: F.transform(bs, lambda b, k: F.slice(sorted_links, b, F.coalesce(F.get(bs, k + 1), F.size(sorted_links) + 1) - b)))
        return F.transform(F.array_sort(F.transform(runs, fold)), lambda g: F.struct(g["item_id"].alias("item_id"), g["title"].alias("title"), g["url"].alias("url")))

    placed = F.transform(links, lambda f, i: F.struct(f["id"].alias("id"), i.alias("i"), f["text"].alias("text"), f["href"].alias("href")))
    return let(F.array_sort(placed), lambda r: best(r))


def max_page_no(html: ColumnLike, style: str = "query") -> Column:
    """Highest page number among the links, at least 1."""
    pattern = r"[?&]p=(\d+)" if style == "query" else r"/page/(\d+)"
    numbers = F.transform(H.anchors(H.markup(html)), lambda a: F.regexp_extract(a["href"], pattern, 1).try_cast("bigint"))
    return F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.array_max(numbers), F.lit(1).cast("bigint")))


def own_page_no(url: ColumnLike) -> Column:
    """Page number in the address itself, 1 without one; the last of repeated parameters counts."""
    numbers = F.regexp_extract_all(F.concat(F.lit("&"), url_part(col(url), "query")), F.lit(r"&p=([^&]*)"), F.lit(1))
    last = F.element_at(F.when(F.size(numbers) > 0, numbers), -1)
    return F.coalesce(F.when(last.rlike(r"\A\d+\z"), last.try_cast("bigint")), F.lit(1).cast("bigint"))


def first_seen_distinct(rows: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """One row per key at its first place."""
    return rows.groupBy(*keys).agg(F.min(ord_col).alias(ord_col))
