"""Reading tags out of page text with expressions only.

Tags are found by pattern, not by a document tree: quoted, single-quoted and bare
values work, comments, style blocks and script bodies hold no tags, and badly
nested markup is read tag by tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import ColumnLike, col, resub, strip, swap_all

_TAG_BODY = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_ATTRIBUTE = r"""([A-Za-z_:][\w:.\-]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&#34;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\xa0"), ("&amp;", "&"))


def unescape(text: ColumnLike) -> Column:
    return swap_all(text, _ENTITIES)


def markup(html: ColumnLike) -> Column:
    """The page without comments, styles and script bodies."""
    return resub(html, [(r"(?s)<!--.*?-->", ""), (r"(?is)<style\b.*?</style>", ""),
                        (r"(?is)(<script\b[^>]*>).*?</script>", "$1")])


def tags(html: ColumnLike, *names: str) -> Column:
    """Opening tags of the given names, in page order."""
    return F.regexp_extract_all(col(html), F.lit(rf"(?is)<(?:{'|'.join(names)})\b{_TAG_BODY}>"), F.lit(0))


def blocks(html: ColumnLike, name: str, css_class: str | None = None) -> Column:
    """Whole elements from opening to the next closing tag."""
    mark = rf"""(?=[^>]*\bclass\s*=\s*["'][^"'>]*(?<![\w-]){css_class}(?![\w-]))""" if css_class else ""
    return F.regexp_extract_all(col(html), F.lit(rf"(?is)<{name}\b{mark}{_TAG_BODY}>.*?</{name}\s*>"), F.lit(0))


def attributes(tag: Column) -> Column:
    """Array of (name, value) of one tag."""
    names = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2))
    plain = lambda v: F.when(v.rlike(r"""^["']"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("name"), unescape(plain(v)).alias("value")))


def attribute(attrs: Column, name: str) -> Column:
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def attribute_of(tag: Column, names: Sequence[str] | str) -> Column:
    attrs = attributes(tag)
    wanted = [names] if isinstance(names, str) else names
    return F.coalesce(*[attribute(attrs, n) for n in wanted])


def inner_text(element: ColumnLike) -> Column:
    """Text pieces of an element, each trimmed, joined by blanks."""
    pieces = F.transform(F.split(col(element), r"<[^>]*>"), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), " ")


def anchors(html: ColumnLike) -> Column:
    """Array of (href, title, text) of the links that have an address."""
    found = F.transform(blocks(html, "a"), lambda a: F.struct(
        attribute_of(F.regexp_extract(a, rf"(?is)^<a\b{_TAG_BODY}>", 0), "href").alias("href"),
        attribute_of(F.regexp_extract(a, rf"(?is)^<a\b{_TAG_BODY}>", 0), "title").alias("title"),
        inner_text(a).alias("text")))
    return F.filter(found, lambda a: a["href"].isNotNull())


def inline_scripts(html: ColumnLike) -> Column:
    """Bodies of the scripts that have no source address."""
    whole = F.regexp_extract_all(F.regexp_replace(col(html), r"(?s)<!--.*?-->", ""), F.lit(r"(?is)<script\b[^>]*>.*?</script>"), F.lit(0))
    own = F.filter(whole, lambda s: ~F.regexp_extract(s, r"(?is)^<script\b[^>]*>", 0).rlike(r"(?i)\ssrc\s*="))
    return F.transform(own, lambda s: F.regexp_extract(s, r"(?is)^<script\b[^>]*>(.*)</script>$", 1))
