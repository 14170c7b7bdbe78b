"""Address columns: splitting, resolving, naming, paging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.text import ColumnLike, col, let, strip

# scheme, authority (with marker), path, query (with ?), fragment (with #)
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?"


def url_part(url: ColumnLike, part: str) -> Column:
    """One part of an address, by the generic grammar (so blanks and missing schemes are no error)."""
    index = {"scheme": 1, "authority": 2, "path": 3, "query": 4, "fragment": 5}[part]
    got = F.regexp_extract(col(url), _PARTS, index)
    if part == "authority":
        return F.substring(got, 3, 2**31 - 1)
    return F.substring(got, 2, 2**31 - 1) if part in ("query", "fragment") else got


def is_image_url(url: ColumnLike) -> Column:
    endings = "|".join(e[1:] for e in L.PAGE_IMAGE_EXTENSIONS)
    return F.coalesce(F.lower(url_part(url, "path")).rlike(rf"\.(?:{endings})\z"), F.lit(False))


def sanitize_name(name: ColumnLike, max_len: int = L.NAME_MAX) -> Column:
    """Percent-decode, replace characters a file name cannot hold, trim dots and blanks, cut."""
    # A plus sign is itself here, and a stray percent sign must not fail the row.
    safe = F.regexp_replace(F.replace(col(name), F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.when(col(name).contains("%"), F.coalesce(F.try_url_decode(safe), col(name))).otherwise(col(name))
    cut = F.left(strip(F.regexp_replace(decoded, r'[\\/:*?"<>|]', "_"), ". "), F.lit(max_len))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("image"))


def url_filename(url: ColumnLike, index: ColumnLike) -> Column:
    """Last path part when it has a dot, else a name from the position and a short hash."""
    base = F.substring_index(url_part(url, "path"), "/", -1)
    number = col(index).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    made = F.concat(F.lit("image_"), padded, F.lit("_"), F.left(F.md5(col(url)), F.lit(8)), F.lit(".jpg"))
    return let(base, lambda b: F.when(b.contains("."), sanitize_name(b)).otherwise(made))


def filename_from_url(url: ColumnLike, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col(url), r"/([^/?]+)[^/]*$", 1), F.lit("")), F.lit(default))


def gallery_page_url(url: ColumnLike, page: ColumnLike) -> Column:
    """Page number as ``p=``; the test is on the bare substring, as the listing plan expects."""
    url, page = col(url), col(page).cast("string")
    added = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("p="), page)
    return F.when(url.contains("p="), F.regexp_replace(url, F.lit(r"([?&]p=)\d+"), F.concat(F.lit("$1"), page))).otherwise(added)


def article_page_url(url: ColumnLike, page: ColumnLike) -> Column:
    """Page number as ``/page/N``; the query is kept."""
    page = col(page)
    path = F.rtrim(F.regexp_replace(url_part(url, "path"), r"/page/\d+/?", "/"), F.lit("/"))
    full = F.when(page > 1, F.concat(path, F.lit("/page/"), page.cast("string"))).otherwise(path)
    query = url_part(url, "query")
    return F.concat(
        url_part(url, "scheme"), F.lit("://"), url_part(url, "authority"),
        F.coalesce(F.nullif(full, F.lit("")), F.lit("/")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def slide_url(url: ColumnLike) -> Column:
    pattern = r"(https?://[^/]+)/photos-(?:index|slide)-aid-(\d+)\.html"
    return F.when(col(url).rlike(pattern), F.concat(
        F.regexp_extract(col(url), pattern, 1), F.lit("/photos-slide-aid-"),
        F.regexp_extract(col(url), pattern, 2), F.lit(".html")))


def _without_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""

    def step(done: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
            .when(seg == ".", done).otherwise(F.concat(done, F.array(seg)))
        )

    def fold(segs: Column) -> Column:
        body = F.aggregate(F.slice(segs, F.lit(2), F.size(segs)), F.array(F.lit("")), step)
        ends_open = F.element_at(segs, -1).isin(".", "..")
        return let(body, lambda b: F.array_join(F.when(ends_open, F.concat(b, F.array(F.lit("")))).otherwise(b), "/"))

    dotted = path.rlike(r"(?:^|/)\.\.?(?:/|$)")
    return F.when(dotted, let(F.split(path, "/"), fold)).otherwise(path)


def resolve_url(base: ColumnLike, raw: ColumnLike) -> Column:
    """Absolute address of a reference found on a page."""
    base, raw = col(base), col(raw)
    scheme, host, base_path = (url_part(base, p) for p in ("scheme", "authority", "path"))
    origin = F.concat(scheme, F.lit("://"), host)
    tail = F.concat(F.regexp_extract(raw, _PARTS, 4), F.regexp_extract(raw, _PARTS, 5))
    path = url_part(raw, "path")
    folder = F.regexp_extract(base_path, r"^(.*/)?", 0)
    joined = F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), path)
    own_scheme = raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    web = raw.rlike(r"^(?i:https?)://")
    return (
        F.when(raw == "", base)
        .when(web & raw.rlike(r"/\.\.?(?:[/?#]|$)"), F.concat(
            F.regexp_extract(raw, r"^[^:]+://[^/?#]*", 0), _without_dots(path), tail))
        .when(own_scheme, raw)
        .when(raw.startswith("//"), F.concat(scheme, F.lit("://"), url_part(raw, "authority"), _without_dots(path), tail))
        .when(raw.startswith("/"), F.concat(origin, _without_dots(path), tail))
        .when(raw.startswith("?"), F.concat(origin, base_path, raw))
        .when(raw.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), raw))
        .otherwise(F.concat(origin, _without_dots(joined), tail))
    )


def folder_of(path: ColumnLike) -> Column:
    return F.regexp_replace(col(path), r"/[^/]*$", "")


def series_root(path: ColumnLike) -> Column:
    """Parent of the nearest folder called ``original`` on the path, else the parent."""
    path = col(path)
    found = F.regexp_extract(path, r"(?i)^(.*)/original(?:/.*)?$", 1)
    # the greedy prefix stops at the last such folder
    return F.when(path.rlike(r"(?i)/original(?:/|$)"), found).otherwise(folder_of(path))


def output_name(name: ColumnLike, quality: int) -> Column:
    """Lossy output turns everything but JPEG and WebP into ``.jpg``."""
    name = col(name)
    if quality >= 100:
        return name
    return F.when(name.rlike(r"(?i)\.(?:jpe?g|webp)$"), name).otherwise(
        F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(".jpg")))


def extension(name: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(col(name), r"(?<=.)\.([^.]+)$", 1))


def stem(name: ColumnLike) -> Column:
    return F.regexp_replace(col(name), r"(?<=.)\.[^.]*$", "")


def suffix(name: ColumnLike) -> Column:
    return F.regexp_extract(col(name), r"(?<=.)(\.[^.]*)$", 1)


def natural_key(name: ColumnLike, fold_case: bool = True) -> Column:
    """Sort key: text and number runs alternate, numbers compare by value."""
    text = F.lower(col(name)) if fold_case else col(name)
    parts = F.regexp_extract_all(text, F.lit(r"(\D*)(\d*)"), F.lit(0))
    digits = lambda p: F.regexp_replace(F.regexp_extract(p, r"\d*$", 0), r"^0+(?=\d)", "")
    # longer numbers are larger, equally long ones compare as text: no number is too long
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(
        F.regexp_extract(p, r"^\D*", 0).alias("text"), F.length(digits(p)).alias("size"), digits(p).alias("digits")))
