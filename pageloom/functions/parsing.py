"""Reading JSON and line-oriented replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.geometry import pixel_box
from pageloom.functions.text import (
    ColumnLike,
    clean_watermark_lines,
    col,
    fix_vi_spelling,
    let,
    lstrip,
    normalize_newlines,
    strip,
    strip_artifacts,
    text_lines,
)

# plain JSON: the reader would otherwise take single quotes as well
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def bracketed(text: ColumnLike) -> Column:
    """From the first ``[`` to the last ``]``; null when there is no such span."""
    return F.nullif(F.regexp_extract(col(text), r"(?s)\[.*\]", 0), F.lit(""))


def page_boxes(reply: ColumnLike, width: ColumnLike, height: ColumnLike) -> Column:
    """Array of (box, text, conf) read from a page reply; bad items are skipped, bad JSON gives none."""
    items = F.from_json(bracketed(reply), "array<struct<bbox array<string>, text string>>", STRICT)
    read = F.transform(items, lambda i: F.struct(
        pixel_box(i["bbox"], width, height).alias("box"),
        strip(F.coalesce(i["text"], F.lit(""))).alias("text"), F.lit(0.99).alias("conf")))
    empty = F.array().cast("array<struct<box struct<x1 double, y1 double, x2 double, y2 double>, text string, conf double>>")
    return F.coalesce(F.filter(read, lambda r: r["box"].isNotNull() & (r["text"] != "")), empty)


def reply_texts(reply: ColumnLike, expected: ColumnLike) -> Column:
    """Texts of a JSON-array reply; null unless it holds exactly ``expected`` items."""
    raw = bracketed(strip_artifacts(reply))
    items = F.from_json(raw, "array<string>", STRICT)

    def text_of(item: Column) -> Column:
        known = F.from_json(item, "struct<" + ", ".join(f"{k} string" for k in L.REPLY_KEYS) + ">")
        keyed = F.from_json(item, "map<string,string>")
        fields = F.coalesce(*[known[k] for k in L.REPLY_KEYS], F.get(F.map_values(keyed), F.lit(0)), item)
        return F.when(item.startswith("{"), fields).otherwise(item)

    tidy = lambda i: clean_watermark_lines(fix_vi_spelling(normalize_newlines(text_of(i))))
    return F.when(F.size(items) == col(expected), F.transform(items, tidy))


def _unbulleted(line: Column) -> Column:
    return strip(lstrip(strip(line), L.REPLY_BULLETS))


def arrow_lines(text: ColumnLike, any_separator: bool = True) -> Column:
    """Array of (line_no, zh, vi) from 'left => right' lines.

    With ``any_separator`` the first of ``=>``, ``→``, full-width colon and colon that the line holds splits it.
    """

    def pair(line: Column, at: Column) -> Column:
        sep = F.when(line.contains("=>"), "=>")
        if any_separator:
            sep = sep.when(line.contains("→"), "→").when(line.contains("："), "：").when(line.contains(":"), ":")
        cut = F.position(sep, line)
        return F.struct(
            at.cast("bigint").alias("line_no"),
            strip(F.substring(line, F.lit(1), cut - 1)).alias("zh"),
            strip(F.substring(line, cut + F.length(sep), F.length(line))).alias("vi"))

    lines = F.transform(F.split(col(text), L.LINE_END), _unbulleted)
    return F.filter(F.transform(lines, pair), lambda p: (p["zh"] != "") & (p["vi"] != ""))


def yes_numbers(reply: ColumnLike) -> Column:
    """Numbers answered YES in 'k: YES' lines; anything else counts as no."""
    hits = F.regexp_extract_all(col(reply), F.lit(r"(?im)^\s*(\d+)\s*[:.)\-]?\s*(?:YES|NO)\b"), F.lit(0))
    first = F.transform(hits, lambda h: F.struct(
        F.regexp_extract(h, r"(\d+)", 1).try_cast("int").alias("k"), F.upper(h).contains("YES").alias("yes")))
    # a number answered twice counts by its first line
    fresh = F.filter(first, lambda f: f["yes"])
    return F.array_distinct(F.filter(F.transform(fresh, lambda f: f["k"]), lambda k: k.isNotNull()
        & F.get(F.filter(first, lambda f: f["k"] == k), F.lit(0))["yes"]))


def sources_array(text: ColumnLike) -> Column:
    """JSON list of names; anything else is an empty list."""
    return F.coalesce(F.from_json(col(text), "array<string>", STRICT), F.array().cast("array<string>"))


def merge_sources(existing: ColumnLike, source: ColumnLike) -> Column:
    """Append a name unless it is blank or present; order stays."""
    existing, source = col(existing), col(source)
    absent = F.coalesce((source != "") & ~F.array_contains(existing, source), F.lit(False))
    return F.when(absent, F.concat(existing, F.array(source))).otherwise(existing)


def script_url_lists(script: ColumnLike) -> Column:
    """Image lists under known keys of inline data, then quoted absolute image addresses; in text order."""
    lists = []
    for q in ('"', "'"):
        raw = F.regexp_extract_all(col(script), F.lit(rf"(?is){q}{L.SCRIPT_LIST_KEYS}{q}\s*:\s*(\[.*?\])"), F.lit(1))
        arrays = F.transform(raw, lambda a: F.coalesce(F.from_json(a, "array<variant>", STRICT), F.array().cast("array<variant>")))
        # only items that are JSON strings are addresses
        texts = F.filter(F.flatten(arrays), lambda v: F.schema_of_variant(v) == "STRING")
        lists.append(F.transform(texts, lambda v: strip(F.variant_get(v, "$", "string"))))
    quoted = F.regexp_extract_all(col(script), F.lit(L.SCRIPT_QUOTED_IMAGE), F.lit(1))
    as_item = lambda checked: (lambda u: F.struct(u.alias("raw"), F.lit(checked).alias("ready")))
    items = F.concat(*[F.transform(a, as_item(False)) for a in lists], F.transform(quoted, as_item(True)))
    return F.filter(items, lambda i: i["raw"].isNotNull() & (i["raw"] != ""))


def srcset_urls(srcset: ColumnLike) -> Column:
    parts = F.transform(F.split(col(srcset), ","), lambda p: F.regexp_extract(p, rf"^{L.WS_CLASS}*({L.NON_WS_CLASS}*)", 1))
    return F.filter(parts, lambda p: (p != "") & ~p.startswith("data:"))


def text_line_pairs(text: ColumnLike) -> Column:
    return let(text_lines(text), lambda lines: F.transform(lines, lambda line, i: F.struct(
        (i + 1).cast("bigint").alias("line_no"), line.alias("line"))))
