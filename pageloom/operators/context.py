"""Recent pairs and recent pages as context for what comes next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.predicates import has_vietnamese_marks
from pageloom.functions.text import ColumnLike, col, is_blank, strip
from pageloom.plans.ordered import dense_position, running_sum, same_keys, top_per_group, with_neighbours


def recent_items(df: DataFrame, keys: Sequence[str], pos: str, item: Column, k: int, out: str) -> DataFrame:
    """Array of the last ``k`` non-null items before each row, oldest first."""
    marked = df.withColumn("_item", item)
    has = F.col("_item").isNotNull().cast("bigint")
    counted = running_sum(marked, keys, pos, has, "_upto").withColumn("_before", F.col("_upto") - has)
    items = counted.filter(F.col("_item").isNotNull()).select(*keys, F.col("_upto").alias("_n"), "_item")
    frame = lambda w: {out: F.collect_list("_item").over(w.rowsBetween(-(k - 1), 0))}
    recent = with_neighbours(items, keys, "_n", k - 1, 0, frame).select(*keys, F.col("_n").alias("_before"), out)
    none = F.filter(F.array(F.col("_item")), lambda _: F.lit(False))
    joined = same_keys(counted, recent, [*keys, "_before"], "left")
    return joined.withColumn(out, F.coalesce(out, none)).select(*df.columns, out)


def recent_pairs(df: DataFrame, keys: Sequence[str], pos: str, src: str = "src", trans: str = "trans", k: int = L.CONTEXT_PAIRS) -> DataFrame:
    both = ~is_blank(src) & ~is_blank(trans)
    pair = F.when(both, F.struct(strip(src).alias("src"), strip(trans).alias("trans")))
    return recent_items(df, keys, pos, pair, k, "recent")


def _last(items: ColumnLike, k: int) -> Column:
    items = col(items)
    return F.slice(items, F.greatest(F.size(items) - k + 1, F.lit(1)), F.lit(k))


def pair_block(items: ColumnLike = "recent", shown: int = L.CONTEXT_SHOWN) -> Column:
    """The latest pairs as a text block; empty without any."""
    lines = F.transform(_last(items, shown), lambda p: F.concat(
        F.lit(L.CONTEXT_PAIR_HEAD + "\nOriginal: "), p["src"], F.lit("\nTranslation: "), p["trans"]))
    return F.when(F.size(col(items)) == 0, "").otherwise(
        F.concat(F.array_join(lines, "\n\n"), F.lit(f"\n\n{L.CONTEXT_PAIR_TAIL}\n\n")))


def pronoun_block(items: ColumnLike = "recent", shown: int = L.PRONOUN_CONTEXT_SHOWN) -> Column:
    """The latest pairs that use a listed pronoun; empty with fewer than two pairs of history."""

    def lines(p: Column) -> Column:
        source, said = F.left(p["src"], F.lit(80)), F.left(p["trans"], F.lit(120))
        used = F.array_compact(F.array(*[F.when(said.rlike(rf"(?iU)\b{w}\b"), F.lit(w)) for w in L.LISTED_PRONOUNS]))
        return F.when(F.size(used) > 0, F.array(
            F.concat(F.lit("Source: "), source), F.concat(F.lit("Translation: "), said),
            F.concat(F.lit("Pronouns used: "), F.array_join(used, ", ")))).otherwise(F.array().cast("array<string>"))

    return F.when(F.size(col(items)) < 2, "").otherwise(F.array_join(F.flatten(F.transform(_last(items, shown), lines)), "\n\n"))


def story_line(trans: ColumnLike, chars: int = L.CONTEXT_CHARS) -> Column:
    """A translation as one line of a page's story; what stands further in front than ``chars`` can never show."""
    return F.right(strip(F.replace(strip(trans), F.lit("\n"), F.lit(" "))), F.lit(chars + 1))


def page_story(df: DataFrame, series: str = "series_id", page: str = "page_id", pos: str = "seg_no", trans: str = "trans",
               pages: int = L.CONTEXT_PAGES, chars: int = L.CONTEXT_CHARS) -> DataFrame:
    """Per page: the Vietnamese lines of the last pages, joined, only the last characters kept.

    Only the tail can show, so at most as many lines as can reach it are gathered per page.
    """
    told = df.filter(has_vietnamese_marks(trans)).select(series, page, pos, story_line(trans, chars).alias("line"))
    tail = top_per_group(told, [series, page], [F.col(pos).desc()], chars // 4 + 2)
    joined = tail.groupBy(series, page).agg(F.array_sort(F.collect_list(F.struct(pos, "line"))).alias("l")).select(
        series, page, F.right(F.array_join(F.transform("l", lambda x: x["line"]), " / "), F.lit(chars + 1)).alias("story"))
    everyone = df.select(series, page).distinct().join(joined, [series, page], "left")
    recent = recent_items(everyone, [series], page, F.col("story"), pages, "recent")
    text = F.array_join("recent", " / ")
    cut = F.when(F.length(text) > chars, F.concat(F.lit("…"), F.right(text, F.lit(chars)))).otherwise(text)
    return recent.select(series, page, cut.alias("context"))


def numbered_context(df: DataFrame, size: int, series: str = "series_id", page: str = "page_id", pos: str = "seg_no",
                     text: str = "trans") -> DataFrame:
    """Per page: the numbered lines of its last non-empty pages, one row per line."""
    lines = dense_position(df.filter(~is_blank(text)), [series, page], pos, "_at").select(
        series, F.col(page).alias("_from"), "_at", strip(text).alias("line"))
    counts = lines.groupBy(series, F.col("_from").alias(page)).agg(F.count(F.lit(1)).alias("_n"))
    everyone = df.select(series, page).distinct().join(counts, [series, page], "left")
    item = F.when(F.col("_n") > 0, F.struct(F.col(page).alias("page"), F.col("_n").alias("n")))
    recent = recent_items(everyone, [series], page, item, size, "recent").select(series, page, "recent")
    before = F.transform("recent", lambda p, i: F.struct(p["page"].alias("page"), F.aggregate(
        F.slice("recent", F.lit(1), i), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]).alias("offset")))
    wanted = recent.select(series, page, F.explode(before).alias("b")).select(series, page, F.col("b.page").alias("_from"), "b.offset")
    numbered = wanted.join(lines, [series, "_from"]).withColumn("line_no", F.col("offset") + F.col("_at"))
    return numbered.select(series, page, "line_no", F.concat(F.lit("<|"), F.col("line_no").cast("string"), F.lit("|>"), "line").alias("line"))
