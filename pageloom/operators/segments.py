"""Segments of a page: final text choice, term enforcement, merging of split sentences, batching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.geometry import is_near
from pageloom.functions.predicates import (
    effectively_empty,
    is_decor,
    needs_retry,
    rejection_reason,
    title_safe_to_erase,
    watermark_only,
)
from pageloom.functions.text import (
    ColumnLike,
    col,
    ensure_terminal_punct,
    fix_closed_vocab,
    fix_ocr_source,
    is_watermark,
    let,
    matches,
    pattern_count,
    strip,
)
from pageloom.plans.ordered import carry_last, dense_position, running_sum, top_per_group, with_neighbours


def batch_of(position: ColumnLike, size: int) -> Column:
    """Batch number of a 1-based position."""
    return F.floor((col(position) - 1) / F.lit(size)).cast("bigint")


# ---------------------------------------------------------------- final text


def finalise_translation(df: DataFrame, src: str = "src", trans: str = "trans", kind: str = "kind", out: str = "final") -> DataFrame:
    """The text to show: erased, kept as source, or the translation with a proper end."""
    flags = df.withColumns({
        "_mark": is_watermark(src, "chat"), "_only": watermark_only(src), "_none": effectively_empty(trans),
        "_decor": is_decor(src), "_safe": title_safe_to_erase(src), "_retry": needs_retry(F.coalesce(trans, F.lit(""))),
        "_ended": ensure_terminal_punct(trans)})
    source, text = F.coalesce(src, F.lit("")), F.col(trans)
    erased = F.lit(L.JOINER)
    chosen = (
        F.when(F.col("_mark") & (F.col("_only") | F.col("_none")), erased)
        .when(F.col("_mark"), F.col("_ended"))
        .when(F.col("_decor"), source)
        .when((F.col(kind) == "title") & ~F.col("_none"), text)
        .when((F.col(kind) == "title") & F.col("_safe"), erased)
        .when(F.col(kind) == "title", source)
        .when(F.col("_none"), erased)
        .when(F.col("_retry"), F.when(source != "", source).otherwise(text))
        .when(F.coalesce(F.col(kind) != "sfx", F.lit(True)), F.col("_ended"))
        .otherwise(text))
    picked = flags.withColumn(out, chosen).drop("_mark", "_only", "_none", "_decor", "_safe", "_retry", "_ended")
    fixed = fix_closed_vocab(fix_ocr_source(source), out)
    return picked.withColumn(out, F.when(F.col(out).isin("", L.JOINER), F.col(out)).otherwise(fixed))


def _pieces(text: Column, least: Column, most: Column, block: int = 1024) -> Column:
    """What stands at each place of a text, ``most`` characters long, shorter at the end but not below ``least``. Cut by way of
    blocks, as reaching a place in a long text costs its distance."""

    def inside(start: Column) -> Column:
        part = F.substring(text, start + 1, F.lit(block) + most - 1)
        places = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(block), F.length(t)))), lambda i: F.substring(t, i, most))
        return let(part, places)

    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(block))
    return F.filter(F.flatten(F.transform(starts, inside)), lambda p: F.length(p) >= least)


def enforce_terms(df: DataFrame, terms: DataFrame, seg_key: Sequence[str], term_key: Sequence[str] = (), src: str = "src",
                  trans: str = "trans", out: str = "enforced") -> DataFrame:
    """Replace source terms left in a translation, longest first, unless their fixed translation is there.

    terms: term_key..., zh (unique within it), vi, pos. A source gives one piece per place, as long as the longest term. Terms are
    known by a head of 1, 2, 4, 8 ... characters, as many as fit, so a head is more than half of its term; the piece's heads of these sizes, as far as
    terms have them, meet the terms that begin alike, and the piece tells whether the whole term stands there. So a size of terms costs
    one row per place of the text and its matches, and a term of one character adds nothing to those of the others. Terms are looked for
    once per text and term_key, so ``seg_key`` need not be unique.
    """
    terms = terms.filter(F.col("zh") != "")
    bound = lambda of: terms.agg(of(F.length("zh")).alias("n")).scalar()
    size = F.pow(F.lit(2), F.floor(F.log2(F.length("zh").cast("double")))).cast("int")
    sizes = terms.agg(F.collect_set(size).alias("s")).scalar()  # one entry per doubling of the length
    pieces = _pieces(F.col("_src"), F.col("_least"), F.col("_most"))
    # a text that stands in many segments is looked through once
    texts = df.select(*term_key, F.col(src).alias("_src")).filter(F.col("_src") != "").distinct()
    text_key = [*term_key, "_src"]
    cut = texts.withColumns({"_least": bound(F.min), "_most": bound(F.max), "_sizes": sizes}).filter(F.col("_least").isNotNull()).select(
        *text_key, "_sizes", F.explode(F.array_distinct(pieces)).alias("_piece"))
    heads = cut.withColumn("_size", F.explode(F.filter("_sizes", lambda n: n <= F.length("_piece")))).withColumn(
        "_head", F.left("_piece", F.col("_size"))).drop("_size", "_sizes")
    fixed = terms.select(*term_key, "zh", "vi", "pos", F.left("zh", size).alias("_head"))
    found = heads.join(fixed, [*term_key, "_head"]).filter(F.col("_piece").startswith(F.col("zh")))
    per_text = found.groupBy(*text_key).agg(
        F.array_sort(F.collect_set(F.struct((-F.length("zh")).alias("n"), "pos", "zh", "vi"))).alias("_terms"))

    def step(acc: Column, term: Column) -> Column:
        left = acc.contains(term["zh"]) & ~F.lower(acc).contains(F.lower(term["vi"]))
        return F.when(left, F.replace(acc, term["zh"], term["vi"])).otherwise(acc)

    joined = df.withColumn("_src", F.col(src)).join(per_text, text_key, "left").select(*df.columns, "_terms")
    folded = F.when(F.col("_terms").isNull(), F.col(trans)).otherwise(F.aggregate("_terms", F.col(trans), step))
    return joined.withColumn(out, folded).drop("_terms")


def drop_rejected(df: DataFrame, src: str = "src", trans: str = "trans", user_pattern: str | None = None) -> DataFrame:
    """Keep the translated segments; the reason of the others is in ``rejection_reason``."""
    return df.filter(rejection_reason(src, trans, user_pattern).isNull())


def label_by_source_text(df: DataFrame, labels: DataFrame, keys: Sequence[str], label: str, pos: str) -> DataFrame:
    """Attach the label whose trimmed source text is equal; the first of several on a page wins."""
    build = labels.withColumn("_text", strip("src")).groupBy(*keys, "_text").agg(F.min_by(label, pos).alias(label))
    return df.withColumn("_text", strip("src")).join(build, [*keys, "_text"], "left").drop("_text")


# ---------------------------------------------------------------- split sentences


def sentence_islands(df: DataFrame, answers: DataFrame | None = None, keys: Sequence[str] = ("page_id",), pos: str = "seg_no",
                     src: str = "src", box: str | None = None) -> DataFrame:
    """Adds pair_kind (forced, ask or null) of each segment with the next one, and the island it belongs to.

    answers: keys, pos, yes - the outside verdict on the pairs to ask.
    """
    fixed = dense_position(df.withColumn("_a", fix_ocr_source(strip(src))), keys, pos, "_n")
    columns = {"_b": "_a"} | ({"_next_box": box} if box else {})
    paired = with_neighbours(fixed, keys, "_n", 0, 1, lambda w: {n: F.lead(c).over(w) for n, c in columns.items()})
    last = F.right("_a", F.lit(1))
    both = matches("_a", L.HAN) & matches("_b", L.HAN) & ~is_watermark("_a", "chat") & ~is_watermark("_b", "chat")
    cand = both & ~F.contains(F.lit(L.SENTENCE_END), last) & (pattern_count("_a", L.HAN) > 4)
    if box:
        cand = cand & F.coalesce(is_near(F.col(box), F.col("_next_box")), F.lit(True))
    forced = cand & last.rlike(L.HAN) & ~F.contains(F.lit(L.FINAL_PARTICLES), last)
    kinds = paired.withColumn("pair_kind", F.when(forced, "forced").when(cand, "ask"))
    if answers is not None:
        said = answers.select(*keys, pos, F.col("yes").alias("_yes"))
        kinds = kinds.join(said, [*keys, pos], "left")
    else:
        kinds = kinds.withColumn("_yes", F.lit(False))
    joins = (F.col("pair_kind") == "forced") | ((F.col("pair_kind") == "ask") & F.coalesce("_yes", F.lit(False)))
    joined = kinds.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    before = with_neighbours(joined, keys, "_n", 1, 0, lambda w: {"_prev": F.coalesce(F.lag("_joins").over(w), F.lit(False))})
    islands = running_sum(before, keys, "_n", (~F.col("_prev")).cast("bigint"), "island", dense=True)
    return islands.select(*df.columns, "pair_kind", "island")


def continuation_fill(df: DataFrame, keys: Sequence[str] = ("page_id",), pos: str = "seg_no", src: str = "src",
                      trans: str = "trans") -> DataFrame:
    """Resolve ``[cont]``: an empty one disappears into the latest anchor, one with text becomes an anchor."""
    cont = matches(trans, L.CONTINUATION_TAG)
    rest = strip(F.regexp_replace(F.col(trans), L.CONTINUATION_TAG, ""))
    tagged = df.withColumns({"_cont": cont, "_rest": F.when(cont, rest)})
    plain = strip(trans)
    anchor = F.when(F.col("_cont"), F.col("_rest") != "").otherwise((plain != "") & (plain != L.JOINER))
    carried = carry_last(tagged, keys, pos, F.when(anchor, F.struct(F.col(pos).alias("at"), strip(src).alias("src"))), "_anchor")
    blank = F.col("_cont") & (F.col("_rest") == "")
    text = F.when(blank, L.JOINER).when(F.col("_cont"), F.col("_rest")).otherwise(F.col(trans))
    own = strip(src)
    merges = blank & (own != "") & (F.col("_anchor.src") != "") & (own != F.col("_anchor.src"))
    return carried.select(*df.columns, text.alias("filled"), F.when(merges, F.col("_anchor.at")).alias("anchor_no"))


def expand_merged(df: DataFrame, results: DataFrame, keys: Sequence[str] = ("page_id",), pos: str = "seg_no", group: str = "group_no",
                  src: str = "src") -> DataFrame:
    """Spread group translations: the first slot gets the text, the others become invisible.

    A result equal to the joined source means nothing was translated; then every slot keeps its own
    source. The comparison is made slot by slot, so no group is gathered.
    """
    parts = df.join(results.select(*keys, group, F.col("trans").alias("_r")), [*keys, group], "left")
    parts = parts.withColumns({"_r": F.coalesce("_r", F.lit("")), "_s": strip(src)}).withColumn("_len", F.length("_s").cast("bigint"))
    run = running_sum(parts, [*keys, group], pos, F.col("_len"), "_end")
    piece = F.substring(strip("_r"), (F.col("_end") - F.col("_len") + 1).cast("int"), F.col("_len").cast("int")) == F.col("_s")
    verdict = run.groupBy(*keys, group).agg(
        (F.min(piece.cast("int")) == 1).alias("_equal"), F.sum("_len").alias("_total"), F.count(F.lit(1)).alias("_n"),
        F.min(pos).alias("_first"), F.max(F.length(strip("_r"))).alias("_rlen"))
    back = run.join(verdict, [*keys, group])
    same = (F.col("_n") > 1) & F.col("_equal") & (F.col("_total") == F.col("_rlen"))
    text = F.when(same, F.col(src)).when(F.col(pos) == F.col("_first"), F.col("_r")).otherwise(L.JOINER)
    return back.select(*df.columns, text.alias("expanded"))


# ---------------------------------------------------------------- batches


def pack_prompts(df: DataFrame, limit: int, keys: Sequence[str] = ("page_id",), pos: str = "seg_no", src: str = "src",
                 by: str = "remaining") -> DataFrame:
    """prompt_no, line_no and the numbered line of each segment.

    ``remaining``: a prompt is closed while more than ``limit`` characters are still to come.
    ``budget``: a prompt takes segments that start within the same ``limit`` characters.
    """
    sized = df.withColumn("_len", F.length(src).cast("bigint"))
    run = running_sum(dense_position(sized, keys, pos, "_n"), keys, "_n", F.col("_len"), "_run", dense=True)
    if by == "budget":
        numbered = run.withColumn("prompt_no", F.floor((F.col("_run") - F.col("_len")) / F.lit(limit)).cast("bigint"))
        firsts = numbered.groupBy(*keys, "prompt_no").agg(F.min("_n").alias("_first"))
        lined = numbered.join(firsts, [*keys, "prompt_no"]).withColumn("line_no", F.col("_n") - F.col("_first") + 1)
    else:
        totals = sized.groupBy(*keys).agg(F.sum("_len").alias("_total"))
        closing = run.join(totals, list(keys)).withColumn("_close", (F.col("_total") - F.col("_run") > limit).cast("bigint"))
        counted = running_sum(closing, keys, "_n", F.col("_close"), "_closed", dense=True)
        # once the rest fits, no further prompt is closed: every earlier prompt holds one line
        lined = counted.withColumn("prompt_no", F.col("_closed") - F.col("_close")).withColumn(
            "line_no", F.col("_n") - F.col("prompt_no"))
    line = F.concat(F.lit("<|"), F.col("line_no").cast("string"), F.lit("|>"), fix_ocr_source(src))
    return lined.select(*df.columns, "prompt_no", "line_no", line.alias("line"))


def prompt_texts(packed: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """One text per prompt; its size is bounded by the packing limit."""
    lines = packed.groupBy(*keys, "prompt_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"), F.count(F.lit(1)).alias("size"))
    return lines.select(*keys, "prompt_no", "size", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"))


def budgeted_selection(df: DataFrame, keys: Sequence[str], pos: str, src: str = "src", trans: str = "trans",
                       max_pairs: int = L.LEARN_MAX_PAIRS, max_chars: int = L.LEARN_MAX_CHARS) -> DataFrame:
    """Distinct pairs (first translation wins), shortest source first, while they fit the budget; ``capped`` tells of a rest."""
    pairs = df.filter((F.col(src) != "") & (F.col(trans) != "")).groupBy(*keys, src).agg(
        F.min_by(trans, pos).alias(trans), F.min(pos).alias(pos))
    totals = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    order = [F.length(src), F.col(pos)]
    short = top_per_group(pairs, keys, order, max_pairs)
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cost = F.length(src) + F.length(trans) + L.LEARN_PAIR_OVERHEAD
    kept = short.withColumn("_sum", F.sum(cost).over(window)).filter(F.col("_sum") <= max_chars)
    chosen = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_chosen"))
    return kept.join(totals, list(keys)).join(chosen, list(keys)).select(
        *keys, src, trans, pos, (F.col("_chosen") < F.col("_all")).alias("capped"))


def flush_epochs(df: DataFrame, keys: Sequence[str], page: str = "page_id", every: int = L.LEARN_EVERY_PAGES) -> DataFrame:
    """Which flush each page of a run belongs to."""
    pages = dense_position(df.select(*keys, page).distinct(), keys, page, "_n")
    return pages.select(*keys, page, batch_of("_n", every).alias("epoch"))


def scatter_positions(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Flat 0-based position of every segment of a run; results find their way home by key."""
    return dense_position(df, keys, pos, "_n").withColumn("flat", F.col("_n") - 1).drop("_n")


def page_language_gate(df: DataFrame, detected: Column, target: str, keys: Sequence[str] = ("page_id",), min_regions: int = 10) -> DataFrame:
    """passes = the page is short or its detected language is the target.

    ``detected`` is an aggregate over the non-blank ``trans`` of a page (for instance counts per
    script), so a page is classified as a whole without being gathered.
    """
    told = df.withColumn("trans", F.when(strip("trans") != "", strip("trans")))
    pages = told.groupBy(*keys).agg(F.count(F.lit(1)).alias("regions"), F.count("trans").alias("_said"), detected.alias("detected"))
    passes = (F.col("regions") <= min_regions) | (F.col("_said") == 0) | (F.upper("detected") == target.upper())
    return pages.select(*keys, "regions", F.coalesce(passes, F.lit(False)).alias("passes"))
