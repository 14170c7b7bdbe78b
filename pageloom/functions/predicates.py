"""Boolean and routing columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.text import (
    ColumnLike,
    clean_watermark_lines,
    col,
    is_blank,
    is_watermark,
    let,
    literal_count,
    pattern_count,
    strip,
    strip_artifacts,
    text_lines,
)
from pageloom.functions.urls import is_image_url


def has_script(text: ColumnLike, script: str) -> Column:
    """``japanese`` includes Han on purpose; ``english_word`` needs three letters, ``english`` two."""
    pattern = {
        "chinese": L.HAN, "japanese": L.JAPANESE, "cjk": L.JAPANESE,
        "english_word": L.ENGLISH_WORD, "english": L.ENGLISH_RUN,
    }[script]
    return F.coalesce(col(text).rlike(pattern), F.lit(False))


def script_char_count(text: ColumnLike, script: str = "chinese") -> Column:
    return pattern_count(text, L.HAN if script == "chinese" else L.JAPANESE_COUNTED)


def is_decor(src: ColumnLike) -> Column:
    """Latin-only lettering that belongs to the artwork."""
    return ~is_blank(src) & ~col(src).rlike(L.ANY_EAST_ASIAN) & ~is_watermark(src, "chat")


def watermark_only(text: ColumnLike) -> Column:
    """A site mark with no real sentence next to it."""
    rest = F.regexp_replace(col(text), L.LATIN_TOKEN, "")
    speech = let(rest, lambda r: (pattern_count(r, L.HAN) >= 5)
                 | ((pattern_count(r, L.HAN) >= 2) & r.rlike(r"[。！？…!?]")))
    return is_watermark(text, "chat") & ~speech


def title_safe_to_erase(text: ColumnLike) -> Column:
    t = strip(F.coalesce(col(text), F.lit("")))
    return (t == "") | (F.length(t) >= 16) | t.rlike(L.TITLE_DECOR)


def effectively_empty(text: ColumnLike) -> Column:
    t = F.regexp_replace(strip(text), L.KIND_TAG, "")
    return F.coalesce((t == L.JOINER) | ~t.rlike(r"(?U)[\p{L}\p{N}_]"), F.lit(True))


def needs_retry(text: ColumnLike, variant: str = "chat") -> Column:
    """Is the translation still Chinese, Japanese or English? ``chat`` tests Han only, the others kana too."""
    foreign = L.HAN if variant == "chat" else L.JAPANESE

    def decide(c: Column) -> Column:
        return (
            F.when(F.length(strip(c)) < 4, False).when(c.rlike(foreign), True)
            .when(c.rlike(L.VIETNAMESE_MARK), False)
            .otherwise(c.rlike(L.TWO_ENGLISH_WORDS))
        )

    def by_lines(raw: Column, c: Column, lines: Column) -> Column:
        # no sign and no word reaches over a line's end, so only lines that would decide are tested for being site marks
        def kept(test: Callable[[Column], Column]) -> Column:
            return F.exists(lines, lambda line: test(line) & ~is_watermark(line, variant))

        # signs are no ASCII, and neither are the texts that are searched for them
        signs = F.length(c) < F.octet_length(c)
        single = F.filter(lines, lambda line: line.rlike(L.ENGLISH_WORD) & ~is_watermark(line, variant))
        return (
            F.when(~kept(lambda line: F.length(line) >= 4), let(clean_watermark_lines(raw, variant=variant), decide))
            .when(signs & c.rlike(foreign) & kept(lambda line: line.rlike(foreign)), True)
            .when(signs & c.rlike(L.VIETNAMESE_MARK) & kept(lambda line: line.rlike(L.VIETNAMESE_MARK)), False)
            .when(kept(lambda line: line.rlike(L.TWO_ENGLISH_WORDS)), True)
            .otherwise(F.size(single) >= 2)
        )

    # leftovers go twice, as cleaning the lines of a text without them does it again
    once = strip_artifacts(F.coalesce(col(text), F.lit("")), variant)
    return let(once, lambda raw: let(strip_artifacts(raw, variant), lambda c: let(text_lines(c), lambda lines: by_lines(raw, c, lines))))


def has_vietnamese_marks(text: ColumnLike) -> Column:
    return F.coalesce(col(text).rlike(L.VIETNAMESE_MARK), F.lit(False))


def target_is_vietnamese(lang: ColumnLike) -> Column:
    return F.coalesce(F.lower(strip(lang)).isin(*L.VIETNAMESE_NAMES), F.lit(False))


def keep_by_source_script(text: ColumnLike, conf: ColumnLike, lang: str) -> Column:
    """Keep an OCR hit whose script fits the source language and that is confident or long enough."""
    text, conf = col(text), col(conf)
    if lang == "zh":
        sure = (conf > L.OCR_MIN_CONF_EAST_ASIAN) | (script_char_count(text) >= L.OCR_MIN_HAN)
        return has_script(text, "chinese") & sure
    if lang == "ja":
        sure = (conf > L.OCR_MIN_CONF_EAST_ASIAN) | (script_char_count(text, "japanese") >= L.OCR_MIN_JAPANESE)
        return has_script(text, "japanese") & sure
    return (
        (conf > L.OCR_MIN_CONF_ENGLISH) & has_script(text, "english")
        & (F.length(strip(text)) >= L.OCR_MIN_ENGLISH_LENGTH)
    )


def has_visible_text(text: ColumnLike) -> Column:
    return ~is_blank(F.translate(F.coalesce(col(text), F.lit("")), L.INVISIBLE, ""))


def learnable_shape(zh: ColumnLike, vi: ColumnLike) -> Column:
    """The part of the junk filter that needs no word list."""
    return (col(zh) != "") & (col(vi) != "") & has_script(zh, "chinese") & (F.length(strip(zh)) >= 2)


def is_learnable(zh: ColumnLike, vi: ColumnLike) -> Column:
    return learnable_shape(zh, vi) & ~col(zh).isin(*L.STOPWORDS)


def _thrice(words: Column, tail: int, last: Column) -> Column:
    """Places i, up to ``last``, where the end of a word (``tail`` characters, words of at least so many; 1: shorter ones than 4) and the next word
    begin like those of three places or more, itself included. Sorted keys that begin alike stand together."""

    def key(i: Column) -> Column:
        return F.struct(F.concat(F.right(F.get(words, i - 1), F.lit(tail)), F.lit(" "), F.get(words, i)).alias("key"), i.alias("at"))

    def places(keys: Column) -> Column:
        def among_three(e: Column, r: Column) -> Column:
            like = lambda n: F.coalesce(F.get(keys, r + n)["key"].startswith(e["key"]), F.lit(False))
            same = lambda n: F.coalesce((r >= n) & (F.get(keys, F.greatest(r - n, F.lit(0)))["key"] == e["key"]), F.lit(False))
            size = F.length(F.get(words, e["at"] - 1))
            counts = (size >= tail) if tail > 1 else (size < 4)
            return (e["at"] <= last) & counts & (like(2) | (like(1) & same(1)) | same(2))

        return F.transform(F.filter(keys, among_three), lambda e: e["at"])

    return let(F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), key)), places)


def is_repetitive(text: ColumnLike, threshold: int = 5) -> Column:
    """Character, word or phrase repeated the way a stuck model repeats itself."""
    text = col(text)
    t, size = threshold, threshold // 2

    def phrase_again(words: Column) -> Column:
        def hit(i: Column) -> Column:
            phrase = F.array_join(F.slice(words, i, F.lit(size)), " ")
            later = F.array_join(F.slice(words, i + size, F.size(words)), " ")
            return let(phrase, lambda p: F.when(stands_thrice(p), later.contains(p)).otherwise(False))

        def stands_thrice(p: Column) -> Column:
            after = lambda at: F.position(p, text, at + F.length(p))
            second = let(F.position(p, text), after)
            return let(second, lambda at: (at > 0) & (after(at) > 0))

        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - t + 1, F.lit(1)))
        if size >= 2:
            # a phrase that stands three times leaves its first two words at three places, or ends of words like them
            likely = F.array_union(_thrice(words, 4, F.size(words) - t + 1), _thrice(words, 1, F.size(words) - t + 1))
            starts = F.array_sort(likely)
        return F.when(F.size(words) >= 2 * t, F.exists(starts, hit)).otherwise(False)

    def same_token_run(tokens: Column) -> Column:
        # the first unequal neighbour ends the comparison, so nearly every token costs one
        def starts_run(w: Column, i: Column) -> Column:
            out = F.lit(True)
            for k in range(1, t):
                out = out & w.eqNullSafe(F.get(tokens, i + k))
            return out

        return F.array_contains(F.transform(tokens, starts_run), True)

    # a token is one Han character at the head of a run, or the rest of the run
    tokens = F.regexp_extract_all(text, F.lit(f"{L.UNIFIED_HAN}|{L.NON_WS_CLASS}+"), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(f"{L.NON_WS_CLASS}+"), F.lit(0))
    found = (
        F.when(F.length(strip(text)) < t, False)
        .when(text.rlike(rf"(?s)(.)\1{{{t - 1}}}"), True)
        .when(let(tokens, same_token_run), True)
        .otherwise(let(words, phrase_again))
    )
    return F.coalesce(found, F.lit(False))


def accept_translation(src: ColumnLike, trans: ColumnLike, threshold: int = 5) -> Column:
    """False when the translation must be asked for again."""
    source = strip_artifacts(F.coalesce(col(src), F.lit("")), "chat")
    result = clean_watermark_lines(strip_artifacts(F.coalesce(col(trans), F.lit("")), "chat"), variant="chat")
    return let(result, lambda r: (
        F.when(r == L.JOINER, True)
        .when(F.lower(source) == strip(F.lower(r)), True)
        .when(is_watermark(source, "chat") & (r == ""), True)
        .when(needs_retry(r), False)
        .otherwise(~is_repetitive(r, threshold))))


def rejection_reason(src: ColumnLike, trans: ColumnLike, user_pattern: str | None = None) -> Column:
    """Why a translated segment is dropped; null when it stays."""
    src, trans = col(src), col(trans)
    out = F.when(is_blank(trans), "blank").when(trans.rlike(r"\A\p{N}+\z"), "numeric")
    if user_pattern:
        out = out.when(trans.rlike(user_pattern), "filter_text")
    return out.when(strip(F.lower(src)) == strip(F.lower(trans)), "same_as_source")


def skipped_before_translation(
    text: ColumnLike, lang: ColumnLike, target: str, min_length: int = 0, keep_target_language: bool = False
) -> Column:
    """Why an OCR text is not worth translating; null when it is."""
    text = col(text)
    out = F.when(is_blank(text), "empty").when(F.length(strip(text)) < min_length, "short").when(
        ~text.rlike(r"(?U)[\p{L}\p{N}]"), "no_content")
    return out if keep_target_language else out.when(F.lower(col(lang)) == target.lower(), "target_language")


def language_not_skipped(lang: ColumnLike, skip: str) -> Column:
    """``skip`` is a comma list; rows of unknown language stay."""
    names = [s.strip().upper() for s in skip.split(",")]
    return ~F.coalesce(F.upper(col(lang)).isin(*names), F.lit(False))


def http_outcome(status: ColumnLike, content_type: ColumnLike, url: ColumnLike) -> Column:
    """success, skipped (answer is no image), permanent (4xx but 429) or retryable."""
    status, kind = col(status), F.coalesce(col(content_type), F.lit(""))
    is_image = kind.contains("image") | is_image_url(url)
    return (
        F.when(status.isNull() | (status == 429), "retryable")
        .when(status.between(400, 499), "permanent")
        .when(status >= 500, "retryable")
        .when(~is_image, "skipped").otherwise("success")
    )


def clamp(value: ColumnLike, low: float, high: float, default: float | None = None, kind: str = "double") -> Column:
    """Bounded number; an unreadable one becomes ``default`` (null = reject)."""
    number = F.least(F.greatest(col(value).try_cast(kind), F.lit(low).cast(kind)), F.lit(high).cast(kind))
    return number if default is None else F.coalesce(number, F.lit(default).cast(kind))


def host_is(host: ColumnLike, domains: Sequence[str]) -> Column:
    """Host equals one of the domains or lies below it."""
    host = F.coalesce(F.lower(col(host)), F.lit(""))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out
