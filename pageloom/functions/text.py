"""Column builders for cleaning segments and replies.

Each builder takes a column (or its name) and returns one Column. Inside a
builder ``let`` names an intermediate value so that it is computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: ColumnLike, chars: str = L.WHITESPACE) -> Column:
    """Trim both ends; the default set is all Unicode white space, not only blanks."""
    return F.trim(col(text), F.lit(chars))


def rstrip(text: ColumnLike, chars: str = L.WHITESPACE) -> Column:
    return F.rtrim(col(text), F.lit(chars))


def lstrip(text: ColumnLike, chars: str = L.WHITESPACE) -> Column:
    return F.ltrim(col(text), F.lit(chars))


def is_blank(text: ColumnLike) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def running_sums(values: Column, block: int = 32, levels: int = 3) -> Column:
    """Sums of an array of integers up to each place. A place adds up its block's start; what the blocks before it hold is found the same
    way from their totals. Nothing that is built grows with every step."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def direct(part: Column, before: Column) -> Column:
        return F.transform(part, lambda x, i: before + total(F.slice(part, F.lit(1), i + 1)))

    if levels == 1:
        return direct(values, F.lit(0))

    def over(blocks: Column) -> Column:
        upto = let(F.transform(blocks, total), lambda ts: running_sums(ts, block, levels - 1))
        return let(upto, lambda us: F.flatten(F.transform(blocks, lambda part, k: let(F.coalesce(F.get(us, k - 1), F.lit(0)), lambda b: direct(part, b)))))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block))
    return let(F.transform(starts, lambda s: F.slice(values, s, F.lit(block))), over)


def swap(text: ColumnLike, old: str, new: str) -> Column:
    return F.replace(col(text), F.lit(old), F.lit(new))


def swap_all(text: ColumnLike, pairs: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda acc, pair: swap(acc, *pair), pairs, col(text))


def resub(text: ColumnLike, steps: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda acc, step: F.regexp_replace(acc, step[0], step[1]), steps, col(text))


def resub_if(text: ColumnLike, signs: Sequence[str], steps: Iterable[tuple[str, str]]) -> Column:
    """The same for patterns that need one of ``signs``: a text that has none is searched for these only, not once for each pattern."""
    def rewrite(t: Column) -> Column:
        return F.when(reduce(lambda acc, sign: acc | t.contains(sign), signs[1:], t.contains(signs[0])), resub(t, steps)).otherwise(t)

    return let(col(text), rewrite)


def matches(text: ColumnLike, pattern: str) -> Column:
    return col(text).rlike(pattern)


def pattern_count(text: ColumnLike, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern)).cast("bigint")


def literal_count(text: ColumnLike, needle: Column | str) -> Column:
    """Number of non-overlapping occurrences of a non-empty string."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    text = col(text)
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return (gone / F.length(needle)).cast("bigint")


def text_lines(text: ColumnLike) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(col(text), L.LINE_ENDS), lambda line: strip(line)), lambda line: line != "")


def chars(text: ColumnLike) -> Column:
    return F.filter(F.split(col(text), ""), lambda c: c != "")


# ---------------------------------------------------------------- cleaning


def strip_artifacts(text: ColumnLike, variant: str = "translate", keep_markers: bool = False) -> Column:
    """Delete generation leftovers. ``common`` keeps its malformed thought tag, ``chat`` also drops ``|``."""
    steps = [(L.ARTIFACT_THOUGHT[variant], "")] + list(L.ARTIFACT_STEPS)
    if not keep_markers:
        steps.append((L.ARTIFACT_MARKER, ""))
    out = resub_if(text, ("<", "["), steps)
    if not keep_markers and variant == "chat":
        out = swap(out, "|", "")
    for signs, step in L.ARTIFACT_TAIL:
        out = resub_if(out, signs, [step])
    return strip(out)


def mark_compact(text: ColumnLike) -> Column:
    """Lower-case, without white space, only the characters an address can hold.

    Everything else goes first, so that lower-casing meets short ASCII text; the two other letters
    whose lower case is an ASCII letter stay until then.
    """
    kept = F.lower(F.regexp_replace(col(text), r"(?i)[^a-z0-9._:/\-\u0130\u212a]+", ""))
    return let(kept, lambda k: F.when(k.rlike(r"[^\x00-\x7f]"), F.regexp_replace(k, r"[^\x00-\x7f]+", "")).otherwise(k))


def is_watermark(text: ColumnLike, variant: str = "chat") -> Column:
    """Does the text look like a site mark? The five variants use different word lists."""
    text = col(text)
    if variant == "ocr":
        test = lambda c: (
            c.contains(".com") | c.endswith("com") | c.rlike(r"\bacg\b") | (text.rlike(L.MARK_ENDING) & text.rlike(L.MARK_URL))
        )
        return F.coalesce((F.length(strip(text)) >= 3) & let(mark_compact(text), test), F.lit(False))
    words = L.MARK_WORDS[variant]

    def test(c: Column) -> Column:
        hit = reduce(lambda acc, w: acc | c.contains(w), words[1:], c.contains(words[0])) | c.endswith("com")
        if variant in ("common", "translate"):
            hit = hit | c.rlike(L.MARK_DOMAIN)
        if variant in ("chat", "render"):
            hit = hit | c.rlike(L.MARK_PIXIV)
        return hit

    return F.coalesce(let(mark_compact(text), test), F.lit(False))


def clean_watermark_lines(text: ColumnLike, source: ColumnLike | None = None, variant: str = "translate") -> Column:
    """Drop the lines that are site marks; a text made of nothing else becomes empty."""
    return let(col(text), lambda raw: _without_mark_lines(raw, source, variant))


def _without_mark_lines(raw: Column, source: ColumnLike | None, variant: str) -> Column:
    # the chat form re-tests the raw text, the other two the source as well
    src_hit = F.lit(False) if source is None or variant == "chat" else is_watermark(source, variant)

    def keep(clean: Column) -> Column:
        lines = text_lines(clean)
        kept = F.filter(lines, lambda line: ~is_watermark(line, variant))
        none_left = F.when(is_watermark(clean if variant == "translate" else raw, variant) | src_hit, "").otherwise(clean)
        return let(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, "\n")).otherwise(none_left))

    return F.when(is_blank(raw), raw).otherwise(let(strip_artifacts(raw, variant), keep))


def normalize_newlines(text: ColumnLike, variant: str = "translate") -> Column:
    """Turn written-out line ends into real ones and glue very short lines to an unfinished one."""
    plain = swap_all(strip_artifacts(text, variant), [(e, "\n") for e in L.ESCAPED_LINE_ENDS])

    def glue(lines: Column) -> Column:
        # a glued line ends like the line itself, so a line and the one before it decide
        def piece(line: Column, i: Column) -> Column:
            short = strip(line)
            joins = (short != "") & (F.length(short) <= 2) & ~F.get(lines, i - 1).rlike(L.GLUE_STOP)
            return F.when(i == 0, line).when(joins, short).otherwise(F.concat(F.lit("\n"), line))

        return F.array_join(F.transform(lines, piece), "")

    def whole(t: Column) -> Column:
        # A closing line end starts no further line.
        parts = F.transform(F.split(F.regexp_replace(t, f"(?:{L.LINE_END})\\z", ""), L.LINE_END), lambda line: rstrip(line))
        return let(parts, lambda p: F.when(F.size(p) > 1, glue(p)).otherwise(t))

    return let(plain, whole)


def fix_vi_spelling(text: ColumnLike) -> Column:
    return resub(text, [(rf"(?iu)\b{wrong}\b", right) for wrong, right in L.SPELLING_FIXES])


def relationship(text: ColumnLike, lang: str = "zh") -> Column:
    """First relationship whose hints occur: parent_child, romantic, school, else null."""
    text = col(text)
    out = None
    for name, pattern in L.RELATIONSHIPS[lang]:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out


def apply_pronouns(text: ColumnLike, relation: ColumnLike) -> Column:
    text = col(text)
    changed = resub(text, [(rf"(?iU)\b{word}\b", "con") for word in L.PARENT_CHILD_PRONOUNS])
    return F.when((col(relation) == "parent_child") & ~is_blank(text), changed).otherwise(text)


def fix_pronoun_patterns(text: ColumnLike) -> Column:
    return F.regexp_replace(col(text), *L.PRONOUN_PHRASE)


def drop_honorifics(text: ColumnLike) -> Column:
    return resub(text, [(rf"(?U)\b({word})\b", "") for word in L.HONORIFICS])


def map_onomatopoeia(text: ColumnLike, lang: str = "zh") -> Column:
    return swap_all(text, L.LAUGHTER if lang == "zh" else L.SOUND_WORDS_JA)


def fix_ocr_source(text: ColumnLike) -> Column:
    return F.regexp_replace(swap_all(text, L.OCR_REPAIRS), L.OCR_ELLIPSIS, "……")


def fix_closed_vocab(src: ColumnLike, trans: ColumnLike, vocab: Sequence[tuple[str, str]] = L.REALMS) -> Column:
    """For every vocabulary term of the source whose name is missing, replace the first foreign name."""
    src, trans = col(src), col(trans)
    entry = "struct<term string, name string>"
    table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(n).alias("name")) for t, n in vocab]).cast(f"array<{entry}>")

    def fold(present: Column) -> Column:
        valid = F.transform(present, lambda e: e["name"])
        foreign = F.filter(table, lambda e: ~F.array_contains(valid, e["name"]))

        def step(out: Column, want: Column) -> Column:
            wrong = F.get(F.filter(foreign, lambda e: F.lower(out).contains(F.lower(e["name"]))), F.lit(0))["name"]
            at = F.position(F.lower(wrong), F.lower(out))
            fixed = F.concat(F.substring(out, F.lit(1), at - 1), want["name"],
                             F.substring(out, at + F.length(wrong), F.length(out)))
            return F.when(F.lower(out).contains(F.lower(want["name"])) | wrong.isNull(), out).otherwise(fixed)

        return F.aggregate(present, trans, step)

    return let(F.filter(table, lambda e: src.contains(e["term"])), fold)


def apply_rules(text: ColumnLike, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered regular-expression rewrites (a short list, known when the plan is built)."""
    return resub(text, rules)


def repair_brackets(text: ColumnLike) -> Column:
    """Delete unpaired brackets, then make every closer fit its opener.

    A mark that can both open and close always opens, so plain quotes never
    close anything and disappear.
    """
    openers = F.lit("".join(o for o, _ in L.BRACKETS))
    closers = F.lit("".join(c for _, c in L.BRACKETS if c not in {o for o, _ in L.BRACKETS}))
    fits = F.lit("".join(c for _, c in L.BRACKETS))
    marks = list(dict.fromkeys(m for pair in L.BRACKETS for m in pair))
    near, far = [m for m in marks if m < "\u0100"], [m for m in marks if m >= "\u0100"]
    # ordinary letters are turned away by the first class and the range test
    every = "(?:[" + "".join("\\" + m for m in near) + "]|[\u2000-\uffff&&[" + "".join(far) + "]])"

    def fitting(opener: Column) -> Column:
        return F.substring(fits, F.position(opener, openers), F.lit(1))

    def rebuild(parts: Column) -> Column:
        # parts alternate: text before a bracket, the bracket, text ...
        marks = F.filter(parts, lambda p, i: i % 2 == 1)
        steps = let(marks, lambda ms: F.transform(ms, lambda m: F.when(F.position(m, openers) > 0, 1).when(F.position(m, closers) > 0, -1).otherwise(0)))
        depths = let(steps, lambda s: running_sums(s))

        def paired(ms: Column, ds: Column) -> Column:
            # an opener's level is the depth it opens, a closer's the one it closes; in the order of level and place a pair stands together
            def event(m: Column, i: Column) -> Column:
                opens = F.position(m, openers) > 0
                return F.struct(F.when(opens, F.get(ds, i)).otherwise(F.get(ds, i) + 1).alias("level"), i.alias("at"), opens.alias("opens"), m.alias("mark"))

            # other marks of the list neither open nor close
            events = F.array_sort(F.filter(F.transform(ms, event), lambda e: e["opens"] | (F.position(e["mark"], closers) > 0)))

            def keep(es: Column) -> Column:
                def one(e: Column, i: Column) -> Column:
                    before, after = F.get(es, i - 1), F.get(es, i + 1)
                    closed = e["opens"] & (after["level"] == e["level"]) & ~after["opens"]
                    closes = ~e["opens"] & (i > 0) & (before["level"] == e["level"]) & before["opens"]
                    return F.struct(e["at"].alias("at"), F.when(closed, e["mark"]).when(closes, fitting(before["mark"])).otherwise("").alias("mark"))

                return F.array_sort(F.transform(es, one))

            return let(events, keep)

        def fill(fixed: Column) -> Column:
            return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(
                F.coalesce(F.get(fixed, F.floor((i - 1) / 2).cast("int"))["mark"], F.lit("")))), "")

        return let(let(marks, lambda ms: let(depths, lambda ds: paired(ms, ds))), fill)

    text = col(text)
    sep = "\x00"
    cut = F.split(F.regexp_replace(strip(text), f"({every})", f"{sep}$1{sep}"), sep)
    return F.when(strip(text).rlike(every), strip(let(cut, rebuild))).otherwise(strip(text))


def harmonise_quotes(src: ColumnLike, trans: ColumnLike) -> Column:
    """Give the translation the quote and bracket style of its source when the counts agree."""
    src = col(src)
    styles = [(s, (src.contains(s[0]) & src.contains(s[1]))) for s in L.QUOTE_STYLES]

    def restyle(out: Column) -> Column:
        not_ascii = ~out.rlike(r"\A[\x00-\x7f]*\z")
        result = None
        for style, present in styles:
            n = literal_count(src, style[0])
            agree = (n == literal_count(out, '"')) | (n == literal_count(out, "＂"))
            fixed = F.regexp_replace(out, r'"([^"]*)"', f"{style[0]}$1{style[1]}")
            value = F.when(agree & not_ascii, fixed).otherwise(out)
            result = F.when(present, value) if result is None else result.when(present, value)
        return result.otherwise(out)

    def family(marks: str) -> Callable[[Column], Column]:
        def apply(out: Column) -> Column:
            n = literal_count(src, marks[0])
            others = pattern_count(src, "[" + "".join("\\" + m for m in marks[1:]) + "]")
            seen = pattern_count(out, "[" + "".join("\\" + m for m in marks) + "]")
            same = (n > 0) & (n != others) & (n == seen)
            return F.when(same, swap_all(out, [(m, marks[0]) for m in marks[1:]])).otherwise(out)

        return apply

    out = let(col(trans), restyle)
    for marks in L.QUOTE_FAMILIES:
        out = let(out, family(marks))
    return swap_all(out, L.QUOTE_FORCED)


# ---------------------------------------------------------------- replies and tags


def split_markers(reply: ColumnLike) -> Column:
    """Numbered reply -> array of texts; without any marker the whole reply is the only one."""
    fixed = swap_all(F.regexp_replace(col(reply), L.MARKER_ANY, "<|$1|>"), [(e, "\n") for e in L.ESCAPED_LINE_ENDS])

    def cut(t: Column) -> Column:
        parts = F.split(F.concat(F.lit("pre_1\n"), t), L.MARKER_SPLIT)
        return let(parts, lambda p: F.when(F.size(p) > 1, F.slice(p, F.lit(2), F.size(p))).otherwise(F.array(t)))

    return let(fixed, cut)


def align_slots(parts: ColumnLike, reply: ColumnLike, expected: ColumnLike) -> Column:
    """Exactly ``expected`` slots: surplus is cut, missing ones are empty; a lone part is re-split by line."""
    n = col(expected).cast("int")

    def fit(p: Column) -> Column:
        return F.slice(F.concat(p, F.array_repeat(F.lit(""), F.greatest(n - F.size(p), F.lit(0)))), F.lit(1), n)

    source = F.when((F.size(col(parts)) <= 1) & (n > 1), F.split(col(reply), "\n")).otherwise(col(parts))
    return let(source, fit)


def kind_tag(text: ColumnLike) -> Column:
    return F.nullif(F.lower(F.regexp_extract(col(text), L.KIND_TAG, 1)), F.lit(""))


def without_kind_tag(text: ColumnLike) -> Column:
    text = col(text)
    return F.when(text.rlike(L.KIND_TAG), lstrip(F.regexp_replace(text, L.KIND_TAG, ""))).otherwise(text)


def strip_outer_quotes(text: ColumnLike) -> Column:
    return strip(strip(strip(text), L.WRAPPING_QUOTES))


def ensure_terminal_punct(text: ColumnLike) -> Column:
    """Put a full stop before the trailing closers unless the text already ends a sentence."""
    text = col(text)

    def close(t: Column) -> Column:
        core = rstrip(t, L.TRAILING_CLOSERS)
        return let(core, lambda c: F.when(
            (c == "") | F.contains(F.lit(L.TERMINAL_PUNCTUATION), F.right(c, F.lit(1))), t
        ).otherwise(F.concat(c, F.lit("."), F.substring(t, F.length(c) + 1, F.length(t)))))

    return let(rstrip(text), lambda t: F.when((t == "") | (t == L.JOINER), text).otherwise(close(t)))


def post_process(trans: ColumnLike, src: ColumnLike, lang: str = "zh") -> Column:
    """Clean, blank site marks, adjust pronouns to the relationship in the source, drop mark lines."""
    trans, src = col(trans), col(src)

    def rest(t: Column) -> Column:
        fixed = clean_watermark_lines(apply_pronouns(t, relationship(src, lang)), src)
        return F.when(is_watermark(t, "translate") | is_watermark(src, "translate"), "").otherwise(fixed)

    return F.when(is_blank(trans), trans).otherwise(let(strip_artifacts(trans), rest))


def comprehensive_post_process(trans: ColumnLike, src: ColumnLike) -> Column:
    trans = col(trans)
    return F.when(is_blank(trans), trans).otherwise(
        clean_watermark_lines(fix_pronoun_patterns(strip_artifacts(trans)), src))


# ---------------------------------------------------------------- small ones


def count_text_length(text: ColumnLike) -> Column:
    """Length after trimming; small kana count half."""
    t = strip(text)
    return F.length(t) - 0.5 * pattern_count(t, L.HALF_WIDTH_KANA)


def list_breaks(text: ColumnLike) -> Column:
    return lstrip(F.regexp_replace(col(text), L.LIST_MARKER, "\n$1 "), "\n")


def repeat_unit(text: ColumnLike) -> Column:
    """Shortest prefix that tiles the text; the text itself when none of at most half its length does.

    With such a prefix the text's first half stands again where the second tile begins; and the first place where it stands again is the
    only one to look at: were it no period but a later one were, both would be periods of the half, and so their common divisor of the text.
    """
    text = col(text)
    n = F.length(text)
    half = F.left(text, F.ceil(n / 2).cast("int"))

    def tile(size: Column) -> Column:
        # text is periodic with this size exactly when it equals itself shifted by it
        found = (size > 0) & (size <= F.floor(n / 2)) & (F.left(text, n - size) == F.right(text, n - size))
        return F.when(found, F.left(text, size)).otherwise(text)

    return F.when(n < 2, text).otherwise(let(F.position(half, text, F.lit(2)) - 1, tile))


def replace_prefix(text: ColumnLike, old: str, new: str) -> Column:
    text = col(text)
    return F.when(text.startswith(old), F.concat(F.lit(new), F.substring(text, len(old) + 1, 2**31 - 1))).otherwise(text)


def apply_case(text: ColumnLike, uppercase: bool = False, lowercase: bool = False) -> Column:
    text = col(text)
    return F.upper(text) if uppercase else F.lower(text) if lowercase else text


def content_key(text: ColumnLike, model: str = "", lang: str = "") -> Column:
    return F.md5(F.concat(col(text), F.lit(f"|{model}|{lang}")))


def thumb_key(path: ColumnLike, mtime: ColumnLike, size: ColumnLike) -> Column:
    return F.sha1(F.concat_ws("|", col(path), col(mtime).cast("string"), col(size).cast("string")))


def hex_color(text: ColumnLike) -> Column:
    """``#rrggbb`` in lower case, or null when it is not six hex digits."""
    body = F.ltrim(strip(F.coalesce(col(text), F.lit(""))), F.lit("#"))
    return F.when(body.rlike(r"\A[0-9a-fA-F]{6}\z"), F.concat(F.lit("#"), F.lower(body)))


def hex_to_rgb(color: ColumnLike) -> Column:
    body = F.ltrim(col(color), F.lit("#"))
    part = lambda at: F.conv(F.substring(body, at, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def capture_groups(text: ColumnLike, pattern: str, groups: int = 1) -> Column:
    """Every group of every match, one per line; null when nothing remains."""
    per_group = [F.regexp_extract_all(col(text), F.lit("(?s)" + pattern), F.lit(g)) for g in range(1, groups + 1)]
    if groups > 1:
        flat = F.flatten(F.transform(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(per_group)]),
                                     lambda z: F.array(*[z[f"g{i}"] for i in range(groups)])))
    else:
        flat = per_group[0]
    return F.nullif(strip(F.array_join(flat, "\n")), F.lit(""))


def dialogue_kind(text: ColumnLike, tag: ColumnLike, shape: ColumnLike, on_bubble: ColumnLike) -> Column:
    """Kind of speech from the text, the tag given by the translator and the container's shape."""
    t, tag, shape = strip(F.coalesce(col(text), F.lit(""))), col(tag), F.coalesce(col(shape), F.lit(""))
    told = F.coalesce(tag, F.lit(""))
    caps = (
        (pattern_count(t, r"\p{L}") >= 2) & (F.length(t) <= 14)
        & ~t.rlike(r"[\p{L}&&[^\p{Lu}]]") & told.isin("", "speech", "shout")
    )
    return (
        F.when(told == "fear", "fear").when(told == "anger", "anger")
        .when(t.rlike(L.SHOUT) | caps | (told == "shout") | (shape == "burst"), "shout")
        .when(told == "moan", "moan").when(told == "sfx", "sfx")
        .when((shape == "rect") | (told == "narration"), "narration")
        .when((shape == "cloud") | (told == "thought"), "thought")
        .when(~col(on_bubble) & (told == "") & (F.length(t) <= 14), "sfx")
        .otherwise("normal")
    )
