"""Pieces of DuckDB SQL the oracles share (a second, independent wording of the text rules)."""

from __future__ import annotations

from functools import reduce

from pageloom.functions import lexicon as L

WS = "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)" \
     "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)" \
     "||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288))"
WS_RE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EOL_RE = r"\r\n|[\n\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
HAN_RE = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
JA_RE = r"[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
WORDISH = r"\p{L}\p{M}\p{N}_"
MARKS = L.VIETNAMESE_MARKS + L.VIETNAMESE_MARKS.upper()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))::bigint"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def replace_all(x: str, pairs) -> str:
    return reduce(lambda acc, p: f"replace({acc}, {q(p[0])}, {q(p[1])})", pairs, x)


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {q(EOL_RE)}), lambda a: {trim('a')}), lambda a: a <> '')"


def compact(x: str) -> str:
    return sub(f"lower({x})", "[^a-z0-9._:/-]")


def watermark(x: str, variant: str = "chat") -> str:
    c = compact(x)
    domain = r"[a-z0-9][a-z0-9._-]{1,64}\.(com|net|org|info|xyz|top|site|online|tv|cc)\b"
    if variant == "ocr":
        url = rf"(?i)(^|[^{WORDISH}])(https?://)?(www\.)?[A-Za-z0-9._-]+\.(com|net|org|info|xyz|top|site|online|tv|cc)([^{WORDISH}]|$)"
        tests = [f"contains({c}, '.com')", f"{c} like '%com'", has(c, r"\bacg\b"), has(x, url)]
        return f"coalesce(length({trim(x)}) >= 3 and ({' or '.join(tests)}), false)"
    words = {
        "common": "acg|pixiv|twitter|fanbox|patreon|x\\.com|18cg|http|www|com|net|org|pix",
        "translate": "acg|\\.com|www\\.|http://|https://",
        "chat": "acg|pixiv|twitter|weibo|fanbox|fansky|patreon|fantia|danbooru|dlsite|bilibili|18cg|http|www|pix"
                "|\\.com|\\.net|\\.org|p[i1l]x[i1l]v",
        "render": "acg|pixiv|twitter|weibo|fanbox|patreon|18cg|http|www|com|net|org|fantia|danbooru|dlsite|bilibili"
                  "|pix|p[i1l]x[i1l]v",
    }[variant]
    extra = f" or {has(c, domain)}" if variant in ("common", "translate") else ""
    return f"coalesce({has(c, words)} or {c} like '%com'{extra}, false)"


def artifacts(x: str, variant: str = "translate", keep_markers: bool = False) -> str:
    think = "(?is)</think>.*?</think>" if variant == "common" else "(?is)<think>.*?</think>"
    roles = "assistant|user|system|im_start|im_end|eot_id|end_of_text|endoftext|begin_of_text|bos|eos|pad|unk"
    x = sub(x, think)
    x = sub(x, r"</\|\d+\|>?")
    x = sub(x, rf"(?i)<\|({roles})\|>")
    x = sub(x, r"(?i)</?(s|bos|eos|pad|unk)>")
    x = sub(x, r"(?i)\[/?INST\]|<<SYS>>|<</SYS>>")
    x = sub(x, r"</([^a-zA-Z]|$)", r"\1")
    if not keep_markers:
        x = sub(x, r"<\|\d+\|>?")
        if variant == "chat":
            x = f"replace({x}, '|', '')"
    return trim(sub(sub(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def clean_marks(x: str, variant: str = "translate", source: str | None = None) -> str:
    kept = f"list_filter({lines('_c')}, lambda b: not {watermark('b', variant)})"
    src = "" if source is None or variant == "chat" else f" or {watermark(source, variant)}"
    last = watermark("_c" if variant == "translate" else x, variant)
    body = f"case when len({kept}) > 0 then array_to_string({kept}, chr(10)) when {last}{src} then '' else _c end"
    return f"case when {trim(x)} = '' then {x} else (select {body} from (select {artifacts(x, variant)} as _c)) end"


def needs_retry(x: str, variant: str = "chat") -> str:
    foreign = HAN_RE if variant == "chat" else JA_RE
    word = rf"(^|[^{WORDISH}])[a-zA-Z]{{3,}}($|[^{WORDISH}])"
    # neighbouring words share their separator, so count over a text with doubled separators
    doubled = sub("_r", rf"([^{WORDISH}])", r"\1\1")
    body = (f"case when length({trim('_r')}) < 4 then false when {has('_r', foreign)} then true"
            f" when {has('_r', '[' + MARKS + ']')} then false else {count(doubled, word)} >= 2 end")
    return f"(select {body} from (select {clean_marks(artifacts(x, variant), variant)} as _r))"


def terminal(x: str) -> str:
    core = f"rtrim(_t, {q(L.TRAILING_CLOSERS)})"
    body = (f"case when _t = '' or _t = chr(8205) then {x} when {core} = '' or contains({q(L.TERMINAL_PUNCTUATION)}, right({core}, 1))"
            f" then _t else {core} || '.' || substr(_t, length({core}) + 1) end")
    return f"(select {body} from (select rtrim({x}, {WS}) as _t))"


def retag(x: str) -> str:
    return sub(x, r"(?i)^\s*\[\s*(speech|thought|moan|shout|narration|sfx|anger|fear|title)\s*\]\s*")


def empty(x: str) -> str:
    t = retag(trim(x))
    return f"({t} = chr(8205) or not {has(t, '[' + WORDISH.replace(chr(92) + 'p{M}', '') + ']')})"


def path_of(url: str) -> str:
    return f"regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)', 3)"


def is_image(url: str) -> str:
    return has(f"lower({path_of(url)})", r"\.(jpg|jpeg|png|gif|webp|bmp|svg|avif)$")


def sanitize(x: str) -> str:
    cleaned = f"""left(trim(regexp_replace(url_decode(replace({x}, '+', '%2B')), '[\\\\/:*?"<>|]', '_', 'g'), '. '), 200)"""
    return f"coalesce(nullif({cleaned}, ''), 'image')"


def file_name(url: str, idx: str) -> str:
    base = f"regexp_extract({path_of(url)}, '[^/]*$')"
    made = f"'image_' || case when {idx} > 9999 then {idx}::varchar else lpad({idx}::varchar, 4, '0') end || '_' || left(md5({url}), 8) || '.jpg'"
    return f"case when contains({base}, '.') then {sanitize(base)} else {made} end"


def json_text(x: str) -> str:
    return x
