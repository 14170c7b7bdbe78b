"""Worked examples with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageloom.functions import geometry, html, parsing, predicates, text, urls
from pageloom.operators import terms
from pageloom.operators.extract import extract_media_urls
from pageloom.plans.listing import common_prefix
from pageloom.sources import glossary


def value(spark, column, **cells):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()])
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("source, wanted", [("结母", "结丹"), ("非常好oooo那", "非常好……那"), ("gxracg.com", "gxracg.com"), ("oo夫人吧oo", "……夫人吧……"), ("cool", "cool")])
def test_source_repairs(spark, source, wanted):
    assert value(spark, text.fix_ocr_source("t"), t=source) == wanted


@pytest.mark.parametrize("mark", ["PIX1V:fh8di", "wwwfansky", "gx racg", "a.COM"])
def test_site_marks(spark, mark):
    assert value(spark, text.is_watermark("t", "chat"), t=mark)


def test_mark_variants_differ(spark):
    hits = {v: value(spark, text.is_watermark("t", v), t="welcome home") for v in ("common", "translate", "ocr", "chat", "render")}
    assert hits == {"common": True, "translate": False, "ocr": False, "chat": False, "render": True}


def test_two_letters_with_an_ascii_lower_case(spark):
    assert value(spark, text.mark_compact("t"), t="ıPİxıv Kelvin K") == "pixvkelvink"


def test_decor(spark):
    assert value(spark, predicates.is_decor("t"), t="BALENCIAGA")
    assert not value(spark, predicates.is_decor("t"), t="你好")
    assert not value(spark, predicates.is_decor("t"), t="x.com")


@pytest.mark.parametrize("sample", ["[]", "[.]", "【】", "...", "··", "[speech] ", "‍"])
def test_nothing_said(spark, sample):
    assert value(spark, predicates.effectively_empty("t"), t=sample)


@pytest.mark.parametrize("sample, unit", [("abcabca", "abc"), ("aaaa", "a"), ("abc", "abc"), ("", ""), ("a", "a")])
def test_repeat_unit(spark, sample, unit):
    assert value(spark, text.repeat_unit("t"), t=sample) == unit


def test_list_breaks(spark):
    got = value(spark, text.list_breaks("t"), t="2.5 kg 1. một 2. hai lúc 10:30 đi")
    assert got == "2.5 kg\n1. một\n2. hai lúc 10:30 đi"


@pytest.mark.parametrize("path, root", [("F:/C/x/original/chap01", "F:/C/x"), ("F:/C/x/Original", "F:/C/x"), ("/a/b/c", "/a/b"), ("/original/a/original/b", "/original/a")])
def test_series_root(spark, path, root):
    assert value(spark, urls.series_root("p"), p=path) == root


def test_markers_are_repaired(spark):
    assert value(spark, text.split_markers("t"), t="noise <|1|>một<|2>hai <3|>ba") == ["một", "hai ", "ba"]
    assert value(spark, text.split_markers("t"), t="chỉ một") == ["chỉ một"]


def test_yes_no_reply(spark):
    assert value(spark, parsing.yes_numbers("t"), t="1: YES\n2: NO\n3: NO") == [1]
    assert value(spark, parsing.yes_numbers("t"), t="1: NO\n1: YES\n2) yes") == [2]


def test_learnable_terms(spark):
    rows = spark.createDataFrame([("G级", "cấp G"), ("王", "Vương"), ("妈妈", "mẹ"), ("abc", "x"), ("青云", "Thanh Vân")], "zh string, vi string")
    assert {r.zh for r in terms.learnable_terms(rows).collect()} == {"G级", "青云"}


def test_prefix_is_cut_back_to_a_blank(spark):
    rows = spark.createDataFrame([("[f] 魔头 16",), ("[f] 魔头 17",)], "t string")
    got = rows.agg(common_prefix("t").alias("a"), common_prefix("t", True).alias("b")).first()
    assert (got.a, got.b) == ("[f] 魔头 1", "[f] 魔头 ")
    assert rows.limit(1).agg(common_prefix("t", True).alias("b")).first().b == ""


def test_natural_order(spark):
    names = ["chap10", "Chap2", "chap1", "chap1a", "10", "9"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(urls.natural_key("n"))
    assert [r.n for r in rows.collect()] == ["9", "10", "chap1", "chap1a", "Chap2", "chap10"]


def test_glossary_lines(spark):
    lines = ["# c", "", " 李雷 => Lý Lôi ", "@NOTE: xưng ta", "王 => Vương @keep", "王 => khác", "我 => tôi", "青云宗=>Thanh Vân Tông", "no arrow", "李雷 => hai"]
    rows = spark.createDataFrame([("s", i, line) for i, line in enumerate(lines)], glossary.LINE_FILE)
    got = {(r.zh, r.vi) for r in glossary.glossary_terms(rows).collect()}
    assert got == {("李雷", "Lý Lôi"), ("王", "Vương"), ("青云宗", "Thanh Vân Tông")}
    assert [r.note for r in glossary.glossary_notes(rows).collect()] == ["xưng ta"]
    assert len(glossary.glossary_pairs(rows).collect()) == 6


def test_bad_json_is_no_error(spark):
    assert value(spark, parsing.page_boxes("t", F.lit(10), F.lit(10)), t="no list") == []
    assert value(spark, parsing.page_boxes("t", F.lit(10), F.lit(10)), t="[{'bbox': [1,2,3,4]}]") == []
    assert value(spark, parsing.sources_array("t"), t='{"a": 1}') == []
    assert value(spark, geometry.pixel_box("b", F.lit(100), F.lit(100)), b=["x", "1", "2", "3"]) is None


def test_reply_texts(spark):
    raw = 'Sure: ["một", {"note": "n", "translation": "hai chu"}, {"other": "ba"}, 4] end'
    assert value(spark, parsing.reply_texts("t", F.lit(4)), t=raw) == ["một", "hai chủ", "ba", "4"]
    assert value(spark, parsing.reply_texts("t", F.lit(3)), t=raw) is None


def test_media_of_an_awkward_page(spark):
    page = """<!-- <img src="no.png"> --><IMG alt="a > b" SRC='/a.png'><img src=b.jpg data-src="b.jpg?x&amp;y"><source type="image/x" src="raw">
    <script>if (a<b) document.write("<img src='skip.gif'>"); var i = {"images": ["c.gif", "d.txt"]}; u = "https://z.com/q.JPG"</script>
    <style>p{background:url(s.png)}</style><img srcset="e.webp 1x, f.webp 2x, data:image/png;base64,AA 3x" src=" ">"""
    rows = spark.createDataFrame([(1, "https://x.com/p/q?z=1", page)], "page_id long, url string, html string")
    got = [r.url for r in extract_media_urls(rows).orderBy("ord").collect()]
    at = "https://x.com/p/"
    assert got == ["https://x.com/a.png", at + "b.jpg", at + "b.jpg?x&y", at + "raw", at + "e.webp", at + "f.webp", at + "c.gif", "https://z.com/q.JPG"]


def test_inner_text(spark):
    assert value(spark, html.inner_text("t"), t="<a href='x'> One <b>two&amp;</b>\n</a>") == "One two&"


def test_terminal_punctuation(spark):
    cases = {"Xin chào": "Xin chào.", "「Xin chào」": "「Xin chào.」", "「Xin!」": "「Xin!」", "…": "…", "  ": "  ", "」": "」", "‍": "‍"}
    for before, after in cases.items():
        assert value(spark, text.ensure_terminal_punct("t"), t=before) == after


def test_names(spark):
    assert value(spark, urls.sanitize_name("t"), t="a%2Fb:c%zz+d. ") == "a_b_c%zz+d"
    assert value(spark, urls.sanitize_name("t"), t=". .") == "image"
    assert value(spark, urls.url_filename("t", F.lit(12345)), t="https://x/y") == "image_12345_" + __import__("hashlib").md5(b"https://x/y").hexdigest()[:8] + ".jpg"


def test_listing_reads_a_backslash_as_itself(spark):
    from pageloom.operators.terms import list_terms

    store = spark.createDataFrame([(1, "a\\z", "x", True), (2, "a%z", "x", True), (3, "az", "x", True)], "term_id long, zh string, vi string, enabled boolean").withColumns(
        {"updated": F.lit(None).cast("timestamp"), "created": F.current_timestamp()})
    assert [r.term_id for r in list_terms(store, "a\\").collect()] == [1]
    assert {r.term_id for r in list_terms(store, "a_z").collect()} == {1, 2}


def test_failed_attempts_say_why(spark):
    from pageloom.plans.downloads import resolve_attempts

    rows = [(1, "u", 0, "", "", n, None, None, f"timed out {n}") for n in range(4)] + [(1, "v", 0, "", "", 0, 404, None, None)]
    attempts = spark.createDataFrame(rows, "run_id long, url string, idx long, folder string, referer string, attempt_no int, http_status int, content_type string, error string")
    got = {r.url: (r.outcome, r.error) for r in resolve_attempts(attempts).collect()}
    assert got == {"u": ("failed", "timed out 3"), "v": ("failed", "HTTP 404")}
    assert {r.url: r.error for r in resolve_attempts(attempts.drop("error")).collect()} == {"u": None, "v": "HTTP 404"}


def test_view_and_frame_agree_on_escapes(spark):
    from pageloom.operators.extract import extract_media_urls
    from pageloom.operators.extract import register_media_view

    html = """<img data-src='b&quot;.png'><script>{"images": ["https:\\/\\/h.x\\/p\\/1.jpg", 7, "c.png"]}</script><img src=c.png>"""
    pages = spark.createDataFrame([(1, "https://h.x/a/", html)], "page_id long, url string, html string")
    pages.createOrReplaceTempView("escaped_pages")
    register_media_view(spark, "escaped_pages")
    by_sql = [r.url for r in spark.sql("select ord, url from explode_media order by ord").collect()]
    assert by_sql == [r.url for r in extract_media_urls(pages).orderBy("ord").collect()] and "https://h.x/p/1.jpg" in by_sql
