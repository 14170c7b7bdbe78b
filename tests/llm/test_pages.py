"""URL filter and WARC archives against brute force, and on their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
import zstandard

from pyspark.sql import functions as F

from pageloom.llm import url_filter, warc


def brute_verdict(url, rules):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for rule_host, rule_path, verdict in rules:
        rule_host = rule_host.lower()
        if rule_host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            best = max(best or (-1,), (len(rule_host + rule_path), len(rule_host), verdict, rule_host + rule_path))
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_verdicts_of_nested_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "xa.com", "net", "a.net", ""]
    paths = ["/", "/x", "/x/", "/x/y", "/x/y/z", "/xé", ""]
    rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)]
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM/x/y?q#f", "http://a.com:80/x", "x://a.com#f", "http://b.a.com", "http://c.b.a.com/x/y/z/w\n?"]
    urls += [f"http://{rng.choice(['www.', '', 'b.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.randrange(9)}" for _ in range(400)]
    urls += ["http://a.com/x/1"] * 50
    pages = spark.createDataFrame([(i if i % 7 else None, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, host int, rule int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = url_filter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [(i if i % 7 else None, *brute_verdict(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.judged(pages, rules).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_filter.judged(pages.limit(0), rules).count() == 0


def test_archives_round_trip(spark):
    long = "<html>" + "é" * 300_000
    rows = [(3, "http://a/b c\r\nX: y%20", "x" * 100), (1, None, "x" * 100), (2, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (None, "u", "x" * 100), (7, "u", long), (8, "v", long),
            (1, "again", "x" * 100), (9, "u", "")] + [(100 + i, f"http://h/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(500)]
    pages = spark.createDataFrame([(*r, 0, "") for r in rows], "page_id long, url string, html string, payload int, digest string").repartition(5)
    archives = warc.write_archives(pages, warc.archive_folder(spark), archive_bytes=1 << 12)
    got = warc.read_archives(archives).collect()
    assert archives.count() >= 5 and not [r for r in got if r.problem]
    # small addresses of large archives: as many reading tasks as archives
    read = warc.read_archives(archives).withColumn("task", F.spark_partition_id()).select("archive", "task").distinct().collect()
    assert len({r.task for r in read}) > archives.count() / 2 and len(read) == archives.count()
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, url, html in rows:
        body = (html or "").encode()
        refers = first[html] if len(body) >= 100 and first.get(html, i) != i else None
        want.append((i, url, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", refers, None if refers is not None else body))
    assert sorted(map(repr, want)) == sorted(repr((r.record_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                                                   bytes(r.payload) if r.payload is not None else None)) for r in got)


def test_no_pages_no_archives(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, warc.archive_folder(spark))).count() == 0


def test_faults_are_told(spark, tmp_path):
    good = warc.record_bytes(1, "u", b"p" * 50, hashlib.sha256(b"p" * 50).hexdigest(), None)
    bad = {"digest": good.replace(b"ppp", b"qqq", 1), "length": good.replace(b"Content-Length: ", b"Content-Length: 9", 1), "version": b"X" + good, "date": good.replace(b"WARC-Date", b"Other"),
           "ending": good[:-1] + b"x", "revisit": warc.record_bytes(1, "u", b"", "0", 3).replace(b"WARC-Refers-To", b"Other")}
    for name, record in bad.items():
        assert warc.parse_record(record)["problem"], name
    assert warc.parse_record(good)["problem"] is None
    content = zstandard.ZstdCompressionDict(b"WARC/1.1 " * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = zstandard.ZstdCompressor(dict_data=content).compress(good)
    head = warc.struct.pack("<II", warc.SKIPPABLE, len(content.as_bytes())) + content.as_bytes()
    for name, data, records in (("whole", head + frame * 2, 2), ("cut", head + frame + frame[:-9], 1), ("headless", frame, 0), ("empty", b"", 0)):
        (tmp_path / f"{name}.warc.zst").write_bytes(data)
        archives = spark.createDataFrame([(f"file://{tmp_path}/{name}.warc.zst",)], "archive string")
        rows = warc.read_archives(archives).orderBy("position").collect()
        assert sum(r.problem is None for r in rows) == records and (len(rows) == records) == (name == "whole"), name


@pytest.mark.parametrize("records", [1, 3, 500])
def test_dictionary_comes_first(tmp_path, records):
    archive = warc._Archive(f"file://{tmp_path}/a")
    data = [warc.record_bytes(i, f"u{i}", b"text %d" % i, "0", None) for i in range(records)]
    for d in data:
        archive.add(d)
    uri, n, size = archive.close()
    with open(uri.removeprefix("file://"), "rb") as f:
        assert list(warc.frames(f)) == data and n == records
    assert pa.fs.FileSystem.from_uri(uri)[0].get_file_info(uri.removeprefix("file://")).size == size
