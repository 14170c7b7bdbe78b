"""URL filters by a sort-merge range join with a sweep over nested rules.

A rule (host, path) has the canonical key reversed host + path ("com.example/en/"). A URL has one key per domain it lies in
("com/en/25", "com.example/en/25", "com.example.www/en/25"); a rule fits exactly if its key is a prefix of one of them, so rules are
intervals of keys and two of them either nest or do not meet. Rules and URL keys are put in one order over range partitions; a sweep
keeps the stack of rules whose intervals are open, the innermost is the longest fit of a key. Rules that were opened in an earlier
partition are found by looking up all prefixes of each partition's first key: rows by the number of partitions, not by the data.

Longest wins: by length of the rule, ties by the longer host, then block over allow. Verdicts depend on the URL alone, so each distinct
URL is swept once and the answer is joined back.

Defined cases: a null URL or one without ``://`` has empty host and path and no rule; the default verdict stands for no rule; repeated
rules count once, block before allow; null hosts or paths in rules count as empty, rules with an empty host fit nothing; rows of one id stay separate; other
columns are not read; an empty table of either kind is fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import lower_ascii, quoted
from pageloom.session import pin

DEFAULT_VERDICT = "allow"
_FIELDS = "url string, rule_key string"


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_table(rules: DataFrame) -> DataFrame:
    """(key, rule, verdict) from (host, path, verdict), each key once."""
    host, path = lower_ascii(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    # min: "allow" sorts before "block", so the block of a repeated rule is the max
    return (rules.select(F.concat(reversed_host(host), path).alias("key"), F.concat(host, path).alias("rule"), "verdict", host.alias("host"))
            .filter("host <> ''").groupBy("key", "rule", "host").agg(F.max("verdict").alias("verdict")))


def _sweep(batches: Iterator[pa.RecordBatch], carried: dict[int, list[str]]) -> Iterator[pa.RecordBatch]:
    stack = list(carried.get(TaskContext.get().partitionId(), []))
    for batch in batches:
        urls, found = [], []
        for key, url, is_url in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "is_url")), strict=True):
            while stack and not key.startswith(stack[-1]):
                stack.pop()
            if not is_url:
                stack.append(key)
            elif stack:
                urls.append(url)
                found.append(stack[-1])
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(found, pa.string())], names=["url", "rule_key"])


def innermost_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_key): for every key of every URL the innermost open rule, if there is one. ``urls``: url, host, path, distinct."""
    labels = F.split("host", r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.reverse(F.slice(labels, -k, k)), "."))
    keys = urls.filter("host <> ''").select("url", "path", F.explode(domains).alias("domain")).select(
        "url", F.concat("domain", "path").alias("key"))
    events = keys.select("key", "url", F.lit(True).alias("is_url")).unionByName(
        rules.select("key", F.lit(None).cast("string").alias("url"), F.lit(False).alias("is_url")).distinct())
    # the URL splits a key that very many URLs share; binary order of UTF-8 keeps every prefix before, and next to, what it opens; rules come before URLs of the same key
    ordered = pin(events.repartitionByRange("key", "url").sortWithinPartitions("key", "is_url"))
    firsts = ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"))
    prefixes = firsts.select("part", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.substring("first", F.lit(1), n))).alias("key"))
    held: dict[int, list[str]] = {}
    own = ordered.filter(~F.col("is_url")).select("key", F.spark_partition_id().alias("at")).distinct()
    for part, key in prefixes.join(own, "key").filter("at < part").select("part", "key").collect():  # by partitions and their nesting
        held.setdefault(part, []).append(key)
    carried = {part: sorted(found, key=len) for part, found in held.items()}
    return ordered.mapInArrow(lambda batches: _sweep(batches, carried), _FIELDS)


def url_verdicts(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, rule, verdict) of each distinct URL that a rule fits; ``rules``: host, path, verdict."""
    distinct = urls.select(quoted(url).alias("url")).filter("url is not null").distinct()
    parts = distinct.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    table = rule_table(rules)
    fits = innermost_rules(parts, table).join(table, F.col("rule_key") == F.col("key"))
    best = F.struct(F.length("rule").alias("n"), F.length("host").alias("h"), F.col("verdict").alias("v"))
    return fits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), best).alias("best")).select("url", "best.rule", "best.verdict")


def judged(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: page_id, host, path, rule (null without one), verdict."""
    verdicts = url_verdicts(pages, rules, url).select(F.col("url").alias("u"), "rule", "verdict")
    rows = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"))
    return rows.join(verdicts, F.col("url") == F.col("u"), "left").select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
