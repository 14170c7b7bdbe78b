"""SimHash near-duplicate groups through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most ``MAX_BITS`` = 2 bits share at least
8 - 2 = 6 positional bytes. A posting list of one positional byte holds a 256th of all fingerprints, so lists are not walked one by
one: the eight positions form four neighbours' pairs, and two wrong bytes spoil two of the pairs at most, so any pair of fingerprints
with six shared bytes meets in one of the six lists keyed by two whole pairs (four positional bytes). Every meeting pair's shared
positional bytes are tallied, pairs with six or more are kept and verified by their differing bits.

Lists of more than ``DENSE`` fingerprints (families of near copies) are not paired. Their fingerprints go by centres: a fingerprint
and its 64 one-bit neighbours. Two fingerprints share a centre exactly if they differ in two bits or fewer, a centre has 65 members
at most, so this finds every link in rows linear in the fingerprints, whatever the family's size.

Links become groups by alternating large-star and small-star steps, each written to the shared folder. Equal fingerprints are one node
throughout; copies are never paired.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; fewer than three words are one shingle; repeats
count; a null id takes part, its group is named by the smallest id that is not null (null if there is none); an empty table gives no
rows; rows of one doc_id are separate rows of the result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import packed, quoted, staged

MAX_BITS = 2
SHINGLE = 3
SHARED_BYTES = 8 - MAX_BITS
DENSE = 16
_BLOCK = 1 << 14


def text_fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number; shingles are hashed in blocks, so memory stays small for any text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + SHINGLE]), 42) for i in range(at, min(n, at + _BLOCK))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([text_fingerprint(t) for t in part], dtype="int64")


def _pair_keys(fp: Column) -> Column:
    """Six list keys: which two pairs of positions, and their four bytes."""
    pairs = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(*[F.lit(k << 32).bitwiseOR(F.shiftleft(pairs[i], 16)).bitwiseOR(pairs[j]) for k, (i, j) in enumerate(combinations(range(4), 2))])


def shared_bytes(a: Column, b: Column) -> Column:
    differing = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(differing, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8))


def fingerprint_links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b), a < b or equal ends of a centre's star, that connect all fingerprints (column fp, distinct) within two bits."""
    keys = distinct.select("fp", F.explode(_pair_keys(F.col("fp"))).alias("key"))
    lists = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    rows = staged(keys.join(lists, "key"))
    sparse = rows.filter(F.col("n") <= dense)
    met = sparse.select("key", F.col("fp").alias("a")).join(sparse.select("key", F.col("fp").alias("b")), "key").filter("a < b")
    pairs = (met.filter(shared_bytes(F.col("a"), F.col("b")) >= SHARED_BYTES)
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b"))
    family = rows.filter(F.col("n") > dense).select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    centres = family.select("fp", F.explode(flips).alias("centre")).groupBy("centre").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    stars = centres.filter(F.size("fps") > 1).select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 65)).alias("b"))
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link (a, b)."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return tuple(row)

    before = state(edges)
    while before[0]:
        # large star: neighbours above u move to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below it move to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u > v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, doc_id: str, text: str, dense: int) -> DataFrame:
    """near_duplicate_groups with text_hash, a 64-bit hash of the text, at the end."""
    prints = staged(docs.select(quoted(doc_id).alias("doc_id"), fingerprint(quoted(text)).alias("fp"), F.xxhash64(quoted(text)).alias("text_hash")))
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = staged(components(fingerprint_links(distinct.select("fp"), dense)))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = staged(rooted.join(names, "root").select("fp", "root", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id", "text_hash")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """One row per document: doc_id, fp (signed 64-bit), root (a fingerprint that names the group), component_id (smallest doc_id
    of the group)."""
    return _grouped(docs, doc_id, text, dense).drop("text_hash")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """All columns of one document per group: of the rows with the group's smallest id (none if no row of it has one) the one with
    the smallest hash of the text. Rows are known by id and hash of the text, as ids may repeat or be missing. Each text moves once:
    joined by that key, then aggregated by it where it is."""
    groups = _grouped(docs, doc_id, text, dense).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # keys travel as one struct: equal though the id is null
    kept = staged(groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))).alias("key")).select("key"))
    rows = docs.select(F.struct(quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("h")).alias("key"), packed(docs).alias("record"))
    return rows.join(kept, "key", "left_semi").groupBy("key").agg(F.first("record").alias("record")).select("record.*")
