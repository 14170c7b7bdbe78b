"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds one posting (word, document row, position) for every document word that a test item uses, written by each task
for its own documents, plus one posting of the end mark per document whose position is the document's length. Windows of test
items are looked up in it by intersecting offset-adjusted lists (position minus offset in the window = start of the window),
rarest words first: the two rarest lists of every window meet in one aggregation, what is left is intersected with the lists of
all other words, restricted to the documents that are left.

Defined cases: a null text has no words; an item without words has no window; an item of fewer than ``window`` words is one
window; equal windows are looked up once and reported for every item that has them; rows of one ``doc_id`` are separate
documents with a result row each; items that share an id count once; a null item id is written as an empty string; other columns
of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import lower_ascii, quoted, staged

WINDOW = 10
#: Lists that meet before the documents are narrowed down.
PROBES = 2
#: Rows up to which a table of words or document numbers is broadcast (16 to 40 bytes a row); above it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: The end mark; no word is empty.
END = ""


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def test_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, terms) with each distinct window once, and (window, item) for the items that have it."""
    parts = items.select(F.coalesce(quoted(item_id).cast("string"), F.lit("")).alias("item"), words_of(quoted(text)).alias("words"))
    cut = (parts.filter(F.size("words") > 0)
           .select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at"))
           .select("item", F.slice("words", F.col("at") + 1, window).alias("terms")))
    windows = staged(cut.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"))
    return windows, staged(cut.join(windows, "terms").select("window", "item").distinct())


def build_index(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (doc_row, doc_id, word, pos, text_hash) of the windows' words and of the end mark, sorted by document within each file;
    only the end mark carries the hash of the text."""
    marked = docs.sparkSession.range(1).select(F.lit(END).alias("word"))
    vocabulary = staged(windows.select(F.explode("terms").alias("word")).distinct().unionByName(marked))
    # numbered in a step of its own: beside the generator the rows would be numbered after it
    numbered = docs.select(F.monotonically_increasing_id().alias("doc_row"), quoted(doc_id).alias("doc_id"), quoted(text).alias("text"),
                           F.xxhash64(quoted(text)).alias("text_hash"))
    tokens = numbered.select("doc_row", "doc_id", "text_hash", F.posexplode(F.array_append(words_of(F.col("text")), F.lit(END))).alias("pos", "word"))
    return staged(tokens.join(small(vocabulary, vocabulary.count()), "word").select(
        "doc_row", "doc_id", "word", "pos", F.when(F.col("word") == END, F.col("text_hash")).alias("text_hash")))


def lists_by_rarity(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, length, offset, word, rank): the words of each window, rarest in the index first; windows with a word that occurs
    nowhere are left out."""
    counts = staged(index.filter(F.col("word") != END).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    words = windows.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "word"))
    known = words.join(counts, "word")
    by_window = Window.partitionBy("window")
    return staged(known.withColumn("known", F.count(F.lit(1)).over(by_window)).filter(F.col("known") == F.col("length"))
                  .select("window", "length", "offset", "word", F.row_number().over(by_window.orderBy("n", "offset")).alias("rank")))


def adjusted(index: DataFrame, lists: DataFrame) -> DataFrame:
    """Offset-adjusted lists: one row (doc_row, window, length, start, rank) for each posting of a listed word."""
    return (index.join(small(lists, lists.count()), "word")
            .select("doc_row", "window", "length", (F.col("pos") - F.col("offset")).alias("start"), "rank").filter(F.col("start") >= 0))


def phrase_matches(index: DataFrame, lists: DataFrame, probes: int = PROBES) -> DataFrame:
    """(doc_row, window, length, start) of every exact occurrence of a window."""
    key = ["doc_row", "window", "length", "start"]
    first = staged(adjusted(index, lists.filter(F.col("rank") <= probes)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") == F.least(F.col("length"), F.lit(probes))).select(*key))
    left = staged(first.filter(F.col("length") > probes).select("doc_row").distinct())
    rest = lists.filter(F.col("rank") > probes).select("window", "offset", "word")
    wanted = (first.join(small(rest, rest.count()), "window")
              .select(*key, "word", (F.col("start") + F.col("offset")).alias("pos")))
    there = index.join(small(left, left.count()), "doc_row", "left_semi").select("doc_row", "word", "pos")
    whole = (wanted.join(there, ["doc_row", "pos", "word"]).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") == F.col("length") - probes).select(*key))
    return staged(first.filter(F.col("length") <= probes).unionByName(whole))


def proximity_matches(index: DataFrame, lists: DataFrame, slop: int = 5, probes: int = 3) -> DataFrame:
    """(doc_row, window, start, spread): places where the ``probes`` rarest words of a window stand within ``slop`` words of where
    the phrase would have them; ``start`` is the start the rarest word implies. Exact places are among them, with spread 0
    if no nearer reading exists."""
    rows = adjusted(index, lists.filter((F.col("rank") <= probes) & (F.col("length") >= probes)))
    block = slop + 1
    anchors = rows.filter(F.col("rank") == 1).select("doc_row", "window", "start", F.expr(f"start div {block}").alias("block"))
    others = rows.filter(F.col("rank") > 1).select(
        "doc_row", "window", "rank", F.col("start").alias("other"),
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.expr(f"start div {block}") + d)).alias("block"))
    near = anchors.join(others, ["doc_row", "window", "block"]).filter(F.abs(F.col("other") - F.col("start")) <= slop)
    each = near.groupBy("doc_row", "window", "start", "rank").agg(F.min(F.abs(F.col("other") - F.col("start"))).alias("off"))
    return (each.groupBy("doc_row", "window", "start").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("spread"))
            .filter(F.col("n") == probes - 1).select("doc_row", "window", "start", "spread"))


def covered_words(matches: DataFrame) -> DataFrame:
    """(doc_row, n_hit): document words inside any match, each counted once."""
    spans = matches.groupBy("doc_row", "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy("doc_row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = spans.select("doc_row", (end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))).alias("new"))
    return new.groupBy("doc_row").agg(F.sum(F.greatest(F.col("new"), F.lit(0))).cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_row, doc_id, n_words, n_hit, items (sorted ids, as strings, of the items with occurring windows),
    text_hash (64 bits)."""
    windows, members = test_windows(items, item_id, item_text, window)
    index = build_index(docs, windows, doc_id, text)
    matches = phrase_matches(index, lists_by_rarity(index, windows))
    found = (matches.select("doc_row", "window").distinct().join(members, "window").groupBy("doc_row")
             .agg(F.sort_array(F.collect_set("item")).alias("items")))
    hit = staged(covered_words(matches).join(found, "doc_row"))
    return (index.filter(F.col("word") == END).select("doc_row", "doc_id", F.col("pos").cast("long").alias("n_words"), "text_hash")
            .join(hit, "doc_row", "left")
            .select("doc_row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "text_hash"))


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents (all columns) without a hit; rows are known by id and hash of the text, as ids may repeat or be missing."""
    hit = staged(contamination(docs, items, doc_id, text).filter("n_hit > 0").select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).alias("hit")).distinct())
    # one struct on either side: equal though the id is null
    return docs.join(small(hit, hit.count()), F.struct(quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("h")) == F.col("hit"), "left_anti")
