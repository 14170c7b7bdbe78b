"""The bilingual term store: every mutation takes a snapshot and returns the next one.

Snapshot columns: term_id, zh, vi, enabled, sources (array), created, updated; ``zh`` is unique.
Batches of pairs carry ``pos``, an integer that gives their order.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import lexicon as L
from pageloom.functions.parsing import arrow_lines, merge_sources
from pageloom.functions.predicates import learnable_shape
from pageloom.functions.text import ColumnLike, col, is_blank, strip
from pageloom.plans.ordered import best_per_group, dense_position, top_per_group

STORE = ["term_id", "zh", "vi", "enabled", "sources", "created", "updated"]


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def norm_key(text: ColumnLike) -> Column:
    """Trimmed, canonically composed. Only texts that composition can change travel to Python."""
    t = strip(F.coalesce(col(text), F.lit("")))
    return F.coalesce(_nfc(F.when(t.rlike(r"[^\x00-˿一-鿿]"), t)), t)


def normalized(df: DataFrame, source: str, out: str) -> DataFrame:
    return df.withColumn(out, norm_key(source))


def longest_first(text: ColumnLike, pos: ColumnLike) -> list[Column]:
    return [F.length(col(text)).desc(), col(pos).asc()]


# ---------------------------------------------------------------- reading terms


def arrow_terms(df: DataFrame, key: str, text: str, last_wins: bool, any_separator: bool = True) -> DataFrame:
    """One row per (key, zh) of the 'left => right' lines in a text."""
    found = df.select(key, F.explode(arrow_lines(text, any_separator)).alias("p")).select(key, "p.*")
    pick = F.max_by if last_wins else F.min_by
    return found.groupBy(key, "zh").agg(pick("vi", "line_no").alias("vi"))


def learnable_terms(pairs: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """Pairs worth keeping: Han on the left, two characters or more, no stop word."""
    spark = pairs.sparkSession
    words = stopwords if stopwords is not None else spark.createDataFrame([(w,) for w in L.STOPWORDS], "zh string")
    return pairs.filter(learnable_shape("zh", "vi")).join(F.broadcast(words) if stopwords is None else words, "zh", "left_anti")


def load_enabled(store: DataFrame) -> DataFrame:
    return store.filter(F.col("enabled") & (F.col("zh") != "") & (F.col("vi") != "")).select("term_id", "zh", "vi")


def list_terms(store: DataFrame, q: str | None = None, status: str | None = None) -> DataFrame:
    """Pending first, then latest change. ``q`` is a LIKE fragment without an escape character; case folds beyond ASCII too."""
    out = store
    if q:
        like = "%" + q.replace("\\", "\\\\") + "%"
        out = out.filter(F.col("zh").ilike(like) | F.col("vi").ilike(like))
    if status in ("enabled", "pending"):
        out = out.filter(F.col("enabled") == (status == "enabled"))
    return out.orderBy(F.col("enabled"), F.coalesce("updated", "created").desc(), F.col("term_id").desc())


def term_counts(store: DataFrame) -> DataFrame:
    on = F.count_if("enabled")
    return store.agg(F.count(F.lit(1)).alias("total"), on.alias("enabled"), (F.count(F.lit(1)) - on).alias("pending"))


def prompt_blocks(terms: DataFrame, notes: DataFrame, key: str = "series_id", head: str = L.PROMPT_BLOCK_HEAD,
                  notes_head: str = L.PROMPT_BLOCK_NOTES) -> DataFrame:
    """One text per key: the longest terms, then the first notes. terms: key, zh, vi, line_no; notes: key, note, line_no."""
    first_terms = limit_prompt_terms(terms, key)
    first_notes = top_per_group(notes, [key], [F.col("line_no")], L.GLOSSARY_PROMPT_NOTES)
    rows = first_terms.select(
        key, F.lit(1).alias("part"), (-F.length("zh")).cast("bigint").alias("o"), "line_no",
        F.concat(F.lit("  "), "zh", F.lit(" → "), "vi").alias("txt"),
    ).unionByName(first_notes.select(
        key, F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("o"), "line_no",
        F.concat(F.lit("  - "), "note").alias("txt")))
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "o", "line_no", "txt"))).alias("r"))
    texts = lambda part: F.transform(F.filter("r", lambda x: x["part"] == part), lambda x: x["txt"])
    note_part = F.when(F.size(texts(2)) > 0, F.concat(F.array(F.lit(notes_head)), texts(2))).otherwise(texts(2))
    return gathered.select(key, F.array_join(F.concat(F.array(F.lit(head)), texts(1), note_part), "\n").alias("block"))


def limit_prompt_terms(terms: DataFrame, key: str = "series_id", k: int = L.GLOSSARY_PROMPT_TERMS) -> DataFrame:
    return top_per_group(terms, [key], longest_first("zh", "line_no"), k)


# ---------------------------------------------------------------- combining sets


def precedence_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``first`` and the rows of ``second`` whose key it lacks."""
    return first.unionByName(second.select(*first.columns).join(first.select(*keys), keys, "left_anti"))


def except_keys(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys), keys, "left_anti")


def intersect_ids(requested: DataFrame, store: DataFrame) -> DataFrame:
    return store.join(requested.select("term_id"), "term_id", "left_semi")


def suggestion_diff(selected: DataFrame, suggestions: DataFrame) -> DataFrame:
    """selected: term_id, zh, vi, pos; suggestions: zh, new. Looks up the text as it is, then composed."""
    plain = suggestions.select(F.col("zh").alias("_k"), F.col("new").alias("_plain"))
    composed = suggestions.select(F.col("zh").alias("_n"), F.col("new").alias("_composed"))
    wide = normalized(selected, "zh", "_norm")
    found = wide.join(plain, wide.zh == plain._k, "left").join(composed, wide["_norm"] == composed._n, "left")
    new = F.coalesce(F.nullif("_plain", F.lit("")), F.nullif("_composed", F.lit("")))
    return found.select(
        "pos", "term_id", "zh", F.col("vi").alias("old"), F.coalesce(new, "vi").alias("new"),
        (F.coalesce(new, "vi") != F.col("vi")).alias("changed"), new.isNull().alias("missing"))


def changed_first(diff: DataFrame) -> DataFrame:
    return diff.orderBy(F.col("changed").desc(), "pos")


# ---------------------------------------------------------------- mutations


def _batch(pairs: DataFrame) -> DataFrame:
    tidy = pairs.withColumns({"zh": norm_key("zh"), "vi": strip(F.coalesce("vi", F.lit("")))})
    return tidy.filter((F.col("zh") != "") & (F.col("vi") != ""))


def _ordered_sources(batch: DataFrame) -> DataFrame:
    """zh -> its source names in order of appearance; repeats are combined before anything is gathered."""
    firsts = batch.filter(~is_blank("source")).groupBy("zh", "source").agg(F.min("pos").alias("pos"))
    return firsts.groupBy("zh").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda s: s["source"]).alias("_new"))


def _merged(old: str, new: str) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none)))


def _with_ids(fresh: DataFrame, store: DataFrame) -> DataFrame:
    """Number new rows after the highest id, in batch order."""
    numbered = dense_position(fresh.withColumn("_all", F.lit(0)), ["_all"], "pos", "_nth").drop("_all")
    top = store.agg(F.coalesce(F.max("term_id"), F.lit(0)).cast("bigint").alias("top"))
    return numbered.withColumn("term_id", F.col("_nth") + top.scalar()).drop("_nth")


def _apply(store: DataFrame, batch: DataFrame, chosen: DataFrame, now: Column, overwrite: bool) -> DataFrame:
    """chosen: zh, pos, _vi, _enabled, one row per zh."""
    incoming = chosen.join(_ordered_sources(batch), "zh", "left")
    joined = store.join(incoming.drop("pos"), "zh", "left")
    hit = F.col("_vi").isNotNull()
    kept = joined.select(
        "term_id", "zh",
        (F.when(hit, F.col("_vi")).otherwise(F.col("vi")) if overwrite else F.col("vi")).alias("vi"),
        (F.when(hit, F.col("_enabled")).otherwise(F.col("enabled")) if overwrite else F.col("enabled")).alias("enabled"),
        F.when(hit, _merged("sources", "_new")).otherwise(F.col("sources")).alias("sources"), "created",
        (F.when(hit, now).otherwise(F.col("updated")) if overwrite else F.col("updated")).alias("updated"))
    fresh = _with_ids(incoming.join(store.select("zh"), "zh", "left_anti"), store).select(
        "term_id", "zh", F.col("_vi").alias("vi"), F.col("_enabled").alias("enabled"),
        _merged("_new", "_new").alias("sources"), now.alias("created"), now.alias("updated"))
    return kept.unionByName(fresh)


def learn_pending(store: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Add unseen pairs as not enabled; a seen one only gains the source name. pairs: pos, zh, vi, source."""
    batch = _batch(pairs)
    chosen = batch.groupBy("zh").agg(F.min("pos").alias("pos"), F.min_by("vi", "pos").alias("_vi"),
                                     F.lit(False).alias("_enabled"))
    return _apply(store, batch, chosen, now, overwrite=False)


def upsert_terms(store: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Insert or overwrite; the last of several writes to one zh counts. pairs: pos, zh, vi, enabled, source."""
    batch = _batch(pairs)
    chosen = batch.groupBy("zh").agg(F.min("pos").alias("pos"), F.max_by("vi", "pos").alias("_vi"),
                                     F.max_by("enabled", "pos").alias("_enabled"))
    return _apply(store, batch, chosen, now, overwrite=True)


def promote_terms(store: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    return upsert_terms(store, pairs.withColumn("enabled", F.lit(True)), now)


def accepted_pairs(pairs: DataFrame) -> DataFrame:
    """How many pairs a promotion accepts, repeats included."""
    return _batch(pairs).agg(F.count(F.lit(1)).alias("accepted"))


def inserted_terms(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many terms ``learn_pending`` adds."""
    fresh = _batch(pairs).select("zh").distinct().join(store.select("zh"), "zh", "left_anti")
    return fresh.agg(F.count(F.lit(1)).alias("added"))


def import_terms(store: DataFrame, pairs: DataFrame, now: Column, enabled: bool = True) -> DataFrame:
    """pairs: pos, zh, vi, folder; the folder's parent name becomes the source."""
    label = F.coalesce(F.nullif(F.regexp_extract("folder", r"([^/]+)/[^/]*$", 1), F.lit("")), F.lit("import"))
    labelled = pairs.withColumn("source", label)
    return promote_terms(store, labelled, now) if enabled else learn_pending(store, labelled, now)


def rename_terms(store: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """edits: pos, term_id, zh, vi, resolved against the snapshot.

    A text another term holds hands its translation to that term and removes the
    edited one; of several edits to one free text the first keeps it.
    """
    tidy = _batch(edits.withColumnRenamed("term_id", "_id")).join(store.select(F.col("term_id").alias("_id")), "_id", "left_semi")
    last = best_per_group(tidy, ["_id"], -F.col("pos"))
    holders = store.select("zh", F.col("term_id").alias("_holder"))
    placed = last.join(holders, "zh", "left")
    free = placed.filter(F.col("_holder").isNull() | (F.col("_holder") == F.col("_id")))
    owner = free.groupBy("zh").agg(F.min_by("_id", "pos").alias("_owner"))
    target = placed.join(owner, "zh", "left").select(
        "_id", "zh", "vi", "pos", F.coalesce("_owner", "_holder").alias("_target"))
    moves = target.filter(F.col("_target") == F.col("_id")).select(F.col("_id").alias("term_id"), F.col("zh").alias("_zh"))
    texts = target.groupBy(F.col("_target").alias("term_id")).agg(F.max_by("vi", "pos").alias("_vi"))
    gone = target.filter(F.col("_target") != F.col("_id")).select(F.col("_id").alias("term_id"))
    touched = store.join(gone, "term_id", "left_anti").join(texts, "term_id", "left").join(moves, "term_id", "left")
    hit = F.col("_vi").isNotNull()
    return touched.select(
        "term_id", F.coalesce("_zh", "zh").alias("zh"), F.coalesce("_vi", "vi").alias("vi"), "enabled", "sources",
        "created", F.when(hit, now).otherwise(F.col("updated")).alias("updated"))


def apply_suggestions(store: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """chosen: pos, term_id, new; blank suggestions are left out."""
    kept = chosen.filter(~is_blank("new")).select("pos", "term_id", F.col("new").alias("vi"))
    return rename_terms(store, kept.join(store.select("term_id", "zh"), "term_id"), now)


def set_enabled(store: DataFrame, ids: DataFrame, flag: bool, now: Column) -> DataFrame:
    marked = store.join(ids.select("term_id").distinct().withColumn("_hit", F.lit(True)), "term_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.withColumns({
        "enabled": F.when(hit, F.lit(flag)).otherwise(F.col("enabled")),
        "updated": F.when(hit, now).otherwise(F.col("updated"))}).select(*STORE)


def delete_terms(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("term_id"), "term_id", "left_anti")


def dedup_terms(store: DataFrame, now: Column) -> DataFrame:
    """One row per normalised zh: enabled first, then the lowest id; sources are united in that order."""
    keyed = normalized(store, "zh", "_key")
    rank = F.struct(~F.col("enabled"), F.col("term_id"))
    keep = keyed.groupBy("_key").agg(F.min_by(F.struct(*STORE), rank).alias("k"), F.count(F.lit(1)).alias("_n"))
    each = keyed.select("_key", rank.alias("r"), F.posexplode("sources").alias("i", "source"))
    firsts = each.groupBy("_key", "source").agg(F.min(F.struct("r", "i")).alias("at"))
    united = firsts.groupBy("_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda s: s["source"]).alias("_all"))
    # The kept row's own list may repeat a name; others are only appended when absent.
    joined = keep.join(united, "_key", "left").select("_key", "_n", "_all", "k.*")
    touched = (F.col("_n") > 1) | (F.col("zh") != F.col("_key"))
    return joined.select(
        "term_id", F.col("_key").alias("zh"), "vi", "enabled",
        F.when(F.col("_n") > 1, F.coalesce("_all", F.array().cast("array<string>"))).otherwise(F.col("sources")).alias("sources"),
        "created", F.when(touched, now).otherwise(F.col("updated")).alias("updated"))


def dedup_report(store: DataFrame) -> DataFrame:
    keys = normalized(store, "zh", "_key").groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("merged"), F.count(F.lit(1)).alias("total"))


def fold_learned(series_terms: DataFrame, store: DataFrame, learned: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Learned pairs go to the series file when new there, and to the store as pending."""
    added = except_keys(best_per_group(learned, ["zh"], F.col("pos")), series_terms, ["zh"])
    known = series_terms.select("zh", "vi").unionByName(added.select("zh", "vi"))
    return {
        "appended": added.select("pos", "zh", "vi"),
        "store": learn_pending(store, learned, now),
        "merged": precedence_union(known, load_enabled(store).select("zh", "vi"), ["zh"]),
    }


def add_source(df: DataFrame) -> DataFrame:
    return df.withColumn("sources", merge_sources("sources", "source"))
