"""Line files: series glossaries, rewrite rules, address lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import lexicon as L
from pageloom.functions.predicates import is_learnable
from pageloom.functions.text import ColumnLike, col, let, rstrip, strip

LINE_FILE = "series_id string, line_no bigint, line string"


def glossary_line(line: ColumnLike) -> Column:
    """kind (term, note, comment, other), zh, vi, keep, note of one line."""

    def read(t: Column) -> Column:
        keep = F.lower(t).endswith("@keep") & t.contains("=>") & ~F.lower(t).startswith("@note")
        body = F.when(keep, rstrip(F.left(t, F.length(t) - 5))).otherwise(t)
        cut = F.position(F.lit("=>"), body)
        kind = (
            F.when(t == "", "blank").when(t.startswith("#"), "comment").when(F.lower(t).startswith("@note"), "note")
            .when(t.contains("=>"), "term").otherwise("other"))
        note = strip(F.substring(t, 6, 2**31 - 1), " :\t")
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "term", F.when(cut > 0, strip(F.substring(body, F.lit(1), cut - 1))).otherwise(strip(body))).alias("zh"),
            F.when(kind == "term", F.when(cut > 0, strip(F.substring(body, cut + 2, F.length(body)))).otherwise("")).alias("vi"),
            keep.alias("keep"), F.when(kind == "note", note).alias("note"))

    return let(strip(line), read)


def read_line_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per line; the folder that holds the file names the series. A file is one split, so lines keep their number."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    lines = raw.select("file", F.posexplode(F.split("value", L.LINE_END)).alias("line_no", "line"))
    return lines.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("series_id"),
                        (F.col("line_no") + 1).cast("bigint").alias("line_no"), "line")


def parsed_lines(lines: DataFrame) -> DataFrame:
    return lines.select("series_id", "line_no", glossary_line("line").alias("g")).select("series_id", "line_no", "g.*")


def glossary_terms(lines: DataFrame) -> DataFrame:
    """Accepted terms: the first line per zh wins; ``@keep`` passes the junk filter."""
    good = parsed_lines(lines).filter((F.col("kind") == "term") & (F.col("zh") != "") & (F.col("vi") != ""))
    good = good.filter(F.col("keep") | is_learnable("zh", "vi"))
    first = good.groupBy("series_id", "zh").agg(F.min_by("vi", "line_no").alias("vi"), F.min("line_no").alias("line_no"))
    return first.select("series_id", "line_no", "zh", "vi")


def glossary_notes(lines: DataFrame) -> DataFrame:
    return parsed_lines(lines).filter((F.col("kind") == "note") & (F.col("note") != "")).select("series_id", "line_no", "note")


def glossary_pairs(lines: DataFrame) -> DataFrame:
    """Loose form: every 'left => right' line, the ``@keep`` mark included, repeats kept."""
    t = strip("line")
    plain = lines.filter((t != "") & ~t.startswith("#") & ~F.lower(t).startswith("@note") & t.contains("=>"))
    cut = F.position(F.lit("=>"), t)
    pairs = plain.select("series_id", "line_no", strip(F.substring(t, F.lit(1), cut - 1)).alias("zh"),
                         strip(F.substring(t, cut + 2, F.length(t))).alias("vi"))
    return pairs.filter((F.col("zh") != "") & (F.col("vi") != ""))


def glossary_line_counts(lines: DataFrame) -> DataFrame:
    kinds = parsed_lines(lines)
    return kinds.groupBy("series_id").agg(F.count_if(F.col("kind") == "term").alias("terms"),
                                          F.count_if(F.col("kind") == "note").alias("notes"))


def rule_lines(lines: DataFrame) -> DataFrame:
    """Rewrite rules: rule_no, pattern, replacement, accepted; comments and blanks are gone."""
    t = strip("line")
    live = lines.filter((t != "") & ~t.startswith("#") & ~t.startswith("//"))
    bare = strip(F.substring_index(strip(F.substring_index(F.col("line"), "#", 1)), "//", 1))
    parts = F.filter(F.split(bare, f"{L.WS_CLASS}+"), lambda p: p != "")
    read = live.select("series_id", F.col("line_no").alias("rule_no"), parts.alias("p"))
    return read.select("series_id", "rule_no", F.get("p", F.lit(0)).alias("pattern"),
                       F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("replacement"),
                       F.size("p").isin(1, 2).alias("accepted"))


def url_list(df: DataFrame, key: str, raw: str, distinct: bool = True) -> DataFrame:
    """Web addresses of a pasted list: key, ord, url; repeats keep the first place."""
    parts = df.select(key, F.posexplode(F.split(raw, r"[\r\n,;]+")).alias("ord", "url"))
    web = parts.withColumn("url", strip("url")).filter(F.col("url").rlike("^https?://"))
    if not distinct:
        return web.select(key, F.col("ord").cast("bigint").alias("ord"), "url")
    return web.groupBy(key, "url").agg(F.min("ord").cast("bigint").alias("ord")).select(key, "ord", "url")


def append_terms(terms: DataFrame, path: str) -> None:
    """Append only: lines already written stay as they are."""
    line = F.concat("zh", F.lit(" => "), "vi")
    terms.select("series_id", line.alias("value")).write.mode("append").partitionBy("series_id").text(path)
