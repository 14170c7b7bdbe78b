"""Quality rules by weak supervision, in DataFrame operations only.

Every rule votes good (1), bad (-1) or abstains (0) on a document. The label model is a two-class mixture in which each rule has a
chance of each vote given the class (so its accuracy on good and on bad documents); expectation-maximisation fits the chances and the
share of good documents to the votes alone. The posterior probability of good replaces an all-must-pass filter.

Votes are counted per pattern before fitting (at most 3 to the number of rules rows), so a step of EM is one small aggregation and only
its sums reach the driver. All measures are taken within the document's row; nothing of a text is shuffled.

Repeated five-word windows: window hashes are tested for repeats first; only where there are any are (hash, place) pairs sorted and
the places of repeated windows merged.

Defined cases: a null text has no words; a text without words gets zeros, all rules abstain and it fails the base rule; rows of one
doc_id are judged separately; with an empty table the prior stays and no rows result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import quoted, staged

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP_ABOVE = 0.5
STEPS = 12
#: fixed values: frequent words of the four languages served.
FREQUENT_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "de", "la", "el", "que", "y", "los", "las", "un", "una",
                  "le", "les", "et", "des", "du", "est", "der", "die", "das", "und", "ist", "den", "von", "zu", "ein", "eine")
#: Starting chances of the votes (bad, abstain, good) on good and on bad documents, and the starting share of good documents.
START = {"good": (0.05, 0.25, 0.70), "bad": (0.40, 0.20, 0.40)}
PRIOR = 0.8


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules read besides. Each step is a projection of
    its own, so that no long array is computed once per element of another."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("t"))
    cut = rows.select("doc_id", "t", F.regexp_extract_all("t", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("words"),
                      F.filter(F.split("t", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"))
    n = F.size("words")
    hashed = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.col("words")[i + k] for k in range(window)]))
    grams = cut.select("doc_id", n.cast("long").alias("n_words"), F.when(n >= window, hashed).alias("grams"),
                       F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
                       F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                       F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
                       F.length(F.regexp_replace("t", r"[^.!?]+", "")).cast("long").alias("n_stops"),
                       F.size(F.filter("words", lambda w: w.isin(*FREQUENT_WORDS))).cast("long").alias("n_frequent"))
    kept = [c for c in grams.columns if c != "grams"]
    repeats = F.coalesce(F.size(F.array_distinct("grams")) < F.size("grams"), F.lit(False))
    pairs = grams.select(*kept, F.when(repeats, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("pairs"))
    at = lambda k: F.try_element_at("pairs", k)["g"]
    again = F.filter("pairs", lambda p, k: F.coalesce((k > 0) & (at(F.greatest(k, F.lit(1))) == p["g"]), F.lit(False))
                     | F.coalesce(at(k + 2) == p["g"], F.lit(False)))
    starts = pairs.select(*kept, F.when(F.col("pairs").isNotNull(), F.sort_array(F.transform(again, lambda p: p["i"]))).alias("starts"))
    covered = F.aggregate("starts", F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum")), lambda acc, s: F.struct(
        s.alias("last"), (acc["sum"] + F.least(F.lit(window), s - acc["last"])).alias("sum")), lambda acc: acc["sum"])
    return starts.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Rules over ``measures``; a rule abstains where it cannot tell."""
    n = F.col("n_words")
    share = lambda name, of=n: F.col(name) / F.greatest(of, F.lit(1))
    long_enough = n >= 30
    return {
        "symbols": _vote(share("n_symbols") > 0.1, (n > 0) & (share("n_symbols") < 0.03)),
        "lines": _vote(share("n_dup_lines", F.col("n_lines")) > 0.3, (F.col("n_lines") >= 3) & (F.col("n_dup_lines") == 0)),
        "repeats": _vote(share("n_repeat_words") > 0.2, long_enough & (share("n_repeat_words") < 0.05)),
        "case": _vote((n > 0) & (share("n_upper", F.col("word_chars")) > 0.4), (n > 0) & (share("n_upper", F.col("word_chars")) < 0.1)),
        "length": _vote((n > 0) & ((share("word_chars") > 12) | (share("word_chars") < 2.5)), (n > 0) & share("word_chars").between(3.0, 9.0)),
        "stops": _vote((share("n_stops") > 0.5) | (long_enough & (F.col("n_stops") == 0)), (n > 0) & share("n_stops").between(0.02, 0.3)),
        "frequent": _vote(long_enough & (share("n_frequent") < 0.02), share("n_frequent") > 0.06),
    }


class LabelModel:
    """Share of good documents and, per rule, the chances of the votes (bad, abstain, good) given good and given bad."""

    def __init__(self, names: list[str]):
        self.names, self.prior = names, PRIOR
        self.chance = {y: {r: list(START[y]) for r in names} for y in ("good", "bad")}

    def _differences(self, rule: str) -> list[float]:
        """Log odds that a vote of the rule (bad, none, good) adds."""
        return [math.log(g) - math.log(b) for g, b in zip(self.chance["good"][rule], self.chance["bad"][rule], strict=True)]

    def posterior(self) -> Column:
        """P(good | votes) as a column over the vote columns."""
        odds = F.lit(math.log(self.prior) - math.log(1 - self.prior))
        for r in self.names:
            d = self._differences(r)
            odds = odds + F.when(F.col(r) < 0, d[0]).when(F.col(r) > 0, d[2]).otherwise(d[1])
        return 1 / (1 + F.exp(-odds))

    def fit(self, patterns: DataFrame, steps: int = STEPS) -> LabelModel:
        """``patterns``: one row per distinct vote pattern with its count ``n``. There are 3 to the power of the rules at most; they come to the
        driver once, and the steps are arithmetic over them."""
        found = patterns.select(*self.names, "n").limit(3 ** len(self.names) + 1).collect()
        if len(found) > 3 ** len(self.names):
            raise ValueError("patterns repeat, or hold other votes than -1, 0 and 1")
        # votes as places 0, 1, 2 of a chance list; a fixed order makes sums repeatable
        votes = sorted(([1 + r[name] for name in self.names], r["n"]) for r in found)
        total = sum(n for _, n in votes)
        if not total:
            return self
        for _ in range(steps):
            start = math.log(self.prior) - math.log(1 - self.prior)
            add = [self._differences(r) for r in self.names]
            good = 0.0
            sums = {y: [[0.0, 0.0, 0.0] for _ in self.names] for y in ("good", "bad")}
            for places, n in votes:
                p = 1 / (1 + math.exp(-(start + sum(add[k][v] for k, v in enumerate(places)))))
                good += n * p
                for k, v in enumerate(places):
                    sums["good"][k][v] += n * p
                    sums["bad"][k][v] += n * (1 - p)
            # one document's worth of the starting chances keeps every chance above zero
            self.prior = min(1 - 1e-6, max(1e-6, (good + PRIOR) / (total + 1)))
            for y, size in (("good", good), ("bad", total - good)):
                for k, r in enumerate(self.names):
                    self.chance[y][r] = [(sums[y][k][v] + START[y][v]) / (size + 1) for v in range(3)]
        return self

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Per rule: how often its votes are right on good and on bad documents, of those it votes on."""
        return {r: (g[2] / (g[0] + g[2]), b[0] / (b[0] + b[2])) for r, g, b in
                ((r, self.chance["good"][r], self.chance["bad"][r]) for r in self.names)}


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_above: float = KEEP_ABOVE, steps: int = STEPS) -> DataFrame:
    """One row per document: the measures, one column of votes per rule, base_failed, quality (posterior) and kept."""
    votes = rules()
    measured = staged(measures(docs, doc_id, text).select("*", *[v.alias(r) for r, v in votes.items()]))
    patterns = measured.groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))
    model = LabelModel(list(votes)).fit(patterns, steps)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (measured.withColumn("base_failed", failed).withColumn("quality", model.posterior())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") > keep_above)))
