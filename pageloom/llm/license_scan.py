"""Licence scans: parts of a text compared to licence templates by the Dice coefficient over word bigrams.

Parts are the whole text, its paragraphs (between blank lines) and its lines, each distinct part once. Text is normalised to ASCII
lower case, words are runs of letters, digits and characters beyond ASCII, British spellings become American. A template with b
bigrams can reach a coefficient t only with parts of b*t/(2-t) to b*(2-t)/t bigrams; templates outside these bounds are not
compared, and a part stops being read once it has more distinct bigrams than any template allows. Each text is read whole in its row.

``license_windows`` looks for notices and full licence texts anywhere: wrapped, inline or amid other words. Each template is compared to
windows of the whole normalised text at every start; window sizes run over the template's bounds, all of them for short templates, in
steps of a twentieth for long ones. A template is left out only if the text shares fewer bigrams with it than any window that reaches
the coefficient must.

Defined cases: a null or blank text has no parts and no licence; parts of one word have no bigram; of templates that tie the first
by name is the best; rows of one doc_id stay separate; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import quoted
from pageloom.llm.license_texts import TEXTS

THRESHOLD = 0.8
#: fixed values: usual short notices, by name.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: fixed values: spellings made equal.
SPELLINGS = {b"licence": b"license", b"licenced": b"licensed", b"licences": b"licenses"}
_CHARS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
RESULT = T.StructType([T.StructField("n_parts", T.LongType()), T.StructField("n_matches", T.LongType()), T.StructField("licenses", T.ArrayType(T.StringType())),
                       T.StructField("best", T.StringType()), T.StructField("best_dice", T.DoubleType())])
WINDOWS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("licenses", T.ArrayType(T.StringType())),
                        T.StructField("dices", T.ArrayType(T.DoubleType())), T.StructField("starts", T.ArrayType(T.LongType()))])


def normal_words(part: str) -> list[bytes]:
    return [SPELLINGS.get(w, w) for w in part.encode("utf-8", "surrogatepass").translate(_CHARS).split()]


def bigrams(words: list[bytes], most: int) -> set | None:
    """The distinct bigrams, None as soon as there are more than ``most``."""
    found: set = set()
    for at in range(0, len(words) - 1, 512):
        found.update(zip(words[at:at + 512], words[at + 1:at + 513], strict=False))
        if len(found) > most:
            return None
    return found


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = []
        for name in sorted(templates):
            grams = bigrams(normal_words(templates[name]), 1 << 30)
            if grams:
                b = len(grams)
                self.templates.append((name, grams, math.ceil(b * threshold / (2 - threshold) - 1e-9), math.floor(b * (2 - threshold) / threshold + 1e-9)))
        self.least = min((t[2] for t in self.templates), default=1 << 30)
        self.most = max((t[3] for t in self.templates), default=0)

    def match(self, part: str) -> tuple[str, float] | None:
        words = normal_words(part)
        if len(words) - 1 < self.least:
            return None
        grams = bigrams(words, self.most)
        best = None
        for name, own, low, high in self.templates if grams is not None else ():
            if low <= len(grams) <= high:
                dice = 2 * len(own & grams) / (len(own) + len(grams))
                if dice >= self.threshold and (best is None or dice > best[1]):
                    best = name, dice
        return best

    def scan(self, text: str | None) -> tuple:
        text = text or ""
        parts = dict.fromkeys(p for p in [*text.split("\n"), *re.split(r"\n[ \t\r]*\n", text), text] if p and not p.isspace())
        found = [m for m in map(self.match, parts) if m]
        best = min(found, key=lambda m: (-m[1], m[0]), default=(None, None))
        return len(parts), len(found), sorted({m[0] for m in found}), *best


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_parts (distinct), n_matches, licenses (sorted names), best, best_dice."""
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, threshold)
        for part in texts:
            yield pd.DataFrame([scanner.scan(t) for t in part], columns=RESULT.names)

    scan.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.select(quoted(doc_id).alias("doc_id"), F.pandas_udf(scan, RESULT)(quoted(text)).alias("r")).select("doc_id", "r.*")


class WindowScanner:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = []
        for name in sorted(templates):
            words = normal_words(templates[name])
            if grams := bigrams(words, 1 << 30):
                b, whole = len(grams), len(words) - 1
                low = math.ceil(b * threshold / (2 - threshold) - 1e-9)
                # a window may repeat bigrams as often as the template does
                high = math.floor(b * (2 - threshold) / threshold + 1e-9) * whole // b
                sizes, w = {whole}, low
                while w <= high:
                    sizes.add(w)
                    w += max(1, w // 20)
                self.templates.append((name, grams, low, sorted(sizes)))
        self.vocabulary = set().union(*(t[1] for t in self.templates))
        self.least = min((t[2] for t in self.templates), default=1 << 30)

    def scan(self, text: str | None) -> tuple[int, list, list, list]:
        """Words of the text; names of the templates found, the best coefficient of each and the first word of its window."""
        words = normal_words(text or "")
        shared = self.vocabulary.intersection(zip(words, words[1:], strict=False))
        found, ids, before = [], None, None
        for name, own, low, sizes in self.templates if len(shared) >= self.least else ():
            if len(own & shared) < low:
                continue
            if ids is None:
                number: dict = {}
                ids = np.array([number.setdefault(g, len(number)) for g in zip(words, words[1:], strict=False)])
                order = np.argsort(ids, kind="stable")
                before = np.full(len(ids), -1)
                again = ids[order[1:]] == ids[order[:-1]]
                before[order[1:][again]] = order[:-1][again]
            known = np.zeros(len(number), bool)
            known[[number[g] for g in own & shared]] = True
            at = np.flatnonzero(known[ids])
            best = (0.0, 0)
            for w in sorted({min(w, len(ids)) for w in sizes}):
                common = self.distinct(at, before, w, len(ids))
                dice = 2 * common / (len(own) + self.distinct(np.arange(len(ids)), before, w, len(ids)))
                k = int(np.argmax(dice))
                if dice[k] > best[0]:
                    best = float(dice[k]), k
            if best[0] >= self.threshold:
                found.append((name, *best))
        return len(words), *([f[i] for f in found] for i in range(3))

    @staticmethod
    def distinct(at: np.ndarray, before: np.ndarray, w: int, n: int) -> np.ndarray:
        """Distinct bigrams among places ``at`` in every window of ``w``: a place counts from the start that leaves out the same
        bigram before it, or that just reaches it, to its own."""
        first = np.maximum(before[at], at - w) + 1
        change = np.bincount(np.maximum(first, 0), minlength=n + 1)[:n + 1] - np.bincount(at + 1, minlength=n + 1)[:n + 1]
        return np.cumsum(change)[:n - w + 1]


def license_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, licenses (sorted names), dices and starts (first word) of their best windows."""
    templates = {**TEMPLATES, **TEXTS} if templates is None else templates

    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = WindowScanner(templates, threshold)
        for part in texts:
            yield pd.DataFrame([scanner.scan(t) for t in part], columns=WINDOWS.names)

    scan.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.select(quoted(doc_id).alias("doc_id"), F.pandas_udf(scan, WINDOWS)(quoted(text)).alias("r")).select("doc_id", "r.*")
