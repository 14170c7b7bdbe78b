from __future__ import annotations

import pytest

TEXTS = [
    None, "", "   \n\t ", "one", "one two", "a b c d e f g h i j k l m n",
    "The of and to is that. " * 30, "The of and to is that. " * 30 + "x", "Licensed under the Apache License, Version 2.0.\nmore words here",
    "line\nline\nline\nother line", "word " * 3000, "É ß Ñ — “x”\x85y\u3000z\x1cw", "no#symbols* $ % & | < >", "tail \U0001F600 emoji text in the middle of and",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null, empty, very long and repeated texts, a null id, repeated rows and columns whose names clash."""
    rows = [(i, t, "en", "s0" if i % 3 else None, i, i) for i, t in enumerate(TEXTS)]
    rows += [(100, "same text of some words " * 5, "en", "s1", 1, 1)] * 3 + [(None, "text without an id and more", None, None, None, None)] * 2
    rows.append((200, " ".join(f"w{i % 977}" for i in range(120_000)), "en", "s0", 0, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Shard int, rate int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
