"""Brute-force versions and odd inputs for the operators' tests."""

from __future__ import annotations

import itertools

LONG = "word " * 30_000
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (4, "one"),
    (5, "é ß \U0001f600 <|endoftext|> 12,5 it's don't İstanbul ﬁ é a b \x1c x"),
    (None, "no id at all here"),
    (6, LONG),
    (7, "the same four words"),
    (8, "the same four words"),
    (9, "!!! ... 123"),
]
CLASHES = (
    "node sig meta root cluster rid bucket length piece size shard slot part virtual_slot pii_text pii_spans pii_chunks found "
    "label score place row _row key grade shingles n start kind"
).split()


def odd_docs(spark):
    """NULLs, empty and very long texts, repeats, and extra columns with the operators' own names."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({c: F.lit("x") for c in CLASHES})


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(texts: dict, width: int, num: int, den: int) -> dict:
    """doc_id to (size, smallest doc_id reachable) by comparing every pair."""
    sets = {k: shingles(t, width) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
            both = len(x & y)
            if den * both >= num * (len(x) + len(y) - both):
                p, q = top(a), top(b)
                parent[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), top(k)) for k in texts}


def texts_of(spark, folder: str) -> dict:
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}
