"""Ranked search against sums in plain integers."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewright.llm.lexical_search import search, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    found = [(i, plain_terms(t)) for i, t in docs]
    n = sum(bool(t) for _, t in found)
    length = sum(len(t) for _, t in found)
    df = Counter(x for _, t in found for x in set(t))
    out = []
    for item, text in items:
        wanted, rows = Counter(plain_terms(text)), []
        for doc, t in found:
            tf = Counter(t)
            score = 0
            for x, times in wanted.items():
                if tf[x]:
                    m = 75 + 25 * len(t) * n // length
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc, score))
        out += [(item, r + 1, row[3], row[4]) for r, row in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


DOCS = [
    (1, "The cat sat. THE Cat!"), (2, "a cat é É x9 9x"), (3, None), (4, ""), (5, "-- ++"), (6, "dog " * 500), (7, "the cat sat the cat"), (7, "the cat sat the cat"), (None, "cat sat"),
    (8, "cat sat"), (9, "z" * 40_000 + " cat"), (10, "the " * 30 + " cat sat"), (11, "und der Hund"), (12, "dog cat"),
]
ITEMS = [(1, "cat"), (2, "Cat cat SAT the"), (3, None), (4, "!!"), (5, "dog é x9"), (2, "hund"), (2, "hund"), (6, "nowhere"), (None, "cat dog"), (7, "z" * 40_000)]


@pytest.mark.parametrize("block_bytes, most_postings, k", [(4_000_000, 1_000_000, 20), (60, 3, 2), (1, 1, 3)])
def test_equals_plain_sums(spark, block_bytes, most_postings, k):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("score", F.lit("a column of the result's name")).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = search(docs, items, k=k, block_bytes=block_bytes, most_postings=most_postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS, k)


def test_ties_go_by_id(spark):
    rows = [(i, "same words here") for i in range(300, 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "words"), (2, "same")], "item_id long, text string")
    got = sorted(map(tuple, search(docs, items, most_postings=50).collect()))
    assert [(i, r, d) for i, r, d, _ in got] == [(i, r, r) for i in (1, 2) for r in range(1, 21)]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(docs.limit(0), items).collect() == []
    assert search(docs, items.limit(0)).collect() == []
    assert search(docs.where("doc_id in (3, 4, 5)"), items).collect() == []


def test_terms():
    text = "Äb\x80c\x7fD-9_é [x]\x00　{Y}"
    assert [t.decode() for t in terms(text)] == plain_terms(text)
