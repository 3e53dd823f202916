import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup as ed

ROWS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 100_000), (8, "X" * 100_000), (None, "a b"), (9, "solo"), (2, "a B"), (None, "lone"), (None, "lone")]


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), keep is not None and i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep,pick", [("min", min), ("max", max)])
def test_groups_match_brute_force(spark, keep, pick):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"keep_id": F.lit("clash"), "_hash": F.lit(1), "n": F.lit(None)})
    got = ed.exact_groups(docs, keep=keep)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(ROWS, pick)


def test_dedup_keeps_one_row_of_each_text(spark):
    docs = spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id long, text string, source string")
    got = ed.exact_dedup(docs).collect()
    assert sorted(norm(r.text) for r in got) == sorted({norm(t) for _, t in ROWS})
    assert got[0].asDict().keys() == {"doc_id", "text", "source"}
    assert {r.doc_id for r in got} == {1, 3, 5, 6, 7, 9, None}


def test_clashing_hashes_are_grouped_by_text(spark, monkeypatch):
    monkeypatch.setattr(ed.F, "sha2", lambda c, n: F.lit("0" * 64))
    got = ed.exact_groups(spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 1, 2), (2, 2, 1), (3, 1, 2)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_groups(docs).count() == 0 and ed.exact_dedup(docs).count() == 0


def test_clashing_columns_come_back_whole(spark):
    docs = spark.createDataFrame([(1, "A", "x"), (2, "a", "y"), (3, "b", "z"), (3, "b", "z")], "doc_id long, text string, _hash string")
    assert sorted(map(tuple, ed.exact_dedup(docs).collect())) == [(1, "A", "x"), (3, "b", "z")]
