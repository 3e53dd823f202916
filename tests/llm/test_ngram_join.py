import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import ngram_join as nj


def sets(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows, n, num, den):
    """(id, size, smallest id reachable, number of rows linked) for each row."""
    s = [sets(t, n) for _, t in rows]
    label, n_links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                label[find(i)] = find(j)
                n_links[i] += 1
                n_links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)), n_links[i]) for i, (d, _) in enumerate(rows)), key=str)


def families(seed=0, n=12):
    """Texts of many lengths, each with copies that differ in a few places."""
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(n):
        words = [rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(rng.choice([1, 2, 3, 4, 9, 12, 30, 80, 300]))]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(copy)) if copy else 0
                copy[at : at + 1] = rng.choice([[], ["new"], [*copy[at : at + 1], "more"], [w.upper() for w in copy[at : at + 1]]])
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("n,num,den,block", [(3, 90, 100, 512), (5, 80, 100, 4), (2, 70, 100, 3)])
def test_components_match_brute_force(spark, n, num, den, block):
    rows = families(n) + [(1000, None), (1001, ""), (1002, " \n"), (None, "only one"), (1003, "only one"), (1004, "Only  ONE"), (None, "no id"), (None, "no id"), (0, families(n)[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sid": F.lit("clash"), "component": F.lit(1)})
    got = nj.jaccard_components(docs, n, num, den, block=block).drop("_hash").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, n, num, den)


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(0)
    for num in (90, 80):
        spaces = nj.Spaces(num, 100)
        for _ in range(400):
            n = int(rng.integers(2, 200))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(rng.integers(0, n // 8 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
            if len(b) and nj.linked(a, b, num, 100) and len(a) != len(np.intersect1d(a, b)):
                assert set(spaces.keys(a).tolist()) & set(spaces.keys(b).tolist())


def test_tree_bounds_lose_no_pair():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64)) for _ in range(20)]
    many = [np.unique(np.concatenate([b[: max(1, int(len(b) * f))], rng.integers(0, 2**64, 2, dtype=np.uint64)])) for b in base for f in (1, 0.97, 0.9, 0.6)]
    tree = nj.SignatureTree(many)
    got = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in nj.candidates(tree, tree, 80, 100, True)))}
    want = {(i, j) for i in range(len(many)) for j in range(i + 1, len(many)) if nj.linked(many[i], many[j], 80, 100)}
    assert want <= got and len(got) < len(many) ** 2 / 8


def test_common_sizes_by_products_and_one_by_one():
    rng = np.random.default_rng(2)
    a = [np.unique(rng.integers(0, 300, int(rng.integers(1, 200))).astype(np.uint64)) for _ in range(30)]
    b = [np.unique(rng.integers(0, 300, int(rng.integers(1, 200))).astype(np.uint64)) for _ in range(20)] + [np.array([2**63], dtype=np.uint64)]
    p, q = (x.ravel() for x in np.mgrid[:30, :21])
    want = [len(np.intersect1d(a[i], b[j])) for i, j in zip(p, q)]
    assert nj.common_sizes(a, b, p, q, few=0, width=50).tolist() == want == nj.common_sizes(a, b, p, q, few=10_000).tolist()


def test_sets_with_many_empty_parts_share_keys_only_where_they_link():
    spaces, rng = nj.Spaces(90, 100), np.random.default_rng(3)
    # All elements in few of the first hash's parts: strangers, and for each a near copy.
    few = [np.unique((rng.integers(0, 3, 100, dtype=np.uint64) << np.uint64(62)) + rng.integers(0, 2**40, 100, dtype=np.uint64)) for _ in range(40)]
    keys = [set(spaces.keys(s).tolist()) for s in few]
    assert not any(keys[i] & keys[j] for i in range(40) for j in range(i))
    for s, k in zip(few, keys):
        near = np.unique(np.concatenate([s[2:], rng.integers(0, 2**64, 2, dtype=np.uint64)]))
        assert k & set(spaces.keys(near).tolist())


def test_near_dedup_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in families(7)], "doc_id long, text string, _lost long, _lost_hash string")
    got = nj.near_dedup(docs)
    assert got.columns == docs.columns and all(r._lost == r.doc_id and r._lost_hash == "x" for r in got.collect())


def test_near_dedup_keeps_one_of_each_component(spark):
    rows = families(7)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = nj.near_dedup(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {d for d, _, c, _ in brute(rows, 5, 80, 100) if d == c}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nj.jaccard_components(docs).count() == 0 and nj.near_dedup(docs).count() == 0


def test_long_chain_and_hub(spark):
    from tidewright.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}
