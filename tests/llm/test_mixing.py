from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import mixing


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 1000, 0], [1, 2, 3]) == pytest.approx([30, 980, 0])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(0, 1000, 7).tolist()
        got = mixing.targets(sizes, [1, 2, 3, 1, 2, 3, 1])
        assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))
        under = [t / w for t, s, w in zip(got, sizes, [1, 2, 3, 1, 2, 3, 1]) if t < 3 * s - 1e-6]
        assert not under or max(under) == pytest.approx(min(under))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096])
def test_permutations(n):
    for key in (0, 1, 99):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096])
def test_permutations_back(n):
    at = np.arange(n)
    for key in (0, 1, 99):
        there = mixing.permuted(at, np.full(n, n), np.full(n, key))
        assert (mixing.permuted(there, np.full(n, n), np.full(n, key), back=True) == at).all()


def test_slots_hold_the_words():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 400, 3000)
    words = rng.integers(0, 3 * size + 1)
    slots, ended = mixing.slots_for(words, size, 32, 7)
    for s in range(len(size)):
        blocks, taken = -(-size[s] // 32), 0
        for i in range(slots[s]):
            k = mixing.permuted(np.array([i % blocks]), np.array([blocks]), mixing.keys(7, np.array([s]), np.array([i // blocks])))[0]
            has = min(32, size[s] - 32 * k)
            taken += min(has, ended[s]) if i == slots[s] - 1 else has
        assert taken == words[s] and (not slots[s] or ended[s] > 0)


def test_sources_of_less_than_a_block(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40 + i * 37 % 81)), f"s{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs)[0].collect()
    assert len(got) == 300 and all(abs(r.taken - r.target) <= 1 and r.taken > 0 for r in got)
    assert sum(r.taken for r in got) == sum(r["size"] for r in got)
    out = mixing.mixed(docs).collect()
    assert {r.doc_id for r in out} == set(range(300))
    assert sum(len(r.text.split()) for r in out) == sum(r["size"] for r in got)


def test_draws_add_up():
    slots = np.array([100, 0, 7, 1000])
    draws = mixing.shard_draws(slots, 9, 1)
    assert (draws.sum(axis=0) == slots).all() and (draws >= 0).all()
    assert (draws == mixing.shard_draws(slots, 9, 1)).all()


ROWS = [(i, f"w{i} " * (i % 50 * 20), f"s{i % 3}") for i in range(300)] + [(1000, None, "s0"), (1001, "", None), (1002, "a b c", None), (1003, " ", "empty"), (5, "w5 " * 100, "s2"), (None, "x y", "s1"), (2000, "long " * 60_000, "s0")]


def test_mix_against_its_rules(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"_s": F.lit("clash"), "taken": F.lit(None)})
    rows, parts = mixing.mix(docs, block=32)
    got = rows.collect()
    words = [len((t or "").split()) for _, t, _ in ROWS]
    assert sorted(r["size"] for r in got) == sorted(words)
    sources = Counter()
    for (_, _, s), n in zip(ROWS, words):
        sources[s] += n
    order = sorted([s for s in sources if s is not None]) + [None]
    want = dict(zip(order, mixing.targets([sources[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    taken = Counter()
    for r in got:
        assert r.source_size == sources[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 64 for s in order)
    assert all(0 <= p._from < p._to and 1 <= p._times <= 3 for p in parts.collect())
    again, _ = mixing.mix(docs.repartition(5), block=32)
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))


def test_mixed_texts_hold_what_is_taken(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, source string, n_chars int")
    out = mixing.mixed(docs, block=32)
    assert out.schema == docs.schema
    rows = out.collect()
    got, want = Counter(), Counter()
    for r in rows:
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    for r in mixing.mix(docs, block=32)[0].collect():
        want[r.doc_id] += r.taken
    assert got == +want
    whole = {i: t for i, t, _ in ROWS}
    assert all(set(r.text.split()) <= set(whole[r.doc_id].split()) for r in rows)


def test_cut_keeps_what_stands_between():
    assert mixing.cut("a  b\tc d", 4, [(0, 2), (3, 4)]) == "a  b\nd"
    assert mixing.cut(" a b ", 2, [(0, 2)]) == " a b "
    assert mixing.ranges_taken([(0, 5, 2), (5, 9, 1), (9, 12, 3)], 2) == [(0, 5), (9, 12)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs)[0].count() == 0 and mixing.mixed(docs).count() == 0


def test_shards_follow_their_draws(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"_held": F.lit("clash"), "_own1": F.lit(1), "_text": F.lit(2)})
    params = {"block": 32, "shard_slots": 64}
    out = [r for r in mixing.packed(docs, **params).collect()]
    rows = mixing.mix(docs, **params)[0].collect()
    # Every source's slots are all filled, once each, with what the mix takes.
    assert len({(r.source, r.slot) for r in out}) == len(out) and all(r.n_words == len(r.text.split()) for r in out)
    taken, words, slots = Counter(), Counter(), Counter()
    for r in rows:
        taken[r.source] += r.taken
    for r in out:
        words[r.source] += r.n_words
        slots[r.source] += 1
    assert words == +taken
    order = sorted(s for s in slots if s is not None) + [None]
    draws = mixing.shard_draws(np.array([slots[s] for s in [*order[:-1], None]]), max(1, -(-len(out) // 64)), 11)
    got = Counter((r.shard, r.source) for r in out)
    # Sources without slots have no part in a draw, but hold a place in it: compare sums by shard.
    assert [sum(n for (h, _), n in got.items() if h == i) for i in range(len(draws))] == draws.sum(axis=1).tolist()
    shares = {s: slots[s] / len(out) for s in order}
    big = [h for h in range(len(draws)) if draws[h].sum() >= 60]
    assert big and all(abs(got[(h, s)] / draws[h].sum() - shares[s]) < 0.35 for h in big for s in order)
    by_row = {(r.doc_id, r["size"]): r.n_shards for r in rows}
    assert all((n > 0) == (taken_words > 0) for (n, taken_words) in ((r.n_shards, r.taken) for r in rows)) and max(by_row.values()) > 1


def test_clashing_columns_come_back_whole(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 200, "s", "keep", 7) for i in range(20)], "doc_id long, text string, source string, _h1 string, _lists long")
    assert {(r._h1, r._lists) for r in mixing.mixed(docs).collect()} == {("keep", 7)}
