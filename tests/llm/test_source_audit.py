"""The audit against sums in plain integers, and the tries by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewright.llm.source_audit import LETTERS, RadixTrie, audit, counted, kept_terms, shares
from tidewright.llm.lexical_search import terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least_docs, top):
    rows = [(plain_terms(t), lang or "", source or "") for t, lang, source in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang, source) for _, lang, source in rows})
    for t, lang, source in rows:
        docs[lang].update(set(t))
        count[lang, source].update(t)
    out = []
    for lang in sorted({g[0] for g in groups}):
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        v = len(kept)
        names = [s for at, s in groups if at == lang]
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * v)
        total = {s: sum(count[lang, s][t] for t in kept) for s in names}
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in names}
        q = {t: share(sum(count[lang, s][t] for s in names), sum(total.values())) for t in kept}
        for s in names:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in names if o != s))
            terms_ = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, name, -value, i + 1) for part, found in (("pair", pairs), ("term", terms_)) for i, (value, _, name) in enumerate(found)]
    return sorted(out)


def invented(n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abéß中\U0001f600") for _ in range(draw.randint(1, 5))) for _ in range(60)]
    rows = []
    for _ in range(n):
        text = draw.choice([None, "", "1 2 3"]) if draw.random() < 0.1 else " ".join(draw.choice(words[: draw.randint(1, 60)]) for _ in range(draw.randint(1, 25)))
        rows.append((text, draw.choice(["en", "de", None, "xx"]), draw.choice(["s1", "s10", "S2", None, "é", "hot", "hot", "hot"])))
    return rows + [("only here", "zz", "a"), ("only here", "zz", "a"), (None, "yy", "b"), ("9", "yy", "c"), ("q" * 50_000 + " Ab", "en", "long")]


@pytest.mark.parametrize("least_docs, top, cells", [(5, 50, 1_000_000), (3, 4, 20), (1, 2, 1), (10_000, 50, 10)])
def test_equals_plain_sums(spark, least_docs, top, cells):
    rows = invented(400, least_docs)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, value int").repartition(5)
    got = audit(docs, least_docs=least_docs, top=top, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least_docs, top)


def test_small_hand_ons_and_merges(spark):
    rows = invented(300, 77)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").fillna("")
    whole, parts = kept_terms(counted(docs.coalesce(1)), 3), kept_terms(counted(docs.repartition(6), prefix=1, most_entries=1), 3, most_bytes=40)
    plain = lambda df: sorted((r.lang, r.term, tuple(sorted(zip(r.source, r["count"])))) for r in df.collect())
    assert plain(whole) == plain(parts)


def test_many_packs_of_languages(spark, monkeypatch):
    from tidewright.llm import source_audit

    rows = invented(200, 5)
    monkeypatch.setattr(source_audit, "MOST_GROUPS", 4)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, audit(docs, least_docs=4).collect())) == brute(rows, 4, 50)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert audit(empty).collect() == []


def leaves_of(trie):
    out, place = {}, 0
    for leaf, docs, fan in zip(trie.leaves, trie.docs, trie.fan):
        out[leaf] = (int(docs), {trie.names[s]: int(c) for s, c in zip(trie.source[place : place + fan], trie.count[place : place + fan])})
        place += fan
    return out


TRIES = st.dictionaries(st.binary(min_size=1, max_size=90), st.dictionaries(st.sampled_from(["a", "b", "é", ""]), st.integers(1, 2**40), min_size=1), min_size=1, max_size=12)


def trie_of(found):
    leaves, names = sorted(found), sorted({s for c in found.values() for s in c})
    flat = [(names.index(s), n) for leaf in leaves for s, n in sorted(found[leaf].items())]
    return RadixTrie(leaves, np.array([len(found[x]) for x in leaves], np.int64), np.array([len(found[x]) for x in leaves], np.int64), np.array([s for s, _ in flat], np.int64), np.array([n for _, n in flat], np.int64), names)


@given(TRIES)
def test_trie_comes_back_from_its_bytes(found):
    trie = trie_of(found)
    assert leaves_of(RadixTrie.from_bytes(trie.to_bytes())) == leaves_of(trie)


@given(st.lists(TRIES, min_size=1, max_size=4))
def test_merging_adds_counters(parts):
    want = defaultdict(lambda: [0, Counter()])
    for part in parts:
        for leaf, counts in part.items():
            want[leaf][0] += len(counts)
            want[leaf][1].update(counts)
    merged = RadixTrie.merged([trie_of(p) for p in parts])
    assert leaves_of(merged) == {leaf: (d, dict(c)) for leaf, (d, c) in want.items()}
    assert merged.leaves == sorted(merged.leaves)


@given(st.integers(0, 2**52), st.integers(0, 2**52), st.integers(1, 10**6))
def test_shares_are_exact(count, more, n_terms):
    assert int(shares(np.array([count]), np.array([count + more]), n_terms)[0]) == 1 + 10**9 * (count + 5) // (count + more + 5 * n_terms)


def test_terms():
    text = "Äb\x80c\x7fD-9_é [x]\x00　{Y}a1b"
    assert [t.decode() for t in terms(text, LETTERS)] == plain_terms(text)
