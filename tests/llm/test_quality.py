import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import quality as q


def corpus(n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        good = i % 4 != 0
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        text = " ".join(words) + "." if good else " ".join(w + rng.choice(["$$$", "***", "!!"]) for w in words[:10] * 4)
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus()
    edge = [(-1, None), (-2, ""), (-3, "word " * 50_000), (None, "a b c"), (1, rows[1][1])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + edge, "doc_id long, text string").withColumns({"score": F.lit("clash"), "y": F.lit(0)})
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 3] + [(None, 1), (2, None)], "doc_id long, quality int")
    measured = q.measure(docs)
    model = q.train(measured, labels)
    got = q.score(measured, model).collect()
    assert len(got) == len(rows) + len(edge) and all(0 <= r.score <= 1 for r in got)
    truth = {i: g for i, _, g in rows}
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 0 and r.doc_id % 3 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got)


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    v, w = rng.normal(size=6), rng.uniform(0.5, 2, 6)
    got = q.pool_adjacent_violators(v, w)
    # The largest lower mean over what ends here or later and starts here or earlier.
    want = [max(min(np.average(v[a : b + 1], weights=w[a : b + 1]) for b in range(i, 6)) for a in range(i + 1)) for i in range(6)]
    assert np.allclose(got, want)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    p = len(q.STATS)
    model = q.QualityModel(np.zeros(p), np.ones(p), rng.normal(size=(p, 4000)) / np.sqrt(p), rng.uniform(0, 2 * np.pi, 4000), np.zeros(4001), np.zeros(1), np.zeros(1))
    x = rng.normal(size=(5, p))
    phi = model.lifted(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * p))
    assert np.abs(phi @ phi.T - want).max() < 0.08


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.train(q.measure(docs), none) is None
    assert q.score(q.measure(docs), None).first().score == 0.5
    assert q.train(q.measure(docs.limit(0)), none) is None and q.score(q.measure(docs.limit(0)), None).count() == 0
