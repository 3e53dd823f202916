import random

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import toxicity as tox

CLEAN = "the of and a to in is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their".split()


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.choice([1, 3, 8])):
                words.insert(rng.randrange(len(words)), rng.choice(["Grumbler", "nasto" + rng.choice("abcdef")]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edge_cases(spark):
    rows, labels = corpus()
    edge = [(-1, None), (-2, ""), (-3, "grumbler " * 40_000), (None, "grumbler grumbler grumbler"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string").withColumns({"grade": F.lit("clash"), "_y": F.lit(1)})
    marks = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = tox.train(docs, marks)
    got = tox.score(docs, model).collect()
    truth = {i: bool(t) for i, _, t in labels}
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 0 and r.doc_id % 3 == 0]
    assert sum(r.toxic == truth[r.doc_id] for r in held) / len(held) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert not by_id[-1].toxic and not by_id[-2].toxic and by_id[-3].toxic and by_id[None].toxic
    assert len({r.expected_severity for r in got if r.doc_id == 0}) == 1
    assert list(model.thresholds) == sorted(model.thresholds)


def test_severity_rises_with_insults():
    rng = np.random.default_rng(0)
    n = 600
    counts = rng.integers(0, 4, n)
    rows = np.repeat(np.arange(n), counts)
    cols = np.concatenate([np.arange(c) for c in counts]) if counts.sum() else np.array([], dtype=int)
    w, theta = tox.fit_ordinal(rows, cols.astype(int), counts, 3, 4)
    model = tox.OrdinalModel({}, tuple(theta))
    p = model.grades(np.array([0, w[0], w[:2].sum(), w.sum()]))
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(p @ np.arange(4)) > 0.5).all()


def test_gradient_of_the_likelihood():
    rows, cols, y = np.array([0, 1, 1, 3]), np.array([0, 0, 1, 1]), np.array([0, 2, 1, 1])
    w, theta = tox.fit_ordinal(rows, cols, y, 2, 3, l2=0.05, steps=3000, rate=0.02)

    def loss(w, theta):
        s = np.bincount(rows, weights=w[cols], minlength=4)
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        f = lambda z: 1 / (1 + np.exp(-z))
        return -np.log(f(cut[y + 1] - s) - f(cut[y] - s)).mean() + 0.025 * (w @ w)

    base = loss(w, theta)
    for i in range(2):
        for d in (-0.02, 0.02):
            assert loss(w + d * np.eye(2)[i], theta) >= base - 1e-6
            assert loss(w, theta + d * np.eye(2)[i]) >= base - 1e-6


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.train(docs, none) is None
    assert tox.score(docs, None).first().toxic is False
    assert tox.train(docs.limit(0), none) is None and tox.score(docs.limit(0), None).count() == 0


def test_partitions_that_end_on_a_flush_or_have_no_rows(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, cut = (tox.train(docs, marks, least_ratio=3.0, flush_at=n) for n in (100_000, 0))
    assert whole.weights and whole == cut


def test_clashing_columns_come_back_whole(spark):
    docs = spark.createDataFrame([(1, "a fiend", "keep", True)], "doc_id long, text string, grade string, _judged boolean")
    model = tox.OrdinalModel({"=fiend": 0.1}, (2.0, 3.0))
    assert tox.clean_rows(docs, model).collect() == docs.collect()
    assert tox.clean_rows(docs, tox.OrdinalModel({"=fiend": 9.0}, (2.0, 3.0))).count() == 0
    assert tox.score(docs, model).columns == ["doc_id", "text", "grade", "_judged", "expected_severity", "toxic"]
