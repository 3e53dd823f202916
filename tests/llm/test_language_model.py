import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import common
from tidewright.llm import language_model as lm

ROWS = [
    (1, "The cat sat on the mat. The cat sat."),
    (2, "the dog sat on THE rug"),
    (3, None),
    (4, ""),
    (5, "Ünïque wörds, the only ones here"),
    (5, "Ünïque wörds, the only ones here"),
    (6, "the cat " * 500),
    (None, "the cat"),
]


def brute(rows, held):
    def tokens(t):
        return [*(t or "").encode().lower().split(), b"\n"]

    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return Counter(
        (i, held(i), len(tokens(t)), sum(w in c for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for i, t in rows
    )


@pytest.mark.parametrize("head", [4, 1000])
def test_base_matches_brute_force(spark, head):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = lm.score(docs, F.col("doc_id") == 2, head=head, own=3).collect()
    want = brute(ROWS, lambda i: i == 2)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_head_size_does_not_change_scores(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in lm.score(docs, F.col("doc_id") == 2, head=h, own=3).collect()} for h in (4, 1000))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_probabilities_add_up_to_one():
    counts = np.array([5.0, 3.0, 2.0, 9.0])
    first, norm = lm.LogBilinear.start(counts).tables()
    p = np.exp(first[0][:, None, :] + first[1][None, :, :] - norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-5)


def test_training_learns_a_pattern():
    counts = np.array([100.0, 100.0, 100.0])
    trainer = lm.Trainer(lm.LogBilinear.start(counts), counts, np.random.default_rng(0))
    c = np.tile([0, 1, 2], 3000)
    for _ in range(60):
        trainer.step(c[1:-1], c[:-2], c[2:])
    first, norm = trainer.m.tables()
    p = np.exp(first[0][1] + first[1][0] - norm[1, 0])
    assert p[2] > 0.8


def test_two_levels_add_up_to_one():
    counts = np.sort(np.random.default_rng(1).integers(2, 5000, 3000 + lm.SHAPES))[::-1].astype(float)
    model, k = lm.LogBilinear.start(counts), 3000 + lm.SHAPES
    assert model.starts[-1] == k and 1 < np.diff(model.starts).max() <= lm.WIDEST
    assert (np.diff(model.starts)[-lm.SHAPES :] == 1).all()
    tables = model.tables(100)
    for p1, p2 in ((0, 5), (2500, 3), (7, 2900)):
        assert np.exp(model.log_p(np.full(k, p1), np.full(k, p2), np.arange(k), tables)).sum() == pytest.approx(1, abs=1e-4)


def test_words_beyond_rank_480_learn_from_what_stands_before():
    k = 1000 + lm.SHAPES
    counts = np.full(k, 50.0)
    trainer = lm.Trainer(lm.LogBilinear.start(counts), counts, np.random.default_rng(0))
    assert len(trainer.m.top_bias) < 1000
    p1 = np.tile(np.arange(500), 16)
    for _ in range(150):
        trainer.step(p1, np.zeros_like(p1), p1 + 500)
    at, before = np.arange(500), np.zeros(500, dtype=np.int64)
    right = trainer.m.log_p(at, before, at + 500, trainer.m.tables(100))
    assert np.exp(right).mean() > 20 / k


def test_rare_words_score_by_context(spark):
    rng = np.random.default_rng(0)
    rows = [(j, " ".join(f"a{i} b{i}" for i in rng.integers(0, 600, 400))) for j in range(300)]
    docs = spark.createDataFrame([*rows, (1000, " ".join(f"a{i} b{i}" for i in range(600)))], "doc_id long, text string").coalesce(1)
    vocab = lm.vocabulary(lm.count_tokens(docs))
    assert vocab.own == 1201
    got = lm.score(docs, F.col("doc_id") == 1000).where("held_out").first()
    assert got.score > got.base_score + 100


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, F.lit(False)).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    from tidewright.llm.registry import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op6_language_model"](spark, sf_dir).collect()
    want = brute(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_head_is_filled_from_the_bin_at_the_border(spark):
    words = [f"w{i:02d}" for i in range(60)]
    counts = lm.count_tokens(spark.createDataFrame([(" ".join(words),), ("w59 w59 w58",)], "text string"))
    for head in (1, 2, 3, 50, 61, 100):
        assert list(lm.vocabulary(counts, head=head, own=head).rank) == [b"w59", lm.END, b"w58", *[w.encode() for w in words[:-2]]][:head]


def test_groups_are_normalised_by_products(monkeypatch):
    monkeypatch.setattr(lm, "PRODUCTS", 2500, raising=False)
    rng = np.random.default_rng(1)
    k, n = 3000 + lm.SHAPES, 20_000
    counts = np.sort(rng.integers(2, 5000, k))[::-1].astype(float)
    model = lm.LogBilinear.start(counts)
    p1, p2, c = rng.integers(100, 2500, n), rng.integers(100, 2500, n), rng.integers(0, k, n)
    p1[:300], p2[300:600] = rng.integers(2500, k, 300), rng.integers(2500, k, 300)
    taken, exp = [], np.exp
    tables = model.tables(100)
    with monkeypatch.context() as m:
        m.setattr(np, "exp", lambda x, *a, **o: taken.append(np.size(x)) or exp(x, *a, **o))
        model.log_p(p1, p2, c, tables)
    # The sums of some now leave the range of floats.
    rows = model.rows()
    rows[:, :16] *= 5
    rows[200:210, :16] *= 2000
    model = model.with_rows(rows, model.shared())
    got = model.log_p(p1, p2, c, model.tables(100))
    x = (model.inputs[p1] * model.positions[0] + model.inputs[p2] * model.positions[1]).astype(float)
    groups = model.group_of()[c]
    assert sum(taken) < 0.8 * (n * len(model.top_bias) + np.diff(model.starts)[groups].sum())
    top = x @ model.tops.T.astype(float) + model.top_bias
    want = top[np.arange(n), groups] - np.logaddexp.reduce(top, axis=1)
    every = x @ model.outputs.T.astype(float) + model.bias
    for g in np.unique(groups):
        at, held = groups == g, slice(model.starts[g], model.starts[g + 1])
        want[at] += every[at, c[at]] - np.logaddexp.reduce(every[at, held], axis=1)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_batches_have_the_words_of_their_texts():
    texts = [None, "", "  a\x0bB\x1c\x1d c\x85d\xa0e f \t", "\n\r\f", "\xdcnÏ X\x00y", "\u212a K", " lead", "trail "]
    for some in (texts, texts[3:], [], [None]):
        found, n = lm.batch_words(pa.array(some, pa.string()))
        assert found.to_pylist() == [w for t in some for w in common.words(t)] and n.tolist() == [len(common.words(t)) for t in some]


def test_tokens_have_few_classes_in_their_groups():
    k = 50_000 + lm.SHAPES
    counts = np.concatenate([1e6 / np.arange(1, 50_001), np.full(lm.SHAPES, 10.0)])
    starts = lm.group_starts(counts)
    sizes = np.diff(starts)
    assert starts[0] == 0 and starts[-1] == k and 1 <= sizes.min() and sizes.max() <= lm.WIDEST
    assert len(sizes) < np.sqrt(k) + lm.SHAPES
    inside = np.repeat(np.where(sizes > 1, sizes, 0), sizes)
    assert (counts * inside).sum() / counts.sum() < 0.5 * np.sqrt(k)


def test_tasks_send_what_they_learnt_in_pieces(monkeypatch):
    monkeypatch.setattr(lm.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 5})())
    counts = np.full(3000, 50.0)
    trainer = lm.Trainer(lm.LogBilinear.start(counts), counts, np.random.default_rng(0))
    p1 = np.arange(2000)
    trainer.step(p1, p1, p1 + 500)
    frames = list(lm._sent(trainer, together=3))
    assert max(len(f) for f in frames) == 3
    every = [r for f in frames for r in f.itertuples()]
    assert [r.stripe for r in every] == [-1, *range(len(every) - 1)] and {r.part for r in every} == {5}
    at, weight = (np.concatenate([np.frombuffer(getattr(r, c), kind) for r in every[1:]]) for c, kind in (("at", np.int32), ("weight", np.int64)))
    touched = np.flatnonzero(trainer.touched)
    assert at.tolist() == touched.tolist() and weight.tolist() == trainer.touched[touched].tolist()
    values = np.concatenate([np.frombuffer(r.values, np.float32) for r in every[1:]])
    assert (values == trainer.m.rows()[touched].ravel()).all()
