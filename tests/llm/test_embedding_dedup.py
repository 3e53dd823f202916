import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import embedding_dedup as ed


def brute(rows, cosine=0.93):
    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, near = len(rows), {i: set() for i in range(len(rows))}
    for i in range(n):
        for j in range(n):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if i != j and a is not None and a == b and usable(x) and usable(y) and len(x) == len(y):
                x, y = np.array(x, dtype=float), np.array(y, dtype=float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    near[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(0)
    rows, i = [], 0
    for _ in range(12):
        c = rng.normal(size=16)
        for _ in range(10):
            rows.append((i, int(rng.integers(0, 2)), (c + rng.normal(size=16) * rng.choice([0, 0.1, 0.3, 0.4])).astype(np.float32).tolist()))
            i += 1
    rows += [(500, 0, None), (501, 0, [0.0] * 16), (502, 0, [float("nan")] + [1.0] * 15), (503, 0, [None] + [1.0] * 15), (504, None, rows[0][2]), (505, 0, [float("inf")] * 16), (506, 0, []), (507, 0, [1.0] * 7), (508, 0, [2.0] * 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"entry": F.lit("clash"), "size": F.lit(1)})
    got = sorted(tuple(r) for r in ed.near_links(vectors, lists=8, codewords=16, block=block).collect())
    assert got == brute(rows)


def test_probes_hold_all_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = ed.train(x, 16, 4, 16)
    at, reach = q.lists(x), 0.374
    _, error = q.encode(x, at)
    probes, asks = q.probes(x, at, reach), q.asks(x, at, reach)
    for i in range(0, 600, 7):
        near = np.flatnonzero(np.linalg.norm(x - x[i], axis=1) <= reach)
        assert set(at[near]) <= set(probes[i])
        assert all((at[j] in asks[i]) + (at[i] in asks[j]) == (2 if at[i] == at[j] else 1) for j in near)
        for j in near:
            codes, _ = q.encode(x[j : j + 1], at[j : j + 1])
            table = q.tables(x[i : i + 1], at[j])
            guess = np.sqrt(sum(table[0, k, codes[0, k]] for k in range(4)))
            assert guess <= reach + error[j] + 1e-7


def test_empty_table_and_ids(spark):
    shape = "vec_id long, label int, embedding array<float>"
    assert ed.near_links(spark.createDataFrame([], shape)).count() == 0
    rows = spark.createDataFrame([(None, 1, [1.0, 2.0]), (3, 1, [1.0, 2.0]), (3, 1, [1.0, 2.0]), (4, 1, [2.0, 4.0])], shape)
    got = sorted([tuple(r) for r in ed.near_links(rows).collect()], key=str)
    assert got == sorted([(None, 0, None, False), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False)], key=str)
