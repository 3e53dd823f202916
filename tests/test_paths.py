"""Path operators against numpy and by hand."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewright.operators import paths


def test_surface_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random(40), rng.random(40)
    v, w = 3 + 2 * x - y + 0.5 * x * y, rng.random(40) + 0.5
    rows = spark.createDataFrame([("a", *map(float, t)) for t in zip(x, y, v, w)] + [("a", 0.1, 0.1, None, 1.0)], "k string, x double, y double, v double, w double")
    got = paths.ridge_surface(rows, ["k"], "x", "y", "v", "w", ridge=1e-9).first()
    terms = np.stack([x**0, x, y, x * x, x * y, y * y], axis=1)
    want = np.linalg.lstsq(terms * np.sqrt(w)[:, None], v * np.sqrt(w), rcond=None)[0]
    assert got["n"] == 40
    assert np.allclose(got["coefficients"], want, atol=1e-4)


def test_robust_line_leaves_out_the_worst(spark):
    points = [(i, float(i), 2.0 * i + 1 + (100.0 if i == 7 else 0.0)) for i in range(20)]
    rows = spark.createDataFrame([("a", *p) for p in points] + [("b", 0, 1.0, 5.0), ("c", 1, None, 5.0)], "k string, i int, x double, y double")
    got = {r["k"]: r for r in paths.robust_line(rows, ["k"], "i", F.col("x"), F.col("y"), F.lit(1.0)).collect()}
    assert got["a"]["n"] == 19 and abs(got["a"]["slope"] - 2) < 1e-9
    assert got["b"]["n"] == 1 and got["b"]["slope"] is None
    assert "c" not in got


def test_best_delay_finds_the_shift(spark):
    v = np.sin(np.arange(60) * 0.7) + np.arange(60) % 3
    rows = spark.createDataFrame([("k", i, float(v[i]), float(v[i - 2]) if i >= 2 else None) for i in range(60)], "k string, i long, a double, b double")
    got = paths.best_delay(paths.lagged_correlation(rows, ["k"], "i", "a", "b", 5), ["k"]).first()
    assert (got["lag"], got["n"]) == (2, 58) and got["r"] > 0.999


def test_density_adds_up_to_one(spark):
    rows = spark.createDataFrame([("k", float(x)) for x in np.linspace(40, 60, 101)] + [("k", None)], "k string, v double")
    got = paths.density(rows, ["k"], "v", 0.0, 100.0, 200, 2.0).agg(F.sum("density")).first()[0]
    assert abs(got * 0.5 - 1) < 1e-3


def test_thinning_and_empty_tables(spark):
    rows = spark.range(11).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    assert sorted(r["i"] for r in paths.downsampled(rows, ["k"], ["i"], 5).collect()) == [0, 5, 10]
    assert paths.downsampled(rows.where("false"), ["k"], ["i"], 5).count() == 0
