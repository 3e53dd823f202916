import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import aggregates, joins, series

KEY, ORDER = ["g"], ["t"]


def frame(spark, values, g="a"):
    return spark.createDataFrame([(g, i, float(v)) for i, v in enumerate(values)], "g string, t long, v double")


def adev(x, m):
    d = x[2 * m :] - 2 * x[m:-m] + x[: -2 * m]
    return np.sqrt((d**2).mean() / (2 * m * m))


def test_adev_of_flat_and_rising_phases_is_zero(spark):
    for x in (np.ones(50), np.arange(50) * 0.3):
        got = series.phase_adev(frame(spark, x), KEY, ORDER, "v", [1, 2, 4]).collect()
        assert all(r.adev == pytest.approx(0, abs=1e-9) for r in got)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-100, 100), min_size=12, max_size=40))
def test_adev_and_unwrap_match_numpy(spark, values):
    x = np.array(values)
    df = frame(spark, x)
    got = {r.tau: r.adev for r in series.phase_adev(df, KEY, ORDER, "v", [1, 2, 4]).collect()}
    assert all(got[m] == pytest.approx(adev(x, m), abs=1e-9) for m in (1, 2, 4))
    phases = [r.unwrapped for r in series.unwrapped(df, KEY, ORDER, "v").orderBy("t").collect()]
    assert np.allclose(phases, np.unwrap(x), atol=1e-6)


def test_half_turns_keep_their_sign(spark):
    x = [0.0, np.pi, 0.0, -np.pi, 0.0]
    got = [r.unwrapped for r in series.unwrapped(frame(spark, x), KEY, ORDER, "v").orderBy("t").collect()]
    assert np.allclose(got, np.unwrap(x))


def test_resampling_is_linear(spark):
    df = spark.createDataFrame([("a", 0.5, 5.0), ("a", 3.5, 35.0), ("a", 4.0, 0.0)], "g string, t double, v double")
    got = {r["at"]: r.value for r in series.resampled(df, KEY, "t", "v", 1).collect()}
    assert got == pytest.approx({1.0: 10.0, 2.0: 20.0, 3.0: 30.0, 4.0: 0.0})


def test_robust_split_leaves_small_and_flat_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.1), ("a", 0.9), ("a", 50.0), ("b", 1.0), ("b", 99.0), ("c", 5.0), ("c", 5.0), ("c", 9.0), ("a", None)], "g string, v double")
    out = {(r.g, r.v) for r in aggregates.robust_split(df, KEY, "v").where("outlier").collect()}
    assert out == {("a", 50.0)}


def test_weighted_line_and_median(spark):
    df = frame(spark, 3 * np.arange(10) + 1.0)
    r = aggregates.weighted_line(df, KEY, F.col("t"), F.col("v"), F.col("t") + 1).first()
    assert (r.slope, r.intercept, r.rms) == pytest.approx((3, 1, 0), abs=1e-6)
    m = spark.createDataFrame([("a", 1, 1.0, 1.0), ("a", 2, 2.0, 1.0), ("a", 3, 9.0, 5.0)], "g string, t long, v double, w double")
    assert aggregates.weighted_median(m, KEY, "v", "w", "t").first().weighted_median == 9.0


def test_modal_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([("a", 1, "y"), ("a", 2, "x"), ("a", 3, "x"), ("a", 4, "y")], "g string, t long, v string")
    assert aggregates.modal(df, KEY, "v", "t").first().v == "y"


def test_asof_joins(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 100.0), (3, 1000.0)], "id long, s double")
    right = spark.createDataFrame([(7, 9.0, 1.0), (8, 11.0, 2.0), (9, 130.0, -5.0)], "r long, rs double, v double")
    got = {x.id: x.r for x in joins.nearest(left, right, "id", "s", "rs", 60.0, ["r"], keep=F.col("v") > 0).collect()}
    assert got == {1: 7, 2: None, 3: None}
    back = joins.backward(left.withColumn("g", F.lit("a")), right.withColumn("g", F.lit("a")), ["g"], "s", "rs", ["r"])
    assert {x.id: x.r for x in back.collect()} == {1: 7, 2: 8, 3: 9}


def most_rows(plan):
    """The most rows that a node of an executed plan gave out."""
    metric = plan.metrics().get("numOutputRows")
    children = plan.children()
    return max([metric.get().value() if metric.isDefined() else 0, *(most_rows(children.apply(i)) for i in range(children.size()))])


def test_nearest_against_all_pairs_without_pairs(spark):
    draw = random.Random(5)
    odd = [None, math.nan, math.inf, -math.inf]
    times = lambda n: [draw.choice([draw.randrange(-400, 400) / 4, draw.randrange(-9, 9) * 60.0, draw.randrange(10_000)]) * 1.0 for _ in range(n)] + odd
    left = [(i, draw.choice("aab"), s) for i, s in enumerate(times(600))] + [(900, None, 0.0), (None, "a", 0.0), (901, "a", 0.0), (901, "a", 90.0)]
    right = [(i, draw.choice("aab"), s, draw.random()) for i, s in enumerate(times(600))] + [(900, None, 0.0, 0.5)]
    draw.shuffle(right)
    ask = {}
    for i, g, s in left:
        if i is not None and s is not None:
            ask.setdefault(i, []).extend((abs(t - s), r) for r, h, t, _ in right if h == g and g is not None and t is not None and abs(t - s) <= 60)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.nearest(spark.createDataFrame(left, "id long, g string, s double"), spark.createDataFrame(right, "r long, g string, rs double, v double"), "id", "s", "rs", 60.0, ["r"], ["g"])
        got = sorted(((x.id, x.r) for x in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == sorted(((i, min(ask.get(i) or [(0, None)])[1]) for i, _, _ in left), key=str)
    assert sum(map(len, ask.values())) > 10 * (len(left) + len(right)) and most_rows(out._jdf.queryExecution().executedPlan()) < 4 * (len(left) + len(right))


def test_sessions_and_runs(spark):
    df = frame(spark, [1, 9, 9, 1, 9]).withColumn("ts", F.timestamp_seconds(F.col("t") * F.when(F.col("t") > 2, 100).otherwise(1)))
    assert {(r.session, r.n) for r in series.sessions(df, KEY, ORDER, "ts", 50).collect()} == {(1, 3), (2, 1), (3, 1)}
    assert [(r.first, r.last, r.length) for r in series.runs(df, KEY, ORDER, F.col("v") > 5, 2).collect()] == [(1, 2, 2)]
