import math

import numpy as np
from pyspark.sql import functions as F

from tidewright.operators import reports
from tidewright.sources import text


COLUMNS = "h int, s string, b string, v double, w double"


def fused(spark, rows, **more):
    return {r.h: r for r in reports.fusion_cycle(spark.createDataFrame(rows, COLUMNS), "h", "s", "b", "v", "w", **more).collect()}


def test_fusion_cycle_gates_coasts_and_holds(spark):
    rows = [(h, s, f"{s}{b}", 10.0 + 0.1 * b + (20.0 if h == 5 else 0.0), 1.0) for h in range(12) for s in "ab" for b in (1, 2) if not (h in (3, 4) and s == "b")]
    rows += [(0, "a", "a1", 500.0, 1.0), (1, "a", "a1", None, 1.0), (1, "a", "a1", math.nan, 1.0)]
    got = fused(spark, rows)
    assert got[0].n == 5 and got[0].used == 4 and abs(got[0].raw - 10.15) < 1e-9
    assert not got[3].locked and got[3].coasting and got[3].grade == "D" and abs(got[3].fused - 10.15) < 1e-9 and got[3].uncertainty > got[2].uncertainty
    # A jump is held for a cycle, and so is the way back.
    assert got[5].jumped and abs(got[5].fused - 10.15) < 1e-9 and got[6].jumped and abs(got[6].fused - 30.15) < 1e-9 and not got[7].jumped
    assert fused(spark, []) == {}


def test_all_rejected_keeps_all(spark):
    got = fused(spark, [(0, s, s, v, 1.0) for s, v in (("a", -500.0), ("b", -490.0), ("c", 490.0), ("d", 500.0))])[0]
    assert got.used == 4 and got.raw == 0


def test_fused_value_is_never_tighter_than_what_it_came_from(spark):
    rows = [(0, s, f"{s}{i}", 10.0 + off, 100.0) for s in "ab" for i in range(50) for off in (-1.0, 1.0)]
    assert abs(fused(spark, rows)[0].uncertainty - 1.0) < 1e-9
    assert abs(fused(spark, [(0, s, s, 10.0, 4.0) for s in "abcd"])[0].uncertainty - 0.25) < 1e-9  # formal: 1 / sqrt(16)


def test_uncertainty_grows_while_coasting(spark):
    rows = [(0, s, s, 10.0, 50.0) for s in "ab"] + [(h, "a", "a", 300.0, 1e-4) for h in (1, 120, 1200, 12_000)]
    got = fused(spark, rows)
    grown = [got[h].uncertainty for h in (1, 120, 1200, 12_000)]
    assert grown == sorted(grown) and grown[-1] > grown[0] and abs(grown[1] - math.hypot(0.1, 0.12)) < 1e-9 and grown[3] == 10.0
    assert all(got[h].fused == 10.0 and got[h].coasting for h in (1, 120, 1200, 12_000))
    # Before the first lock there is nothing to coast on.
    first = fused(spark, [(5, "a", "a", 7.0, 1.0)])[5]
    assert not first.coasting and first.fused == 7.0 and first.uncertainty == 1.0


def test_anchor_is_no_source(spark):
    rows = [(0, "a", "a1", 1.0, 1.0), (0, "GLOBAL", None, 2.0, 3.0)]
    got = fused(spark, rows, anchor="GLOBAL")[0]
    assert not got.locked and got.sources == 1 and got.broadcasts == 1 and got.used == 2 and got.raw == 1.75


def test_variance_weight(spark):
    rows = spark.createDataFrame([(0.5, "A", "1E"), (2.0, "A", "1E"), (None, "B", "2F"), (0.0, "x", None), (1e-9, "C", "3F"), (1e6, "D", "zz")], "s double, g string, m string")
    got = [r[0] for r in rows.select(reports.variance_weight(F.col("s"), F.col("g"), F.col("m"))).collect()]
    assert got[0] == 4.0 and got[0] / got[1] == 16.0
    assert np.allclose(got[2:], [0.9 * 0.85, 0.5 * 0.7, 0.7 * 0.7 / 0.05**2, 0.01])


def test_logistic_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.7 * x[:, 1] + 0.3)))
    rows = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)] + [(None, 1.0, 1)], "a double, b double, y int")
    w = np.array(reports.logistic_fit(rows, ["a", "b"], "y"))
    full = np.hstack([x, np.ones((600, 1))])
    gradient = full.T @ (y - 1 / (1 + np.exp(-full @ w)))
    assert np.abs(gradient).max() < 1e-4 and np.abs(w - [1.5, -0.7, 0.3]).max() < 0.4
    assert reports.logistic_fit(rows.where("y = 1"), ["a", "b"], "y") == [0.0, 0.0, 0.0]


def test_merged_statistics_keep_their_digits(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("part"), (F.col("id") % 3 + 1e9).alias("v"), F.lit("k").alias("k"))
    got = reports.merged_statistics(rows, ["k"], F.col("part"), "v").first()
    values = np.array([i % 3 for i in range(1000)], dtype=float)
    assert got.n == 1000 and abs(got.variance - values.var(ddof=1)) < 1e-7  # sums of squares would be off by over 100


def test_recent(spark, sf_dir):
    assert reports.recent(spark.createDataFrame([], "ts timestamp"), "ts", 10.0).count() == 0
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") / 2).alias("ts"), "id")
    assert sorted(r.id for r in reports.recent(rows, "ts", 1.5).collect()) == [97, 98, 99]
    assert reports.recent(rows, "ts", 5.0, base=rows.where("id < 50")).count() == 60
    stored = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = reports.recent(stored, "ts", 3600.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in plan


def test_time_daemon_reports(spark):
    lines = ["MS Name/IP address         Stratum Poll Reach LastRx Last sample", "^* 192.0.2.3   1   2   377     2m  +4441ns[+4565ns] +/-   84us", "#- PPS 0 4 17 - -1.5ms[ -1ms] +/- 10ms", "junk"]
    got = text.time_sources(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("^", "*", "192.0.2.3", 1, 2, 255, 120, 4.441, 84.0), ("#", "-", "PPS", 0, 4, 15, None, -1500.0, 10_000.0)]
    lines = ["Name/IP Address            NP  NR  Span  Frequency  Freq Skew  Offset  Std Dev", "=====", "PPS   7   4     6     +0.001      0.012    +13us    10ns", "short 1 2"]
    got = text.source_statistics(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("PPS", 7, 0.001, 0.012, 13.0, 0.01)]
