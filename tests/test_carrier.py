"""Content from phase: ramps, planted slips, gaps and jumps against a plain loop; anchors; differences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import carrier

SCALE = -(299_792_458.0 * 10e6) / (2 * math.pi * 40.3e16)


def by_loop(rows, slip=5.0, longest=120.0):
    out, total, segment, last_hz, last_dt = [], 0.0, 0, None, None
    for i, (t, p) in enumerate(rows):
        event = None
        if i:
            dt = t - rows[i - 1][0]
            step = (p - rows[i - 1][1] + math.pi) % (2 * math.pi) - math.pi
            hz = step / (2 * math.pi * dt)
            if dt > longest:
                event = "gap"
            elif last_hz is not None and last_dt <= longest and abs(hz - last_hz) / dt > slip:
                event = "slip"
            elif abs(step) > math.pi / 2:
                event = "jump"
            if event in ("gap", "slip"):
                segment += 1
            else:
                total += step
            last_hz, last_dt = hz, dt
        out.append((t, SCALE * total, segment, event))
    return out


def phases():
    draw, rows, t, p = random.Random(2), [], 0.0, 0.0
    for i in range(400):
        t += 1000.0 if i == 200 else draw.choice([0.02, 0.05, 1.0])
        p += draw.uniform(-0.2, 0.3) + (3.0 if i in (50, 51, 300) else 0.0) + (2.0 if i == 350 else 0.0)
        rows.append((t, (p + math.pi) % (2 * math.pi) - math.pi))
    return rows


@pytest.mark.parametrize("block", [3.0, 50.0, 1e9])
def test_equals_a_loop(spark, block):
    rows = phases()
    bad = [("a", None, 1.0, 10.0), ("a", 5.5, None, 10.0), ("a", 5.6, float("nan"), 10.0), ("a", 5.7, 1.0, 0.0), ("a", 5.8, 1.0, -1.0), ("a", rows[9][0], rows[9][1] + 1, 10.0)]
    df = spark.createDataFrame([("a", *r, 10.0) for r in rows] + [("b", *r, 10.0) for r in rows[:7]] + bad, "k string, t double, p double, f double").repartition(4)
    got = carrier.relative_content(df, ["k"], "t", "p", "f", F.floor(F.col("t") / block)).orderBy("t").collect()
    for key, some in (("a", rows), ("b", rows[:7])):
        mine = [r for r in got if r.k == key]
        want = by_loop(some)
        assert [(r.t, r.segment, r.event) for r in mine] == [(w[0], w[2], w[3]) for w in want]
        assert max(abs(r.content - w[1]) for r, w in zip(mine, want)) < 1e-12
    assert {r.event for r in got} >= {"gap", "slip", None}


def test_gentle_ramp_and_jumps(spark):
    ramp = [("r", float(i), 0.005 * i, 10.0) for i in range(120)]
    steps = [("s", float(i), 2.0 if i in (5, 10, 15, 20, 25) else 0.0, 10.0) for i in range(30)]
    got = carrier.relative_content(spark.createDataFrame(ramp + steps, "k string, t double, p double, f double"), ["k"], "t", "p", "f", F.lit(0))
    counts = {(r.k, r.event): r["count"] for r in got.groupBy("k", "event").count().collect()}
    assert counts == {("r", None): 120, ("s", None): 20, ("s", "jump"): 10}
    last = got.where("k = 'r' and t = 119").first()
    assert last.content == pytest.approx(SCALE * 0.005 * 119) and last.rate == pytest.approx(SCALE * 0.005)


def test_anchors(spark):
    series = spark.createDataFrame([("k", 10.0 * i, 10.0, 0.1 * i, None, i // 20, None) for i in range(60)], "k string, t double, f double, content double, rate double, segment long, event string")
    anchors = spark.createDataFrame([("k", 53.0, 20.0, 0.5), ("k", 58.0, 99.0, 0.5), ("k", 480.0, 7.0, None), ("x", 10.0, 1.0, 1.0), ("k", None, 1.0, 1.0)], "k string, at double, v double, s double")
    got = {r.t: r for r in carrier.anchored_content(series, anchors, ["k"], "t", "at", "v", "s").collect()}
    assert len(got) == 60 and got[60.0].content == 99.0 and got[0.0].content == pytest.approx(99.0 - 0.6) and got[0.0].anchored and got[0.0].anchor_sigma == 0.5
    assert got[480.0].content == 7.0 and got[480.0].anchor_sigma is None and got[480.0].anchored
    # The nearest anchor to the middle segment is further than the reach from all of its rows but those at its end.
    assert got[390.0].anchored and got[390.0].content == pytest.approx(7.0) or not got[390.0].anchored
    far = carrier.anchored_content(series, anchors.where("at = 53"), ["k"], "t", "at", "v", "s").where("segment = 2")
    assert far.where("anchored").count() == 0 and far.agg(F.max("content")).first()[0] == pytest.approx(5.9)


def test_differences(spark):
    rows = [("s", float(i), f, 5.0 * f + math.sin(i) * (f == 10.0)) for i in range(300) for f in (5.0, 10.0, 15.0) if not (f == 15.0 and i > 1)]
    got = carrier.content_differences(spark.createDataFrame(rows, "k string, t double, f double, content double"), ["k"], "t", "f").collect()
    assert [(r.f_a, r.f_b, r.n) for r in got] == [(5.0, 10.0, 300)] and got[0].rms == pytest.approx(math.sqrt(0.5), abs=0.01)
