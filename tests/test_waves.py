"""A planted wave's band, speed and bearing; blocks against one long run."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import waves


def gain(sections, f):
    z = np.exp(2j * np.pi * f)
    return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in sections]))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_filter_is_butterworth(order):
    low, high = 1 / 60, 1 / 10
    s = waves.band_pass_sections(low, high, order)
    assert len(s) == order and all(abs(r) < 1 for *_, a1, a2 in s for r in np.roots([1, a1, a2]))
    assert gain(s, low) == pytest.approx(math.sqrt(0.5), abs=1e-9) and gain(s, high) == pytest.approx(math.sqrt(0.5), abs=1e-9)
    # The law of the Butterworth shape at any frequency, in bilinear ones.
    a, b = math.tan(math.pi * low), math.tan(math.pi * high)
    for f in (0.001, 0.01, 0.04, 0.2, 0.4):
        w = math.tan(math.pi * f)
        assert gain(s, f) == pytest.approx(1 / math.sqrt(1 + ((w * w - a * b) / (w * (b - a))) ** (2 * order)), rel=1e-9)
    with pytest.raises(ValueError):
        waves.band_pass_sections(0.2, 0.1)


def test_filtered_is_its_equation():
    s, x = waves.band_pass_sections(0.05, 0.2), np.random.default_rng(0).normal(size=60)
    want = x
    for b0, b1, b2, a1, a2 in s:
        y = np.zeros(60)
        for i in range(60):
            at = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: E731, B023
            y[i] = b0 * at(want, 0) + b1 * at(want, 1) + b2 * at(want, 2) - a1 * at(y, 1) - a2 * at(y, 2)
        want = y
    assert np.allclose(waves.filtered(x, s), want)


def test_blocks_equal_the_whole_and_keep_the_phase(spark):
    t = np.arange(3_000)
    wave = np.sin(2 * np.pi * t / 25)
    x = wave + 5 + 0.01 * t + 2 * np.sin(2 * np.pi * t / 2.5)
    rows = [("a", int(i), float(v)) for i, v in enumerate(x)] + [("b", int(i), float(v)) for i, v in enumerate(wave[:300])] + [("c", 7, 1.0)]
    series = spark.createDataFrame(rows, "k string, step long, v double").repartition(5)
    parts, whole = (waves.band_passed(series, ["k"], "step", "v", 1 / 60, 1 / 10, block=b).toPandas().sort_values(["k", "step"]) for b in (400, 10**6))
    assert len(parts) == len(whole) == 3_301
    a, b = (f[f.k == "a"].filtered.to_numpy() for f in (parts, whole))
    assert np.abs(a - b)[300:-300].max() < 1e-6
    assert np.abs(b - wave * gain(waves.band_pass_sections(1 / 60, 1 / 10), 1 / 25) ** 2)[300:-300].max() < 0.02
    assert waves.band_passed(series.limit(0), ["k"], "step", "v", 1 / 60, 1 / 10).count() == 0


def test_planted_wave(spark):
    speed, bearing = 180.0, 200.0
    sx, sy = (math.sin(math.radians(bearing)) / speed * 1000, math.cos(math.radians(bearing)) / speed * 1000)
    places = {"p": (0.0, 0.0), "q": (300.0, 40.0), "r": (-120.0, 410.0), "s": (10.0, 5.0)}
    rows = []
    for i, (a, pa) in enumerate(places.items()):
        for b, pb in list(places.items())[i + 1 :]:
            dx, dy = pa[0] - pb[0], pa[1] - pb[1]
            rows.append(("wave", dx, dy, dx * sx + dy * sy))
    rows += [("line", 100.0 * i, 50.0 * i, 9.0 * i) for i in (1, 2, 3)] + [("still", 100.0, 0.0, 0.0), ("still", 0.0, 100.0, 0.0), ("one", 100.0, 0.0, 5.0), ("near", 1.0, 1.0, 5.0), ("none", 100.0, None, 1.0)]
    got = {r.k: r for r in waves.wave_velocity(spark.createDataFrame(rows, "k string, x double, y double, t double"), ["k"], "x", "y", "t").collect()}
    assert sorted(got) == ["line", "one", "still", "wave"]
    assert got["wave"].baselines == 5 and got["wave"].speed == pytest.approx(speed, rel=1e-9) and got["wave"].bearing == pytest.approx(bearing, abs=1e-7) and got["wave"].rms < 1e-3
    assert got["line"].speed is None and got["one"].speed is None and got["still"].speed is None


def test_plane(spark):
    east, north = waves.east_north_km(F.lit(41.0), F.lit(-90.0), F.lit(40.0), F.lit(-91.0))
    r = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert r.n == pytest.approx(111.19, abs=0.01) and r.e == pytest.approx(111.19 * math.cos(math.radians(40)), abs=0.01)
