"""Hulls against brute force, planted surfaces, grids and the file that comes back."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import maps
from tidewright.sources import sinks, text


def corners(points):
    """By brute force: the starts of all edges that leave every point on their left or between their ends."""
    points, found = sorted(set(points)), set()
    for a, b in itertools.permutations(points, 2):
        cross = [((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]), c) for c in points]
        if all(x > 0 or (x == 0 and min(a, b) <= c <= max(a, b)) for x, c in cross) and any(x > 0 for x, _ in cross):
            found.add(a)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_hull_of_is_brute_force(seed):
    draw = random.Random(seed)
    points = [(float(draw.randint(0, 6)), float(draw.randint(0, 6))) for _ in range(draw.randint(1, 25))]
    hull = [tuple(p) for p in maps.hull_of(np.array(points))]
    if len(hull) > 2:
        assert set(hull) == corners(points) and len(hull) == len(set(hull))
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:] + hull[:1]))
        assert area > 0  # counter-clockwise


@pytest.fixture
def points(spark):
    draw = random.Random(9)
    rows = [(k, float(draw.randint(-9, 9)), float(draw.randint(-9, 9))) for k in ("a", "b", "a", "a") for _ in range(40)]
    rows += [("line", float(i), float(i)) for i in range(9)] + [("two", 1.0, 2.0), ("two", 1.0, 3.0), ("one", 1.0, 1.0)] + [("a", None, 99.0), ("a", float("nan"), 99.0)]
    return spark.createDataFrame(rows, "k string, x double, y double").repartition(7)


def test_hulls_merge(points):
    got = {r.k: r.hull for r in maps.convex_hulls(points, ["k"], "x", "y", most_keys=1).collect()}
    rows = [r for r in points.collect() if r.x is not None and r.x == r.x]
    assert sorted(got) == ["a", "b", "line", "one", "two"]
    for k in "ab":
        assert {(p.x, p.y) for p in got[k]} == corners([(r.x, r.y) for r in rows if r.k == k])
    assert got["line"] is None and got["two"] is None and got["one"] is None
    assert maps.convex_hulls(points.limit(0), ["k"], "x", "y").count() == 0


def test_in_hull(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    rows = spark.createDataFrame([(1.0, 1.0, True), (0.0, 1.0, True), (2.0, 2.0, True), (2.1, 1.0, False), (-1.0, -1.0, False)], "x double, y double, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", maps.in_hull(F.col("x"), F.col("y"), square)).collect())


@pytest.fixture
def pierced(spark):
    """A hexagon about (39, -92) of contents 25 + 0.4 north + 0.25 east, three points of another epoch, two of a third."""
    rows = []
    for i in range(6):
        a = np.radians(60 * i)
        lat, lon = 39 + 6 * np.sin(a), -92 + 6 * np.cos(a)
        rows.append((0, float(lat), float(lon), float(25 + 0.4 * (lat - 39) + 0.25 * (lon + 92)), 1.0))
    rows += [(1, 30.0, 0.0, 10.0, 1.0), (1, 34.0, 0.0, 14.0, 1.0), (1, 30.0, 4.0, 10.0, 0.0), (2, 1.0, 1.0, 5.0, 1.0), (2, 2.0, 2.0, 5.0, 1.0), (0, 50.0, -92.0, None, 1.0)]
    return spark.createDataFrame(rows, "epoch int, lat double, lon double, v double, s double")


def test_planted_surface(pierced):
    got = {r.epoch: r for r in maps.content_maps(pierced, ["epoch"], "lat", "lon", "v", "s", ridge=1e-3).collect()}
    assert sorted(got) == [0, 1]
    m = got[0]
    assert (m.n, m.degree, len(m.coefficients), len(m.hull)) == (6, 2, 6, 6) and abs(m.centre_lat - 39) < 1e-9 and m.rms < 0.01
    assert abs(m.coefficients[0] - 25) < 0.05 and abs(m.coefficients[1] - 0.25) < 0.01 and abs(m.coefficients[3] - 0.4) < 0.01
    assert got[1].degree == 1 and abs(got[1].coefficients[2] - 1.0) < 0.01  # three points, three terms


def test_grid_is_masked_and_comes_back_from_its_file(spark, pierced, tmp_path):
    surfaces = maps.content_maps(pierced, ["epoch"], "lat", "lon", "v", "s", ridge=1e-3)
    grid = maps.map_grid(surfaces, ["epoch"], 1.0, 8.0).cache()
    cells = {(round(r.lat, 6), round(r.lon, 6)): r.value for r in grid.where("epoch = 0").collect()}
    assert len(cells) == 17 * 17 and cells[39.0, -92.0] == pytest.approx(25, abs=0.1) and cells[31.0, -100.0] is None and cells[47.0, -92.0] is None
    assert grid.where("value < 0").count() == 0
    at = grid.withColumns({"name": F.concat(F.lit("m"), "epoch"), "at": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("epoch") * 3600)})
    sinks.ionex_files(at, f"{tmp_path}/maps", "name", "at")
    assert all(len(x) <= 80 for r in spark.read.text(f"{tmp_path}/maps/name=m0").collect() for x in r.value.split("\n"))
    back = text.ionex(spark, f"{tmp_path}/maps/name=m0").collect()
    assert len(back) == 17 * 17
    for r in back:
        value = cells[round(r.lat, 6), round(r.lon, 6)]
        assert (r.tec is None) == (value is None) and (value is None or abs(r.tec - int(value * 10) / 10) < 1e-9)
    assert str(back[0].epoch) == "2023-11-14 22:13:20"
    sinks.ionex_files(at, f"{tmp_path}/maps", "name", "at")  # again: the same files
    assert len(text.ionex(spark, f"{tmp_path}/maps/name=m1").collect()) == 17 * 17
