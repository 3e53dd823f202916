"""Maps of scattered values: convex hulls that merge, surfaces about a centre, grids within the hull."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a map's polynomial.
MOST_DEGREE = 4
HULL = "array<struct<x:double,y:double>>"


def hull_of(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of (n, 2) points, counter-clockwise from the lowest x, without points on edges.

    Fewer than three distinct points, or points on one line, give themselves' ends: what
    merging needs of them.
    """
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    sides = []
    for order in (points, points[::-1]):
        side: list[np.ndarray] = []
        for p in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides)


def convex_hulls(rows: DataFrame, keys: list[str], x: str, y: str, most_keys: int = 10_000) -> DataFrame:
    """keys, hull: each key's corners in order, null where its points span no area.

    A mergeable aggregate: a task keeps, for each key it sees, the hull so far, and hands
    on corners, not points; the hulls of a key's parts merge in two steps, the first
    dealt by the task, so that what meets in one place is a few corners. Points with a null or NaN
    coordinate are left out.
    """
    schema = rows.select(*keys, F.lit(0.0).alias("_x"), F.lit(0.0).alias("_y"), F.lit(0).alias("_part")).schema
    out_schema = rows.select(*keys, F.lit(None).cast(HULL).alias("hull")).schema

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*key, px, py, part) for key, hull in held.items() for px, py in hull.tolist()], columns=[*keys, "_x", "_y", "_part"])

        part = 0
        for b in batches:
            part = int(b["_part"].iloc[0]) if len(b) else part
            for key, group in b.groupby(keys, dropna=False, sort=False):
                points = group[["_x", "_y"]].to_numpy(float)
                held[key] = hull_of(np.concatenate([held[key], points]) if key in held else points)
            if len(held) > most_keys:
                yield out()
                held = {}
        if held:
            yield out()

    def merged(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        corners = hull_of(points[["_x", "_y"]].to_numpy(float))
        return points.iloc[[0] * len(corners)][[*keys, "_part"]].assign(_x=corners[:, 0], _y=corners[:, 1])[[*keys, "_x", "_y", "_part"]]

    def whole(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        corners = hull_of(points[["_x", "_y"]].to_numpy(float))
        row = points.iloc[[0]][keys].copy()
        row["hull"] = [[{"x": px, "y": py} for px, py in corners.tolist()] if len(corners) > 2 else None]
        return row

    known = rows.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), (F.spark_partition_id() % 64).alias("_part"))
    known = known.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    parts = known.mapInPandas(partial, schema).groupBy(*keys, "_part").applyInPandas(merged, schema)
    return parts.groupBy(*keys).applyInPandas(whole, out_schema)


def in_hull(x: Column, y: Column, hull: Column, slack: float = 1e-9) -> Column:
    """Whether a point is within a hull or on its edge; null where there is no hull."""
    ends = F.concat(F.slice(hull, 2, 1_000_000), F.slice(hull, 1, 1))
    edges = F.zip_with(hull, ends, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= -slack)
    return F.forall(edges, lambda inside: inside)


def _powers(degree: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]


def content_maps(rows: DataFrame, keys: list[str], lat: str, lon: str, value: str, sigma: str, degree: int = 2, ridge: float = 0.1, least: int = 3) -> DataFrame:
    """Per key a weighted polynomial in degrees from the mean place, with its hull: n, centre, degree, coefficients, rms and coverage in km.

    Weights are 1 / max(sigma, 0.1)^2. A key of fewer points than the polynomial has terms
    gets a lower degree; fewer than ``least`` give none. All terms but the constant are
    drawn to 0 by ``ridge``, squared and in units of their own size. The sums of the
    normal equations are one aggregation; what is solved is one small system a key.
    Terms go by rising power of the latitude, then of the longitude.
    """
    if not 0 <= degree <= MOST_DEGREE:
        raise ValueError(f"a degree of 0 to {MOST_DEGREE}")
    terms = _powers(degree)
    known = rows.where(F.col(value).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    centre = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(lat).alias("centre_lat"), F.avg(lon).alias("centre_lon"), (111.0 * F.sqrt(F.pow(F.max(lat) - F.min(lat), 2) + F.pow(F.max(lon) - F.min(lon), 2))).alias("coverage_km")).where(F.col("n") >= least)
    s = F.greatest(F.coalesce(F.col(sigma), F.lit(0.1)), F.lit(0.1))
    moved = known.join(centre, keys).select(*keys, "n", "centre_lat", "centre_lon", "coverage_km", (F.col(lat) - F.col("centre_lat")).alias("_a"), (F.col(lon) - F.col("centre_lon")).alias("_o"), F.col(value).alias("_v"), (1 / (s * s)).alias("_w"))
    a, o, v, w = (F.col(c) for c in ("_a", "_o", "_v", "_w"))
    # Sums of all powers that products of two terms need, each once.
    high = [(i, j) for i in range(2 * degree + 1) for j in range(2 * degree + 1 - i)]
    sums = [F.sum(w * F.pow(a, i) * F.pow(o, j)) for i, j in high] + [F.sum(w * F.pow(a, i) * F.pow(o, j) * v) for i, j in terms] + [F.sum(v * v)]
    plain = [F.sum(F.pow(a, i) * F.pow(o, j)) for i, j in high] + [F.sum(F.pow(a, i) * F.pow(o, j) * v) for i, j in terms]
    gathered = moved.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("n", "centre_lat", "centre_lon", "coverage_km")], F.array(*sums, *plain).alias("_sums"))

    @F.pandas_udf("struct<degree:int,coefficients:array<double>,rms:double>")
    def solve(counts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        out = []
        for n, p in zip(counts, parts):
            place = {power: k for k, power in enumerate(high)}
            d = degree
            while d > 0 and len(_powers(d)) > n:
                d -= 1
            use = _powers(d)
            weighted, right = p[: len(high)], p[len(high) : len(high) + len(terms)]
            rest = p[len(high) + len(terms) :]
            gram = lambda of: np.array([[of[place[i + k, j + m]] for k, m in use] for i, j in use])
            at = [terms.index(t) for t in use]
            g = gram(weighted)
            penalty = ridge * ridge * np.diag(g)
            penalty[0] = 0.0
            c = np.linalg.lstsq(g + np.diag(penalty), np.asarray(right)[at], rcond=None)[0]
            squares, plain_gram, plain_right = rest[0], gram(rest[1 : 1 + len(high)]), np.asarray(rest[1 + len(high) :])[at]
            rms = np.sqrt(max(0.0, (squares - 2 * c @ plain_right + c @ plain_gram @ c) / n))
            out.append((d, c.tolist(), rms))
        return pd.DataFrame(out, columns=["degree", "coefficients", "rms"])

    told = gathered.withColumn("_s", solve.asNondeterministic()("n", "_sums"))
    return told.select(*keys, "n", "centre_lat", "centre_lon", "coverage_km", "_s.*").join(convex_hulls(known, keys, lat, lon), keys)


def map_grid(maps: DataFrame, keys: list[str], resolution: float = 1.0, extent: float = 15.0) -> DataFrame:
    """keys, lat, lon, value: the maps on a grid of ``resolution`` degrees to ``extent`` degrees about their centres.

    The value is at least 0 and null outside the hull, where the polynomial only
    guesses; a key without a hull has values everywhere. All cells of a map are told by
    its row: no shuffle.
    """
    steps = int((2 * extent + 0.01) / resolution)
    cells = maps.withColumn("lat", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.col("centre_lat") - extent + i * resolution)))
    cells = cells.withColumn("lon", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.col("centre_lon") - extent + i * resolution)))
    a, o = F.col("lat") - F.col("centre_lat"), F.col("lon") - F.col("centre_lon")
    total = F.lit(None).cast("double")
    for d in range(MOST_DEGREE + 1):
        value = sum((F.col("coefficients")[k] * F.pow(a, i) * F.pow(o, j) for k, (i, j) in enumerate(_powers(d))), F.lit(0.0))
        total = F.when(F.col("degree") == d, value).otherwise(total)
    inside = F.coalesce(in_hull(F.col("lat"), F.col("lon"), F.col("hull")), F.lit(True))
    return cells.select(*keys, "lat", "lon", F.when(inside, F.greatest(total, F.lit(0.0))).alias("value"))
