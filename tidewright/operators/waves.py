"""Travelling waves: zero-phase band-pass filters over blocks, and a wave's speed and direction from the lags between places."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A place's distance in km below which two tell nothing of a wave, and the Earth's radius.
LEAST_APART_KM = 50.0
EARTH_KM = 6371.0


def band_pass_sections(low: float, high: float, order: int = 2) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a Butterworth band-pass for frequencies in cycles a sample, by the bilinear transform.

    The low-pass prototype's poles lie evenly on the left half of the unit circle; each
    gives two band-pass poles, which pair with their conjugates. A zero at 0 and one at
    the Nyquist frequency go to each section; the gain is 1 at the band's middle.
    """
    if not 0 < low < high < 0.5:
        raise ValueError("a band within 0 and 0.5 cycles a sample")
    a, b = 2 * math.tan(math.pi * low), 2 * math.tan(math.pi * high)
    middle, width = math.sqrt(a * b), b - a
    poles = []
    for k in range(order):
        p = width * np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) / 2
        root = np.sqrt(p * p - middle * middle + 0j)
        poles += [p + root, p - root]
    z = np.array([(2 + p) / (2 - p) for p in poles])
    upper = sorted(z[z.imag > 1e-12], key=abs)
    real = sorted(z[abs(z.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(p + q), p * q) for p, q in zip(real[::2], real[1::2])]
    at = np.exp(2j * math.atan(middle / 2))
    sections = []
    for a1, a2 in pairs:
        gain = abs((1 - at**-2) / (1 + a1 * at**-1 + a2 * at**-2))
        sections.append([1 / gain, 0.0, -1 / gain, a1, a2])
    return np.array(sections)


def filtered(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """One run of the sections over a series, from rest."""
    for b0, b1, b2, a1, a2 in sections:
        y, s1, s2 = np.empty(len(x)), 0.0, 0.0
        for i, v in enumerate(x.tolist()):
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[i] = out
        x = y
    return x


def settled_after(sections: np.ndarray, rest: float = 1e-10) -> int:
    """After how many samples less than ``rest`` of a filter's memory is left: its slowest pole decides."""
    radius = max(abs(r) for *_, a1, a2 in sections for r in np.roots([1.0, a1, a2]))
    return math.ceil(math.log(rest) / math.log(radius) * 1.5) + 1


def band_passed(series: DataFrame, keys: list[str], step: str, value: str, low: float, high: float, order: int = 2, block: int = 10_000, out: str = "filtered") -> DataFrame:
    """``series`` with ``value`` filtered forwards and backwards: no frequency outside the band, no shift in time.

    Rows are a whole grid: each key's steps are whole numbers without gaps (``hourly_grid``
    makes such). A key's series is cut in blocks, and each block is filtered with as many
    steps of its neighbours on both sides as the filter remembers, so blocks run in
    parallel and no task holds a key; all but the ends is the filter of the whole series to ten
    digits. At a series' ends the values go on as their mirror image about the end, as far
    as there are any. Null and NaN values count as 0.
    """
    sections = band_pass_sections(low, high, order)
    margin = settled_after(sections)
    block = max(block, margin)
    at = F.floor(F.col(step) / block)
    place = F.col(step) - at * block
    homes = F.array_compact(F.array(at, F.when(place < margin, at - 1), F.when(place >= block - margin, at + 1)))
    rows = series.withColumns({"_home": F.explode(homes), "_own": at})
    schema = series.withColumn(out, F.lit(0.0)).schema

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(step)
        own = (part["_home"] == part["_own"]).to_numpy()
        if not own.any():
            return part.iloc[:0].assign(**{out: 0.0})[schema.names]
        x = np.nan_to_num(part[value].to_numpy(float))
        n = min(margin, len(x) - 1)
        mirrored = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n > 0 else x
        y = filtered(filtered(mirrored, sections)[::-1], sections)[::-1][n : n + len(x)]
        return part.assign(**{out: y})[own][schema.names]

    return rows.groupBy(*keys, "_home").applyInPandas(run, schema)


def east_north_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """A place's distances east and north of another, in the plane that touches there."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_KM, F.radians(lat - lat0) * EARTH_KM


def wave_velocity(pairs: DataFrame, keys: list[str], dx: str, dy: str, lag: str) -> DataFrame:
    """Per key a plane wave's speed in m/s, the bearing it moves to in degrees, the baselines used and the lags' rms in seconds.

    ``pairs`` has, for each two places, the first's distances east and north of the
    second in km and by how many seconds the wave comes later there. Two or more baselines
    of ``LEAST_APART_KM`` are needed that span the plane: speed and bearing are null where
    they lie on one line or where nothing lags. The slowness solves two normal
    equations: sums of one aggregation.
    """
    x, y, t = F.col(dx), F.col(dy), F.col(lag)
    known = pairs.where(x.isNotNull() & y.isNotNull() & t.isNotNull() & (x * x + y * y >= LEAST_APART_KM**2))
    sums = known.groupBy(*keys).agg(F.count("*").alias("baselines"), *[F.sum(e).alias(n) for n, e in (("_xx", x * x), ("_xy", x * y), ("_yy", y * y), ("_xt", x * t), ("_yt", y * t), ("_tt", t * t))])
    xx, xy, yy, xt, yt = (F.col(f"_{c}") for c in ("xx", "xy", "yy", "xt", "yt"))
    det = xx * yy - xy * xy
    spans = (F.col("baselines") >= 2) & (det > 1e-9 * (xx + yy) * (xx + yy))
    told = sums.withColumns({"_sx": F.when(spans, (xt * yy - yt * xy) / det), "_sy": F.when(spans, (yt * xx - xt * xy) / det)})
    sx, sy = F.col("_sx"), F.col("_sy")
    slow = F.sqrt(sx * sx + sy * sy)
    squares = F.col("_tt") - 2 * (sx * xt + sy * yt) + sx * sx * xx + 2 * sx * sy * xy + sy * sy * yy
    rms = F.sqrt(F.greatest(squares, F.lit(0.0)) / F.col("baselines"))
    bearing = F.pmod(F.degrees(F.atan2(sx, sy)), F.lit(360.0))
    return told.select(*keys, "baselines", F.when(slow > 0, 1000 / slow).alias("speed"), F.when(slow > 0, bearing).alias("bearing"), F.when(sx.isNotNull(), rms).alias("rms"))
