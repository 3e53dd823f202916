"""Kernels over one row's array of samples, as Pandas UDFs: a minute of one channel is a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(kind: str, f: Callable[[np.ndarray], object]):
    """A UDF that applies ``f`` to each row's samples; null for null and empty arrays."""

    @F.pandas_udf(kind)
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else f(np.asarray(x, dtype=float)) for x in rows], dtype=object)

    return run


def _struct(kind: str, f: Callable[[np.ndarray], dict | None]):
    """The same for a struct of values; its fields are null where there is none."""
    names = [part.split()[0] for part in kind.split(",")]

    @F.pandas_udf(kind)
    def run(rows: pd.Series) -> pd.DataFrame:
        got = [(f(np.asarray(x, dtype=float)) if x is not None and len(x) else None) or {} for x in rows]
        return pd.DataFrame({n: pd.array([g.get(n) for g in got], dtype="Float64") for n in names})

    return run


def low_pass(taps: int, cutoff: float) -> np.ndarray:
    """A windowed-sinc filter; ``cutoff`` in cycles a sample."""
    n = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * n) * np.hamming(taps)
    return h / h.sum()


def decimated(samples: Column, factor: int, taps: int = 0) -> Column:
    """Samples filtered to half the new rate and thinned by ``factor``."""
    h = low_pass(taps or 8 * factor + 1, 0.5 / factor * 0.9)
    return _each("array<double>", lambda x: np.convolve(x, h, mode="same")[::factor])(samples)


def tone_power(samples: Column, cycles: float) -> Column:
    """Mean power of the part at ``cycles`` per sample."""

    def power(x: np.ndarray) -> float:
        z = x @ np.exp(-2j * np.pi * cycles * np.arange(len(x)))
        return float(abs(z) ** 2 / len(x) ** 2)

    return _each("double", power)(samples)


def match(samples: Column, template: np.ndarray) -> Column:
    """Where a template fits best (``lag``, to a part of a sample), its height and its ratio to the noise in dB.

    The noise is 1.4826 MADs of the correlation; the peak is that of the
    parabola through the best lag and its neighbours.
    """
    unit = template / np.linalg.norm(template)

    def best(x: np.ndarray) -> dict | None:
        if len(x) < len(unit):
            return None
        c = np.correlate(x, unit, mode="valid")
        i = int(np.abs(c).argmax())
        noise = 1.4826 * np.median(np.abs(np.abs(c) - np.median(np.abs(c))))
        shift = 0.0
        if 0 < i < len(c) - 1:
            a, b, d = np.abs(c[i - 1 : i + 2])
            bend = a - 2 * b + d
            shift = float(0.5 * (a - d) / bend) if bend else 0.0
        return {"lag": i + shift, "peak": float(c[i]), "snr_db": float(20 * np.log10(abs(c[i]) / noise)) if noise > 0 else None}

    return _struct("lag double, peak double, snr_db double", best)(samples)


def multipath(samples: Column, template: np.ndarray, gain: float = 0.5, most: int = 20, floor: float = 0.1) -> Column:
    """Arrivals by the CLEAN method: the best fit's part is taken off again and again until it is under ``floor`` of the first."""
    unit = template / np.linalg.norm(template)

    def clean(x: np.ndarray) -> list[dict]:
        if len(x) < len(unit):
            return []
        rest, found, first = x.copy(), {}, None
        for _ in range(most):
            c = np.correlate(rest, unit, mode="valid")
            i = int(np.abs(c).argmax())
            first = abs(c[i]) if first is None else first
            if not first or abs(c[i]) < floor * first:
                break
            found[i] = found.get(i, 0.0) + gain * c[i]
            rest[i : i + len(unit)] -= gain * c[i] * unit
        return [{"lag": k, "amplitude": float(v)} for k, v in sorted(found.items())]

    return _each("array<struct<lag:int,amplitude:double>>", clean)(samples)


def best_lag(a: Column, b: Column, most: int) -> Column:
    """The lag of ``b`` behind ``a`` at which they correlate most, and the correlation; NaNs are left out, ties go to the larger overlap."""

    @F.pandas_udf("lag int, correlation double")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(xs, ys):
            best: tuple = (-np.inf, 0, None)
            for lag in range(-most, most + 1) if x is not None and y is not None else ():
                u, v = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
                n = min(len(u), len(v))
                u, v = (u[: n - lag], v[lag:n]) if lag >= 0 else (u[-lag:n], v[: n + lag])
                good = np.isfinite(u) & np.isfinite(v)
                if good.sum() > 2 and u[good].std() > 0 and v[good].std() > 0:
                    best = max(best, (round(float(np.corrcoef(u[good], v[good])[0, 1]), 12), int(good.sum()), lag))
            out.append((best[2], best[0] if best[2] is not None else None))
        return pd.DataFrame(out, columns=["lag", "correlation"]).astype({"lag": "Int32"})

    return run(a, b)


def power(samples: Column) -> Column:
    """Mean square, without Python."""
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.nullif(F.size(samples), F.lit(0))


def integral(x: Column, y: Column) -> Column:
    """Trapezoids over two arrays of equal length, without Python."""
    n = F.size(x)
    left, right = F.slice(F.arrays_zip(x.alias("x"), y.alias("y")), 1, F.greatest(n - 1, F.lit(0))), F.slice(F.arrays_zip(x.alias("x"), y.alias("y")), 2, F.greatest(n - 1, F.lit(0)))
    parts = F.zip_with(left, right, lambda a, b: (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2)
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
