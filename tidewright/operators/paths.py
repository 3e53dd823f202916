"""Operators on propagation paths: candidate modes, robust dispersion lines, delays between series, noise floors and surfaces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.aggregates import weighted_line


def downsampled(rows: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """The first of each ``every`` rows of a series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(w) - 1).where(F.col("_at") % every == 0).drop("_at")


def listed_only(rows: DataFrame, allowed: list[tuple], keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` are one of a fixed, short list of combinations; the list is the caller's code, not data."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(allowed, kinds)), keys, "left_semi")


def robust_line(rows: DataFrame, keys: list[str], tie: str, x: Column, y: Column, w: Column, passes: int = 3, sigmas: float = 3.0, least: int = 4) -> DataFrame:
    """``weighted_line`` after up to ``passes`` times leaving out a key's worst row.

    A row goes if its residual is over ``sigmas`` weighted root mean squares and the
    key has ``least`` rows or more. All passes are windows over the same keys, so
    the rows are shuffled once however many passes there are.
    """
    part = Window.partitionBy(*keys)
    total = lambda c: F.sum(c).over(part)
    base = rows.select(*keys, tie, x.alias("_x"), y.alias("_y"), w.alias("_w")).where("_x is not null and _y is not null and _w > 0")
    for _ in range(passes):
        dx, dy, wt, e = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my"), F.col("_w"), F.col("_e")
        base = base.withColumns({"_mx": total(wt * F.col("_x")) / total(wt), "_my": total(wt * F.col("_y")) / total(wt), "_n": F.count("*").over(part)})
        base = base.withColumn("_slope", F.try_divide(total(wt * dx * dy), F.nullif(total(wt * dx * dx), F.lit(0.0)))).withColumn("_e", dy - F.col("_slope") * dx)
        place = F.row_number().over(part.orderBy(F.desc(F.round(F.abs(e), 9)), tie))
        base = base.withColumns({"_rms": F.sqrt(total(wt * e * e) / total(wt)), "_place": place})
        worst = (F.col("_place") == 1) & (F.col("_n") >= least) & (F.abs(e) > sigmas * F.col("_rms"))
        base = base.where(~F.coalesce(worst, F.lit(False))).select(*keys, tie, "_x", "_y", "_w")
    return weighted_line(base, keys, F.col("_x"), F.col("_y"), F.col("_w"))


def frequency_points(rows: DataFrame, keys: list[str], frequency: str, value: str, floor: float = 0.1, single: float = 1.0) -> DataFrame:
    """Per key and frequency the median of the values and a sigma from the quartiles: their distance over 1.35, at least ``floor``; ``single`` for a single value."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    out = rows.where(F.col(value).isNotNull()).groupBy(*keys, frequency).agg(F.median(value).alias("median"), F.count("*").alias("n"), quartiles.alias("_q"))
    sigma = F.when(F.col("n") == 1, single).otherwise(F.greatest((F.col("_q")[1] - F.col("_q")[0]) / 1.35, F.lit(floor)))
    return out.withColumn("sigma", sigma).drop("_q")


def lagged_correlation(rows: DataFrame, keys: list[str], at: str, a: str, b: str, most: int, least: int = 3) -> DataFrame:
    """Per key and lag, how many steps both series have and how they correlate when ``b`` comes ``lag`` steps later.

    A join by equal steps for each of the 2 * most + 1 lags; steps without a value in either are left out.
    """
    left = rows.where(F.col(a).isNotNull()).select(*keys, F.col(at).alias("_at"), F.col(a).alias("_a"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    left = left.withColumn("_at", F.col("_at") + F.col("lag"))
    right = rows.where(F.col(b).isNotNull()).select(*keys, F.col(at).alias("_at"), F.col(b).alias("_b"))
    return left.join(right, [*keys, "_at"]).groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("r")).where(F.col("n") >= least)


def best_delay(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the lag of the strongest correlation; of equal ones that with the most steps, then the smallest."""
    best = F.max_by(F.struct("lag", "n", "r"), F.struct(F.round(F.abs("r"), 9), "n", -F.col("lag")))
    return correlations.where(F.col("r").isNotNull() & ~F.isnan("r")).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def noise_floor(windows: DataFrame, keys: list[str], window: str, x: str, y: str, least: int = 5) -> DataFrame:
    """Per key the median over its windows of 1.4826 times the MAD of the window's values about their own line."""
    by = [*keys, window]
    line = windows.groupBy(*by).agg(F.regr_slope(y, x).alias("_m"), F.regr_intercept(y, x).alias("_c"), F.count("*").alias("_n"))
    rest = windows.join(line, by).where(F.col("_n") >= least).withColumn("_e", F.col(y) - F.col("_m") * F.col(x) - F.col("_c"))
    centre = rest.groupBy(*by).agg(F.median("_e").alias("_mid"))
    mad = rest.join(centre, by).groupBy(*by).agg((1.4826 * F.median(F.abs(F.col("_e") - F.col("_mid")))).alias("_s"))
    return mad.groupBy(*keys).agg(F.median("_s").alias("floor"), F.count("*").alias("windows"))


def density(rows: DataFrame, keys: list[str], value: str, low: float, high: float, steps: int, width: float) -> DataFrame:
    """Gaussian kernel density of each key at ``steps`` + 1 points from ``low`` to ``high``.

    Values are counted in bins of a quarter of ``width`` first: bins, not rows, meet the
    points, whose number is fixed. Values out of range by five widths add nothing.
    """
    q = width / 4
    near = rows.where((F.col(value) >= low - 5 * width) & (F.col(value) <= high + 5 * width))
    bins = near.groupBy(*keys, F.floor(F.col(value) / q).alias("_bin")).agg(F.count("*").alias("_n"))
    total = bins.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    step = (high - low) / steps
    points = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.struct(i.alias("point"), (low + i * step).alias("at"))))
    spread = bins.select(*keys, "_n", ((F.col("_bin") + 0.5) * q).alias("_v"), points.alias("_p")).select(*keys, "_n", "_v", "_p.*")
    z = (F.col("at") - F.col("_v")) / width
    sums = spread.groupBy(*keys, "point", "at").agg(F.sum(F.col("_n") * F.exp(-z * z / 2)).alias("_k"))
    return sums.join(total, keys).select(*keys, "point", "at", (F.col("_k") / (F.col("_all") * width * (2 * np.pi) ** 0.5)).alias("density"))


def two_shells(rows: DataFrame, keys: list[str], m1: str, m2: str, slant: str, prior1: float, prior2: float, ridge: float = 0.01) -> DataFrame:
    """Per key the two vertical contents that explain slant = m1 * t1 + m2 * t2 best, drawn to the priors by ``ridge``, and not negative: 2 x 2 normal equations."""
    a, b, y = F.col(m1), F.col(m2), F.col(slant)
    sums = rows.where(a.isNotNull() & b.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum(a * a) + ridge).alias("_aa"), (F.sum(b * b) + ridge).alias("_bb"), F.sum(a * b).alias("_ab"),
        (F.sum(a * y) + ridge * prior1).alias("_ay"), (F.sum(b * y) + ridge * prior2).alias("_by"),
    )
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    first = (F.col("_bb") * F.col("_ay") - F.col("_ab") * F.col("_by")) / det
    second = (F.col("_aa") * F.col("_by") - F.col("_ab") * F.col("_ay")) / det
    return sums.select(*keys, "n", F.greatest(first, F.lit(0.0)).alias("t1"), F.greatest(second, F.lit(0.0)).alias("t2"))


def ridge_surface(rows: DataFrame, keys: list[str], x: str, y: str, value: str, weight: str, degree: int = 2, ridge: float = 1e-3) -> DataFrame:
    """Per key the coefficients of a weighted polynomial surface, by rising degree in x and y: 1, x, y, x², xy, y² ...

    One aggregation makes the sums of the normal equations; what is solved is one small system a key.
    """
    powers = [(d - j, j) for d in range(degree + 1) for j in range(d + 1)]
    k = len(powers)
    term = [F.pow(x, i) * F.pow(y, j) for i, j in powers]
    w = F.col(weight)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(w * term[i] * term[j]) for i, j in pairs] + [F.sum(w * t * F.col(value)) for t in term]
    known = rows.where(F.col(value).isNotNull() & (w > 0))
    gathered = known.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("_sums"))

    @F.pandas_udf("array<double>")
    def solve(parts: pd.Series) -> pd.Series:
        out = []
        for p in parts:
            a, right = np.zeros((k, k)), np.asarray(p[len(pairs) :])
            for (i, j), s in zip(pairs, p):
                a[i, j] = a[j, i] = s
            out.append(np.linalg.solve(a + ridge * np.eye(k), right))
        return pd.Series(out, dtype=object)

    return gathered.select(*keys, "n", solve("_sums").alias("coefficients"))
