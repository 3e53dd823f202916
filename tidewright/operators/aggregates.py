"""Grouped statistics of measurements: robust, weighted and layered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import quality


def robust_split(rows: DataFrame, keys: list[str], value: str, sigmas: float = 3.0, least: int = 3, flat: float = 0.01) -> DataFrame:
    """``rows`` with median, mad and outlier: farther than ``sigmas`` scaled MADs from the key's median.

    Keys of fewer than ``least`` rows or a MAD under ``flat`` have no outliers. Two
    aggregations and two joins on the same keys; nulls are never outliers.
    """
    centre = rows.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("_n"))
    near = rows.join(centre, keys)
    spread = near.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    far = F.abs(F.col(value) - F.col("median")) > F.lit(sigmas * 1.4826) * F.col("mad")
    judged = far & (F.col("_n") >= least) & (F.col("mad") >= flat)
    return near.join(spread, keys).withColumn("outlier", F.coalesce(judged, F.lit(False))).drop("_n")


#: The weight of each grade; others exclude.
GRADE_WEIGHTS = {"A": 1.0, "B": 0.7, "C": 0.4, "D": 0.15}


def consensus_weight(grade: Column, snr: Column, confidence: Column, least_snr: float = 5.0) -> Column:
    """Grade weight times signal (0.1 to 1 over 25 dB) times confidence (0.1 at least); 0 under ``least_snr``."""
    by_grade = F.lit(0.0)
    for name, w in GRADE_WEIGHTS.items():
        by_grade = F.when(grade == name, w).otherwise(by_grade)
    signal = F.least(F.greatest((snr - least_snr) / 25, F.lit(0.1)), F.lit(1.0))
    return F.when(snr >= least_snr, by_grade * signal * F.greatest(confidence, F.lit(0.1))).otherwise(0.0)


def station_estimates(rows: DataFrame, keys: list[str], value: str = "value", weight: str = "weight", grade: str = "grade", snr: str = "snr") -> DataFrame:
    """Per key: weighted mean, weighted spread (2 for a single row), rows, best grade and mean signal; keys that weigh under 0.01 are left out.

    One pass: the spread comes from sums about the key's plain mean, which keeps it exact.
    """
    middle = rows.groupBy(*keys).agg(F.avg(value).alias("_c"))
    moved = rows.join(middle, keys).withColumn("_d", F.col(value) - F.col("_c"))
    w, d = F.col(weight), F.col("_d")
    sums = moved.groupBy(*keys).agg(
        F.first("_c").alias("_c"), F.sum(w).alias("_w"), F.sum(w * d).alias("_wd"), F.sum(w * d * d).alias("_wdd"), F.count("*").alias("n"),
        F.min_by(F.col(grade), quality.grade_rank(F.col(grade))).alias("best_grade"), F.avg(snr).alias("mean_snr"),
    )
    mean = F.col("_wd") / F.col("_w")
    spread = F.sqrt(F.greatest(F.col("_wdd") / F.col("_w") - mean * mean, F.lit(0.0)))
    return sums.where(F.col("_w") >= 0.01).select(*keys, (F.col("_c") + mean).alias("estimate"), F.when(F.col("n") > 1, spread).otherwise(2.0).alias("uncertainty"), "n", "best_grade", "mean_snr")


def consensus(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Second level over stations: mean weighted by n over uncertainty, agreement, combined uncertainty and state."""
    weighed = estimates.withColumn("_w", F.col("n") / F.greatest("uncertainty", F.lit(0.1)))
    w, u = F.col("_w"), F.col("uncertainty")
    out = weighed.groupBy(*keys).agg(
        F.count("*").alias("stations"),
        (F.sum(w * F.col("estimate")) / F.sum(w)).alias("consensus"),
        (F.max("estimate") - F.min("estimate")).alias("agreement"),
        F.sqrt(F.sum(w * w * u * u) / (F.sum(w) * F.sum(w)) + F.pow((F.max("estimate") - F.min("estimate")) / 2, 2)).alias("uncertainty"),
    )
    state = F.when(F.col("stations") == 1, "SINGLE_SOURCE").when(F.col("agreement") < 1, "LOCKED").when(F.col("agreement") < 3, "CONVERGING").otherwise("DIVERGENT")
    return out.withColumn("state", state)


def mode_statistics(rows: DataFrame, keys: list[str], mode: str, modes: list[str], expected: Column, snr: str, frequency: str) -> DataFrame:
    """Per key: n, the share of each mode (others UNKNOWN), mean signal over -999, completeness, flag and usable frequency with confidence."""
    name = F.upper(F.trim(F.col(mode)))
    name = F.when(name.isin(*modes), name).otherwise("UNKNOWN")
    n = F.count("*")
    shares = [(F.sum(F.when(name == m, 1).otherwise(0)) / n).alias(f"share_{m.lower()}") for m in [*modes, "UNKNOWN"]]
    out = rows.groupBy(*keys).agg(n.alias("n"), *shares, F.avg(F.when(F.col(snr) > -999, F.col(snr))).alias("mean_snr"), F.max(frequency).alias("_f"))
    share = F.least(F.lit(1.0), F.col("n") / expected)
    out = out.withColumn("completeness", share).withColumn("flag", quality.completeness_flag(F.col("n"), share))
    f_share = sum((F.col(f"share_{m.lower()}") for m in modes if m.endswith("F")), F.lit(0.0))
    usable = quality.usable_frequency(F.col("_f"), f_share)
    return out.withColumns({"usable": usable, "usable_confidence": F.when(usable.isNotNull(), F.least(F.lit(1.0), F.col("n") / 60 * f_share))}).drop("_f")


def weighted_line(rows: DataFrame, keys: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted least squares y = slope x + intercept per key, with the residuals' weighted root mean square and the slope's sigma.

    Sums in one aggregation, about each key's means; slope is null where x does not vary.
    """
    base = rows.select(*keys, x.alias("_x"), y.alias("_y"), w.alias("_w")).where("_x is not null and _y is not null and _w > 0")
    means = base.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_mx"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_my"))
    moved = base.join(means, keys).withColumns({"_x": F.col("_x") - F.col("_mx"), "_y": F.col("_y") - F.col("_my")})
    sums = moved.groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.sum("_w").alias("_sw"),
        *[F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(k) for a, b, k in (("_x", "_x", "_sxx"), ("_x", "_y", "_sxy"), ("_y", "_y", "_syy"))],
    )
    slope = F.try_divide(F.col("_sxy"), F.nullif(F.col("_sxx"), F.lit(0.0)))
    rest = F.greatest(F.col("_syy") - slope * F.col("_sxy"), F.lit(0.0))
    return sums.select(
        *keys, "n", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
        F.sqrt(rest / F.col("_sw")).alias("rms"), F.sqrt(F.try_divide(rest, F.nullif((F.col("n") - 2) * F.col("_sxx"), F.lit(0.0)))).alias("slope_sigma"),
    )


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """Per key the first value at which the running weight reaches half of the whole."""
    w = Window.partitionBy(*keys)
    run = F.sum(weight).over(w.orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))
    half = F.sum(weight).over(w) / 2
    reached = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumns({"_run": run, "_half": half}).where("_run >= _half")
    return reached.groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def layered_range(rows: DataFrame, outer: list[str], inner: list[str], value: str, limit: float) -> DataFrame:
    """Means by outer and inner keys, then per outer key their number, range and whether it is over ``limit``."""
    means = rows.groupBy(*outer, *inner).agg(F.avg(value).alias("_mean"))
    width = F.max("_mean") - F.min("_mean")
    return means.groupBy(*outer).agg(F.count("*").alias("groups"), width.alias("spread")).withColumn("inconsistent", (F.col("groups") > 1) & (F.col("spread") > limit))


def modal(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the most frequent value; of equally frequent ones the one seen first by ``order``."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = F.min_by(F.struct(F.col(value), F.col("n")), F.struct(-F.col("n"), F.col("_first")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{value}", "_b.n")


def sectors(rows: DataFrame, angle: str, n: int = 8) -> DataFrame:
    """Counts of compass sectors, the first one about north, empty ones included."""
    width = 360.0 / n
    counts = rows.where(F.col(angle).isNotNull()).groupBy(F.floor(F.pmod(F.col(angle) + width / 2, F.lit(360.0)) / width).cast("int").alias("sector")).agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("sector"))
    return spine.join(counts, "sector", "left").select("sector", F.coalesce("n", F.lit(0)).alias("n"))
