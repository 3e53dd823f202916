"""Robust fusion of one quantity that many sources measure: the library's flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import table


def robust_fusion(rows: DataFrame, keys: list[str], value: str, weight: str, sigmas: float = 3.0) -> DataFrame:
    """Weighted mean per key of the values within ``sigmas`` scaled MADs of the median.

    Median and MAD are exact. A key whose MAD is 0 keeps the values equal to its
    median. Null values are left out; a null weight counts as 0.
    """
    known = rows.where(F.col(value).isNotNull()).withColumn(weight, F.coalesce(F.col(weight), F.lit(0.0)))
    centre = known.groupBy(*keys).agg(F.median(value).alias("_median"))
    deviations = known.join(centre, keys).withColumn("_deviation", F.abs(F.col(value) - F.col("_median")))
    spread = deviations.groupBy(*keys).agg(F.median("_deviation").alias("_mad"))
    kept = deviations.join(spread, keys).withColumn("_in", F.col("_deviation") <= F.lit(sigmas * 1.4826) * F.col("_mad"))
    inside = lambda c: F.when(F.col("_in"), c)
    return kept.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count(inside(F.lit(1))).alias("n_used"),
        F.round(F.try_divide(F.sum(inside(F.col(value) * F.col(weight))), F.sum(inside(F.col(weight)))), 6).alias("fused"),
        F.round(F.stddev_pop(inside(F.col(value))), 6).alias("spread"),
    )


def hourly_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events fused per hour, each weighted by 1 + user_id mod 5; grade by the spread."""
    events = table(spark, sf_dir, "events").select(
        F.date_trunc("hour", "ts").alias("hour"), "value", (1.0 + F.pmod("user_id", F.lit(5))).alias("weight")
    )
    fused = robust_fusion(events, ["hour"], "value", "weight")
    grade = F.when(F.col("spread") < 20, "A").when(F.col("spread") < 25, "B").when(F.col("spread") < 30, "C").otherwise("D")
    return fused.withColumn("grade", grade).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


QUERIES = {"hourly_fusion": hourly_fusion}

ORACLES = {
    "hourly_fusion": """
WITH e AS (SELECT date_trunc('hour', ts) AS h, value AS v, 1.0 + (user_id % 5) AS w FROM events WHERE value IS NOT NULL),
m AS (SELECT h, median(v) AS med FROM e GROUP BY h),
d AS (SELECT e.h, v, w, abs(v - med) AS dev FROM e JOIN m USING (h)),
s AS (SELECT h, median(dev) AS mad FROM d GROUP BY h),
k AS (SELECT d.*, dev <= 3.0 * 1.4826 * mad AS ok FROM d JOIN s USING (h)),
f AS (SELECT h, count(*) AS n, count(*) FILTER (ok) AS n_used,
  round(sum(v * w) FILTER (ok) / sum(w) FILTER (ok), 6) AS fused, round(stddev_pop(v) FILTER (ok), 6) AS spread FROM k GROUP BY h)
SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, n, n_used, fused, spread,
  CASE WHEN spread < 20 THEN 'A' WHEN spread < 25 THEN 'B' WHEN spread < 30 THEN 'C' ELSE 'D' END AS grade FROM f""",
}
