"""Event-time aggregates of measurement streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(rows: DataFrame, at: str, keys: list[str], value: str, length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Mean, extremes, spread and count per key and tumbling window; of rows later than ``late`` the watermark takes no notice."""
    groups = rows.withWatermark(at, late).groupBy(F.window(at, length), *keys)
    out = groups.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("spread"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "mean", "low", "high", "spread")


def once(rows: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first row within the watermark: what has been processed is not processed again."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def paired(left: DataFrame, right: DataFrame, left_at: str, right_at: str, keys: list[str], reach: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of two streams with equal keys and times within ``reach``; state goes as the watermarks pass."""
    a, b = left.withWatermark(left_at, late), right.withWatermark(right_at, late).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.col(right_at).between(F.col(left_at) - F.expr(f"interval {reach}"), F.col(left_at) + F.expr(f"interval {reach}"))
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    return a.join(b, same).drop(*[f"_{k}" for k in keys])
