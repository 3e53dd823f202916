"""Neighbours and running sums along long series, in blocks: no task holds a whole key, however hot it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, keys: list[str], order: list[str], block: Column, columns: list[str], out: str) -> DataFrame:
    """``rows`` with the struct ``out`` of ``columns`` in the row before along ``order``, null for a key's first row.

    ``block`` grows with ``order``: rows are put in order within each block, and a
    block's first row takes the last row of the block before from a table of one row a
    block. Keys are not null.
    """
    told = F.struct(*columns)
    parts = rows.withColumn("_block", block)
    within = Window.partitionBy(*keys, "_block").orderBy(*order)
    ends = parts.groupBy(*keys, "_block").agg(F.max_by(told, F.struct(*order)).alias("_end"))
    before = ends.select(*keys, "_block", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_before"))
    local = parts.withColumn("_local", F.lag(told).over(within))
    return local.join(before, [*keys, "_block"], "left").withColumn(out, F.coalesce("_local", "_before")).drop("_block", "_local", "_before")


def with_running(rows: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` along ``order``, the row itself included: sums of whole blocks, then within each."""
    parts = rows.withColumns({"_block": block, "_value": value})
    sums = parts.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_local", F.sum("_value").over(within))
    return local.join(before, [*keys, "_block"]).withColumn(out, F.col("_local") + F.col("_before")).drop("_block", "_value", "_local", "_before")
