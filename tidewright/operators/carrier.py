"""Content along a path from a carrier's phase: unwrapping, slips and gaps, anchors, and differences of two carriers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import blocks

#: The speed of light in m/s and the ionosphere's constant for a unit of 10^16 electrons a square metre.
LIGHT_M_S = 299_792_458.0
CONTENT_K = 40.3e16


def relative_content(rows: DataFrame, keys: list[str], seconds: str, phase: str, mhz: str, block: Column, slip_hz_s: float = 5.0, longest_gap: float = 120.0) -> DataFrame:
    """keys, seconds, mhz, content, rate, segment, event: content against the key's first row, straight from the phase.

    A step of the phase is the shortest way round. A step whose frequency changed by over
    ``slip_hz_s`` Hz a second from the step before is a slip, one over ``longest_gap``
    seconds a gap: both are coasted across, as if nothing had changed, and start a new
    ``segment``. ``event`` is 'slip', 'gap', or 'jump' for a step of over a quarter turn,
    where the way round was a near thing. Of rows at one time that of the smallest phase
    stays; rows without a time or phase, with a NaN, or of no positive frequency are left out.

    ``block`` grows with ``seconds``: neighbours and sums go by blocks, so no task holds
    a key. Keys are not null.
    """
    good = F.col(seconds).isNotNull() & F.col(phase).isNotNull() & ~F.isnan(phase) & (F.col(mhz) > 0)
    once = rows.where(good).groupBy(*keys, seconds).agg(F.min(F.struct(phase, mhz)).alias("_r")).select(*keys, seconds, F.col(f"_r.{phase}").alias("_phase"), F.col(f"_r.{mhz}").alias(mhz))
    first = blocks.with_previous(once, keys, [seconds], block, [seconds, "_phase"], "_p")
    turn = F.col("_phase") - F.col("_p._phase")
    # The shortest way, in [-pi, pi).
    step = turn - 2 * math.pi * F.floor(turn / (2 * math.pi) + 0.5)
    stepped = first.withColumns({"_step": step, "_dt": F.col(seconds) - F.col(f"_p.{seconds}")}).withColumn("_hz", F.col("_step") / (2 * math.pi * F.col("_dt"))).drop("_p")
    second = blocks.with_previous(stepped, keys, [seconds], block, ["_hz", "_dt"], "_q")
    gap = F.col("_dt") > longest_gap
    known = ~F.coalesce(F.col("_q._dt") > longest_gap, F.lit(False))
    slip = known & (F.abs(F.col("_hz") - F.col("_q._hz")) / F.col("_dt") > slip_hz_s)
    event = F.when(gap, "gap").when(slip, "slip").when(F.abs("_step") > math.pi / 2, "jump")
    told = second.withColumn("event", event).withColumn("_cut", F.coalesce(F.col("event").isin("gap", "slip"), F.lit(False)))
    told = told.withColumn("_go", F.when(F.col("_cut"), 0.0).otherwise(F.coalesce("_step", F.lit(0.0)))).drop("_q", "_phase", "_hz", "_step")
    told = blocks.with_running(told, keys, [seconds], block, F.col("_go"), "_sum")
    told = blocks.with_running(told, keys, [seconds], block, F.col("_cut").cast("long"), "segment")
    scale = -(LIGHT_M_S * F.col(mhz) * 1e6) / (2 * math.pi * CONTENT_K)
    return told.select(*keys, seconds, mhz, (scale * F.col("_sum")).alias("content"), (scale * F.col("_go") / F.col("_dt")).alias("rate"), "segment", "event")


def anchored_content(series: DataFrame, anchors: DataFrame, keys: list[str], seconds: str, anchor_at: str, anchor: str, anchor_sigma: str, reach: float = 90.0) -> DataFrame:
    """``series`` with content moved to the anchor that is nearest in time to a row of its segment, anchored (whether there is one) and its anchor_sigma.

    Only anchors within ``reach`` seconds of a row count; a segment without one stays
    relative. Of equally near pairs that with the earlier row, then anchor, counts.
    Rows and anchors meet by buckets of ``reach``, and what is kept of a segment is one
    pair.
    """
    bucket = F.floor(F.col(seconds) / reach)
    near = series.select(*keys, "segment", F.col(seconds).alias("_at"), F.col("content").alias("_c"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    marks = anchors.where(F.col(anchor_at).isNotNull() & F.col(anchor).isNotNull()).select(*keys, F.col(anchor_at).alias("_t"), F.col(anchor).alias("_v"), F.col(anchor_sigma).alias("_s"), F.floor(F.col(anchor_at) / reach).alias("_b"))
    age = F.abs(F.col("_at") - F.col("_t"))
    pairs = near.join(marks, [*keys, "_b"]).where(age <= reach)
    best = pairs.groupBy(*keys, "segment").agg(F.min(F.struct(age.alias("age"), "_at", "_t", (F.col("_v") - F.col("_c")).alias("move"), "_s")).alias("_best"))
    joined = series.join(best, [*keys, "segment"], "left")
    return joined.select(*series.columns[: series.columns.index("content")], (F.col("content") + F.coalesce("_best.move", F.lit(0.0))).alias("content"), *series.columns[series.columns.index("content") + 1 :], F.col("_best").isNotNull().alias("anchored"), F.col("_best._s").alias("anchor_sigma"))


def content_differences(series: DataFrame, keys: list[str], seconds: str, mhz: str, grid: float = 1.0) -> DataFrame:
    """Per key and two carriers: common grid points, and the root mean square of how far their contents go apart, each less its mean.

    Each carrier's content on the grid is the mean of its rows in that step, so
    nothing is interpolated over a gap; steps that only one of them has are left out, and
    so are pairs of fewer than three. A key's carriers are few, so their pairs are, too.
    """
    on_grid = series.groupBy(*keys, mhz, F.floor(F.col(seconds) / grid).alias("_g")).agg(F.avg("content").alias("_c"))
    a, b = (on_grid.select(*keys, "_g", F.col(mhz).alias(f"{mhz}_{s}"), F.col("_c").alias(f"_{s}")) for s in "ab")
    pairs = a.join(b, [*keys, "_g"]).where(F.col(f"{mhz}_a") < F.col(f"{mhz}_b")).withColumn("_d", F.col("_a") - F.col("_b"))
    return pairs.groupBy(*keys, f"{mhz}_a", f"{mhz}_b").agg(F.count("*").alias("n"), F.stddev_pop("_d").alias("rms")).where("n >= 3")
