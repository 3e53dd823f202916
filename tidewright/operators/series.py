"""Operators on ordered series: differences, stability, phases, events and sessions.

``keys`` part the series and ``order`` (a list) orders each one fully.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def phase_adev(rows: DataFrame, keys: list[str], order: list[str], phase: str, steps: list[int], tau0: float = 1.0, overlapping: bool = True) -> DataFrame:
    """Allan deviation of a phase at each number of steps m of which the series has more than 2 m rows.

    One sort of each series serves all m; without overlap every m-th triple counts.
    """
    w = _along(keys, order)
    x = F.col(phase)
    at = F.row_number().over(w) - 1
    size = F.count("*").over(Window.partitionBy(*keys))
    second = {f"_d{m}": F.lead(x, 2 * m).over(w) - 2 * F.lead(x, m).over(w) + x for m in steps}
    wide = rows.withColumns({"_at": at, "_n": size, **second})
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"_d{m}").alias("d")) for m in steps]))
    long = wide.select(*keys, "_at", "_n", pairs.alias("_p")).select(*keys, "_at", "_n", "_p.m", "_p.d").where("d is not null")
    if not overlapping:
        long = long.where((F.col("_at") % F.col("m") == 0) & (F.col("_at") / F.col("m") < F.floor((F.col("_n") - 2 * F.col("m")) / F.col("m"))))
    tau = F.col("m") * tau0
    out = long.groupBy(*keys, "m").agg(F.count("*").alias("n"), F.avg(F.col("d") * F.col("d")).alias("_q"))
    return out.select(*keys, tau.alias("tau"), "n", F.sqrt(F.col("_q") / (2 * tau * tau)).alias("adev"))


def frequency_adev(rows: DataFrame, keys: list[str], order: list[str], frequency: str, steps: list[int], tau0: float = 1.0) -> DataFrame:
    """Overlapping Allan deviation of a frequency: differences of neighbouring means of m values."""
    w = _along(keys, order)
    size = F.count("*").over(Window.partitionBy(*keys))
    at = F.row_number().over(w)
    out = None
    for m in steps:
        mean = F.avg(frequency).over(w.rowsBetween(0, m - 1))
        held = rows.withColumns({"_mean": mean, "_n": size, "_at": at})
        diff = held.withColumn("_d", F.lead("_mean", m).over(w) - F.col("_mean")).where(F.col("_at") + 2 * m - 1 <= F.col("_n"))
        part = diff.groupBy(*keys).agg(F.lit(m * tau0).alias("tau"), F.count("_d").alias("n"), F.sqrt(F.avg(F.col("_d") * F.col("_d")) / 2).alias("adev"))
        out = part if out is None else out.unionByName(part)
    return out.where("n > 0")


def tracker_adev(rows: DataFrame, keys: list[str], order: list[str], value: str, step: int, tau: float) -> DataFrame:
    """The clock tracker's own estimator, not the usual one: differences over ``step`` rows, then over one, in milliseconds."""
    w = _along(keys, order)
    first = rows.withColumn("_d", F.lead(value, step).over(w) - F.col(value)).where("_d is not null")
    second = first.withColumn("_e", F.lead("_d").over(w) - F.col("_d"))
    return second.groupBy(*keys).agg(F.count("_e").alias("n"), (F.sqrt(F.avg(F.col("_e") * F.col("_e")) / 2) / 1000 / tau).alias("adev")).where("n >= 1")


def noise_type(adev: DataFrame, keys: list[str]) -> DataFrame:
    """Label by the slope of log adev over log tau; three or more positive points are needed."""
    good = adev.where((F.col("tau") > 0) & (F.col("adev") > 0))
    fit = good.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.log10("adev"), F.log10("tau")).alias("slope"))
    s = F.col("slope")
    label = F.when(F.col("n") < 3, "Insufficient data").when(s < -0.75, "White Phase Noise").when(s < -0.25, "Flicker Phase Noise")
    label = label.when(s < 0.25, "White Frequency Noise").when(s < 0.75, "Flicker Frequency Noise").otherwise("Random Walk Frequency")
    return fit.withColumn("noise", label)


def unwrapped(rows: DataFrame, keys: list[str], order: list[str], phase: str, out: str = "unwrapped", turn: float | None = None) -> DataFrame:
    """``rows`` with the phase continued over its jumps: steps of over half a turn lose whole turns; a step of exactly half keeps its sign. Null counts as 0."""
    turn_c = F.lit(turn) if turn is not None else 2 * F.pi()
    w = _along(keys, order)
    x = F.coalesce(F.col(phase), F.lit(0.0))
    step = x - F.lag(x).over(w)
    half = turn_c / 2
    wrapped = F.pmod(step + half, turn_c) - half
    wrapped = F.when((wrapped == -half) & (step > 0), half).otherwise(wrapped)
    fix = F.when(F.abs(step) < half, 0.0).otherwise(wrapped - step)
    told = rows.withColumn("_fix", F.coalesce(fix, F.lit(0.0)))
    return told.withColumn(out, x + F.sum("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fix")


def doppler(rows: DataFrame, keys: list[str], order: list[str], seconds: str, phase: str, smooth: int = 1) -> DataFrame:
    """Minus the phase's slope in hertz between neighbours, at the middle of the two, smoothed over an odd number of rows with zeros beyond the ends."""
    w = _along(keys, order)
    dt = F.col(seconds) - F.lag(seconds).over(w)
    raw = rows.withColumns({"_hz": -(F.col(phase) - F.lag(phase).over(w)) / (2 * F.pi() * F.nullif(dt, F.lit(0.0))), "middle": F.col(seconds) - dt / 2})
    raw = raw.where("_hz is not null")
    half = smooth // 2
    return raw.withColumn("doppler", F.sum("_hz").over(w.rowsBetween(-half, half)) / (2 * half + 1)).drop("_hz")


def scintillation(rows: DataFrame, keys: list[str], seconds: str, phase: str, power: str, least: int = 5) -> DataFrame:
    """Per key: sigma of the phase about its line over time, and S4, the root of the power's variance over its mean; ``least`` rows are needed."""
    fit = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.var_pop(phase).alias("_vy"), F.var_pop(seconds).alias("_vx"), F.covar_pop(phase, seconds).alias("_c"),
        F.avg(power).alias("_p"), F.var_pop(power).alias("_vp"),
    ).where(F.col("n") >= least)
    rest = F.col("_vy") - F.coalesce(F.try_divide(F.col("_c") * F.col("_c"), F.nullif(F.col("_vx"), F.lit(0.0))), F.lit(0.0))
    return fit.select(*keys, "n", F.sqrt(F.greatest(rest, F.lit(0.0))).alias("sigma_phi"), F.try_divide(F.sqrt("_vp"), F.nullif(F.col("_p"), F.lit(0.0))).alias("s4"))


def hopping_windows(rows: DataFrame, seconds: str, length: float, out: str = "window_start") -> DataFrame:
    """``rows`` once for each of the two half-overlapping windows that hold them."""
    hop = length / 2
    last = F.floor(F.col(seconds) / hop) * hop
    return rows.withColumn(out, F.explode(F.array(last - hop, last)))


def peaks(rows: DataFrame, keys: list[str], order: list[str], value: str, threshold: float, side: int = 5, ratio: float = 1.5) -> DataFrame:
    """Rows at ``threshold`` or more that exceed ``ratio`` times the mean of the ``side`` rows before and the mean of those after; both sides must be whole."""
    w = _along(keys, order)
    before, after = w.rowsBetween(-side, -1), w.rowsBetween(1, side)
    x = F.col(value)
    told = rows.withColumns({"_b": F.avg(x).over(before), "_a": F.avg(x).over(after), "_nb": F.count(x).over(before), "_na": F.count(x).over(after)})
    return told.where((F.col("_nb") == side) & (F.col("_na") == side) & (x >= threshold) & (x > F.col("_b") * ratio) & (x > F.col("_a"))).drop("_b", "_a", "_nb", "_na")


def jumps(rows: DataFrame, keys: list[str], order: list[str], value: str, limit: float, label: str | None = None) -> DataFrame:
    """Rows whose value changed by over ``limit`` from the row before, or whose label did: event (rise, fall, change) and change."""
    w = _along(keys, order)
    change = F.col(value) - F.lag(value).over(w)
    event = F.when(change > limit, "rise").when(change < -limit, "fall")
    if label:
        event = F.coalesce(event, F.when(F.lag(label).over(w) != F.col(label), "change"))
    return rows.withColumns({"change": change, "event": event}).where("event is not null")


def sessions(rows: DataFrame, keys: list[str], order: list[str], at: str, gap_seconds: float) -> DataFrame:
    """Per key, runs of rows less than or just ``gap_seconds`` apart: session, start, end, n and the gap before it."""
    w = _along(keys, order)
    since = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    marked = rows.withColumn("_since", since / 1e6).withColumn("_new", F.when(F.col("_since").isNull() | (F.col("_since") > gap_seconds), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.max(F.when(F.col("_new") == 1, F.col("_since")))
    return numbered.groupBy(*keys, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"), gap.alias("gap"))


def runs(rows: DataFrame, keys: list[str], order: list[str], flag: Column, least: int = 1) -> DataFrame:
    """Per key, unbroken runs of rows with ``flag``: first and last order value and length, of ``least`` rows or more."""
    w = _along(keys, order)
    told = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_row", F.row_number().over(w))
    inside = told.where("_flag").withColumn("_island", F.col("_row") - F.row_number().over(w))
    return inside.groupBy(*keys, "_island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_island")


def rates(rows: DataFrame, keys: list[str], order: list[str], counter: str, seconds: str) -> DataFrame:
    """Change of a counter per second since the row before; null where it fell, which is a restart."""
    w = _along(keys, order)
    delta, dt = F.col(counter) - F.lag(counter).over(w), F.col(seconds) - F.lag(seconds).over(w)
    return rows.withColumn("rate", F.when((delta >= 0) & (dt > 0), delta / dt))


def jitter(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Population deviation of the differences of neighbours."""
    told = rows.withColumn("_d", F.col(value) - F.lag(value).over(_along(keys, order)))
    return told.groupBy(*keys).agg(F.count("_d").alias("n"), F.stddev_pop("_d").alias("jitter"))


def halves_shift(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean of the later half minus that of the earlier one; the middle row of an odd number is later."""
    w, all_rows = _along(keys, order), Window.partitionBy(*keys)
    later = F.row_number().over(w) > F.floor(F.count("*").over(all_rows) / 2)
    told = rows.withColumn("_later", later)
    side = lambda c: F.avg(F.when(c, F.col(value)))
    return told.groupBy(*keys).agg(F.count("*").alias("n"), (side(F.col("_later")) - side(~F.col("_later"))).alias("shift"))


def resampled(rows: DataFrame, keys: list[str], seconds: str, value: str, step: int) -> DataFrame:
    """Values on the grid of whole ``step`` seconds between each key's first and last row, linear between neighbours.

    The grid's points are rows among the others, so a sort each way gives each its
    neighbours; both frames grow by a row at a time.
    """
    ends = rows.groupBy(*keys).agg(F.ceil(F.min(seconds) / step).alias("_a"), F.floor(F.max(seconds) / step).alias("_b")).where("_a <= _b")
    points = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias("_point"))
    grid = points.select(*keys, (F.col("_point") * step).cast("double").alias("at"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("_grid"))
    held = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(seconds).cast("double").alias("at")).agg(F.avg(value).alias("v")).withColumn("_grid", F.lit(0))
    w = _along(keys, ["at", "_grid"])
    known = F.when(F.col("_grid") == 0, F.struct("at", "v"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("_grid"))
    after = F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    both = grid.unionByName(held).withColumns({"_b": before, "_a": after}).where("_grid = 1")
    part = F.coalesce(F.try_divide(F.col("at") - F.col("_b.at"), F.nullif(F.col("_a.at") - F.col("_b.at"), F.lit(0.0))), F.lit(0.0))
    exact = F.col("_b.at") == F.col("at")
    return both.select(*keys, "at", F.when(exact, F.col("_b.v")).otherwise(F.col("_b.v") + part * (F.col("_a.v") - F.col("_b.v"))).alias("value"))
