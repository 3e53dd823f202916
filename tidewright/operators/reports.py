"""Operators behind reports: the newest part of a stream, states by age, conditions, events and the fusion cycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(rows: DataFrame, at: str, seconds: float, base: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``seconds`` before the newest time ``at`` of ``base`` (or of ``rows``).

    The newest time is read while the plan is made: give the stored table as ``base``
    where ``rows`` are the outcome of much work, which would be done twice. The bound
    is then a constant time stamp on the bare column, so it reaches the scan.
    """
    newest = (rows if base is None else base).agg(F.unix_micros(F.max(at).cast("timestamp"))).first()[0]
    return rows.where(F.lit(False)) if newest is None else rows.where(F.col(at) > F.timestamp_micros(F.lit(newest - round(seconds * 1e6))))


def by_age(age: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step that the age is not over."""
    return reduce(lambda rest, step: F.when(age <= step[0], step[1]).otherwise(rest), reversed(steps), F.lit(otherwise))


def conditions(rows: DataFrame, keys: list[str], mode: str, snr: str, frequency: str, order: list[str], least_snr: float = 15.0, least: int = 3, factor: float = 1.15) -> DataFrame:
    """Per key: rows, dominant mode (of equally frequent ones that seen first), its share, mean signal and usable frequency.

    The last is ``factor`` times the highest frequency that came by the dominant
    mode, where that is one of hops by the F layer and ``least`` of its rows have
    ``least_snr``. Counts by mode come first, so little is left to shuffle.
    """
    strong = F.col(snr) >= least_snr
    counts = rows.groupBy(*keys, mode).agg(
        F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"), F.sum(snr).alias("_q"), F.max(F.when(strong, F.col(frequency))).alias("_top"), F.count(F.when(strong, 1)).alias("_strong")
    )
    best = F.min_by(F.struct(F.col(mode).alias("mode"), "_n", "_top", "_strong"), F.struct(-F.col("_n"), F.col("_first")))
    told = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), best.alias("_b"), (F.sum("_q") / F.sum("_n")).alias("mean_snr"))
    usable = F.when(F.col("_b.mode").rlike(r"^\d+F") & (F.col("_b._strong") >= least), F.col("_b._top") * factor)
    return told.select(*keys, "n", F.col("_b.mode").alias("dominant"), (F.col("_b._n") / F.col("n")).alias("share"), "mean_snr", usable.alias("usable"))


def merged_statistics(rows: DataFrame, keys: list[str], part: Column, value: str) -> DataFrame:
    """n, mean and sample variance per key, merged from those of its parts: the pairwise form, which keeps its digits where sums of squares lose them."""
    parts = rows.where(F.col(value).isNotNull()).groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    whole = parts.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("mean"))
    apart = F.col("_m") - F.col("mean")
    squares = parts.join(whole, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("_n") * (F.col("_v") + apart * apart)).alias("_s"))
    return squares.select(*keys, "n", "mean", F.when(F.col("n") > 1, F.col("_s") / (F.col("n") - 1)).alias("variance"))


#: Trust by grade and by path that a variance does not tell, and what others get.
TRUST_BY_GRADE = {"A": 1.0, "B": 0.9, "C": 0.7, "D": 0.5}
TRUST_BY_MODE = {"1E": 1.0, "1F": 0.95, "2F": 0.85, "3F": 0.7, "GW": 1.0}
TRUST_ELSE = {"grade": 0.5, "mode": 0.7}


def variance_weight(sigma: Column, grade: Column, mode: Column, default: float = 1.0, floor: float = 0.05) -> Column:
    """Precision times trust: 1 / sigma^2 by grade and path, 0.01 at least. A sigma that is missing or not positive counts as ``default``."""
    told = lambda c, table, rest: reduce(lambda otherwise, item: F.when(c == item[0], item[1]).otherwise(otherwise), table.items(), F.lit(rest))
    s = F.greatest(F.when(sigma > 0, sigma).otherwise(default), F.lit(floor))
    return F.greatest(told(grade, TRUST_BY_GRADE, TRUST_ELSE["grade"]) * told(mode, TRUST_BY_MODE, TRUST_ELSE["mode"]) / (s * s), F.lit(0.01))


def fusion_cycle(
    rows: DataFrame, cycle: str, source: str, broadcast: str, value: str, weight: str, minutes: float = 1.0, anchor: str | None = None, most_off: float = 100.0, scale: tuple[float, float] = (0.5, 5.0), jump: float = 5.0,
    drift: float = 0.001, most_uncertain: float = 10.0, grades: tuple = ((1.0, "A"), (2.0, "B"), (5.0, "C")),
) -> DataFrame:
    """One fused value for each cycle: gate, weights, two levels of estimates, holdover, jump hold and grade.

    ``cycle`` is the number of a cycle of ``minutes`` minutes. Gate: with more than two
    values, those less than min(``most_off``, 3.5 scaled MADs, held within ``scale``)
    from the median stay, or all if none is. Sources have weighted means; the fused
    value is the weighted mean of all. Its uncertainty is the larger of the formal one
    and the weighted scatter of the values about it, so that it is never tighter than
    they are.

    A cycle of fewer than two sources or broadcasts, not counting ``anchor``'s rows,
    is not locked: it takes the last locked value, and the uncertainty of that grows
    by ``drift`` a minute since, in squares, to at most ``most_uncertain`` and to at
    most twice the cycle's own. Before the first lock it is 1 at most. A value that moves by over
    ``jump`` from the cycle before is held back for one cycle.

    Cycles are aggregated before their windows, so what one task orders is a row
    a cycle. Null and NaN values are left out.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    centre = known.groupBy(cycle).agg(F.median(value).alias("_med"), F.count("*").alias("n"))
    near = known.join(centre, cycle).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    bound = near.groupBy(cycle).agg(F.least(F.lit(most_off), 3.5 * F.least(F.greatest(1.4826 * F.median("_off"), F.lit(scale[0])), F.lit(scale[1]))).alias("_bound"), F.min("_off").alias("_least"))
    gated = near.join(bound, cycle).where((F.col("n") <= 2) | (F.col("_off") < F.col("_bound")) | (F.col("_least") >= F.col("_bound")))
    w, x = F.col(weight), F.col(value) - F.col("_med")
    own = F.lit(True) if anchor is None else F.col(source) != anchor
    per_source = gated.where(w > 0).groupBy(cycle, source).agg(F.first("n").alias("n"), F.first("_med").alias("_med"), F.count("*").alias("_k"), F.sum(w).alias("_w"), F.sum(w * x).alias("_wx"), F.sum(w * x * x).alias("_wxx"), F.collect_set(F.when(own, F.col(broadcast))).alias("_b"))
    mean = F.when(own, F.col("_wx") / F.col("_w"))
    out = per_source.groupBy(cycle).agg(
        F.first("n").alias("n"), F.sum("_k").alias("used"), F.count(F.when(own, 1)).alias("sources"), F.size(F.array_distinct(F.flatten(F.collect_list("_b")))).cast("long").alias("broadcasts"),
        F.first("_med").alias("_med"), F.sum("_w").alias("_w"), (F.sum("_wx") / F.sum("_w")).alias("_x"), (F.sum("_wxx") / F.sum("_w")).alias("_xx"), (F.max(mean) - F.min(mean)).alias("agreement"),
    )
    scatter = F.sqrt(F.greatest(F.col("_xx") - F.col("_x") * F.col("_x"), F.lit(0.0)))
    locked = (F.col("sources") >= 2) & (F.col("broadcasts") >= 2)
    out = out.withColumns({"raw": F.col("_med") + F.col("_x"), "_u": F.greatest(1 / F.sqrt("_w"), scatter), "locked": locked})
    along = Window.orderBy(cycle)
    last = F.max(F.when(F.col("locked"), F.struct(cycle, "raw", "_u"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_last", last)
    coasting = ~F.col("locked") & F.col("_last").isNotNull()
    grown = drift * minutes * (F.col(cycle) - F.col(f"_last.{cycle}"))
    held_u = F.coalesce(F.sqrt(F.col("_last._u") * F.col("_last._u") + grown * grown), F.lit(1.0))
    out = out.withColumns({
        "coasting": coasting, "_held": F.when(coasting, F.col("_last.raw")).otherwise(F.col("raw")),
        "uncertainty": F.when(F.col("locked"), F.col("_u")).otherwise(F.least(held_u, 2.0 * F.col("_u"), F.lit(most_uncertain))),
    })
    before = F.lag("_held").over(along)
    jumped = F.coalesce(F.abs(F.col("_held") - before) > jump, F.lit(False))
    out = out.withColumns({"jumped": jumped, "fused": F.when(jumped, before).otherwise(F.col("_held"))})
    grade = by_age(F.col("uncertainty"), list(grades), "D")
    return out.select(cycle, "n", "used", "sources", "broadcasts", "agreement", "raw", "uncertainty", "locked", "coasting", "jumped", "fused", F.when(F.col("locked"), grade).otherwise("D").alias("grade"))


def logistic_fit(rows: DataFrame, features: list[str], label: str, rounds: int = 25, l2: float = 1e-6) -> list[float]:
    """Weights (one for each feature, then the intercept) of a logistic model, by Newton steps.

    A step is one aggregation: gradient and curvature of k features are (k + 1)(k + 4) / 2
    sums, whatever the number of rows. Rows with a null are left out; without
    rows of both labels all weights are 0.
    """
    import numpy as np

    known = rows.select(*[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], F.lit(1.0).alias(f"_x{len(features)}"), F.col(label).cast("double").alias("_y")).dropna()
    k, w = len(features) + 1, np.zeros(len(features) + 1)
    if known.agg(F.count_distinct("_y")).first()[0] < 2:
        return w.tolist()
    for _ in range(rounds):
        z = reduce(lambda a, b: a + b, [F.lit(float(w[i])) * F.col(f"_x{i}") for i in range(k)])
        p = 1 / (1 + F.exp(-z))
        sums = known.withColumn("_p", p).agg(
            *[F.sum((F.col("_y") - F.col("_p")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(k)],
            *[F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)],
        ).first()
        g = np.array([sums[f"g{i}"] for i in range(k)]) - l2 * w
        h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + l2 * np.eye(k)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()
