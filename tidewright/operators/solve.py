"""Joint solutions: which path each arrival came by, told from differences in which the clock's error cancels."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.geometry import EARTH_KM, LIGHT_KM_S

#: Name, hops, height in km (None: the F layer's), the distances between which a path is plausible, the one at which its plausibility changes, and that below and from there on.
PATHS = (
    ("1E", 1, 110.0, None, 2000.0, 1500.0, 1.0, 0.7),
    ("1F", 1, None, None, 4000.0, 3000.0, 1.0, 0.8),
    ("2F", 2, None, 1500.0, 8000.0, 3000.0, 0.5, 0.8),
    ("3F", 3, None, 4000.0, None, None, 0.7, 0.7),
)
MODE = "struct<mode:string,hops:int,delay:double,plausibility:double>"


def path_modes(distance_km: Column, f_height: float = 300.0) -> Column:
    """The paths that are plausible over a distance, with their delays in ms, as an array of (mode, hops, delay, plausibility)."""
    found = []
    for name, hops, height, low, high, step, near, far in PATHS:
        top = EARTH_KM + (f_height if height is None else height)
        chord = F.lit(EARTH_KM) * F.cos(distance_km / (2 * hops * EARTH_KM))
        delay = 2 * hops * F.sqrt(F.lit(top * top) - chord * chord) / LIGHT_KM_S * 1000
        fits = F.lit(True)
        if low is not None:
            fits &= distance_km > low
        if high is not None:
            fits &= distance_km < high
        # The two-hop path is the likelier beyond its step, from there on and not at it.
        likely = F.lit(near) if step is None else F.when(distance_km <= step if hops > 1 else distance_km < step, near).otherwise(far)
        found.append(F.when(fits, F.struct(F.lit(name).alias("mode"), F.lit(hops).alias("hops"), delay.alias("delay"), likely.alias("plausibility"))))
    return F.filter(F.array(*found), lambda m: m.isNotNull()).cast(f"array<{MODE}>")


def fit_score(rms: float) -> float:
    """How well differences fit, 1 at best: never rises with ``rms``."""
    if rms < 0.05:
        return 1.0
    if rms < 0.2:
        return 0.9 - rms
    if rms < 0.5:
        return 0.5 - rms * 0.5
    return 0.1 / (1 + rms * 2)


def best_assignment(errors: Sequence[Sequence[float]], plausibility: Sequence[Sequence[float]], most_nodes: int = 20_000) -> tuple[list[int], float, float, bool]:
    """An option for each observation: choice, root mean square of all pairwise differences of its errors, score, and whether none can be better.

    The score is 0.9 of the fit's and 0.1 of the product of plausibilities; of equal
    ones the first choice in order wins. The sum of squared pair differences is n times
    that about the mean, and the choice with the least of these has each observation
    at its option nearest to the mean. So a sweep of the mean over the midpoints of
    neighbouring options meets it among a few dozen candidates: where branch and bound
    starts. A branch's sum only grows with each observation, which bounds its score.
    After ``most_nodes`` nodes the best so far is returned, not proven.
    """
    n = len(errors)

    def judged(choice: list[int]) -> tuple[float, float]:
        e = np.array([errors[i][c] for i, c in enumerate(choice)])
        rms = math.sqrt(2 * float(((e - e.mean()) ** 2).sum()) / (n - 1))
        return rms, round(0.9 * fit_score(rms) + 0.1 * math.prod(plausibility[i][c] for i, c in enumerate(choice)), 12)

    ends = sorted({(a + b) / 2 for e in errors for a, b in zip(sorted(e), sorted(e)[1:])})
    middles = [ends[0] - 1, *[(a + b) / 2 for a, b in zip(ends, ends[1:])], ends[-1] + 1] if ends else [0.0]
    best, best_rms, best_score = [0] * n, *judged([0] * n)
    for middle in middles:
        choice = [min(range(len(e)), key=lambda c: abs(e[c] - middle)) for e in errors]
        rms, score = judged(choice)
        if score > best_score or (score == best_score and choice < best):
            best, best_rms, best_score = choice, rms, score

    order = sorted(range(n), key=lambda i: len(errors[i]))
    rest = [1.0] * (n + 1)
    for k in range(n - 1, -1, -1):
        rest[k] = rest[k + 1] * max(plausibility[order[k]])
    nodes = 0
    stack = [(0, 0.0, 0.0, 1.0, ())]
    while stack and nodes <= most_nodes:
        k, mean, squares, likely, taken = stack.pop()
        nodes += 1
        bound = round(0.9 * fit_score(math.sqrt(2 * squares / (n - 1))) + 0.1 * likely * rest[k], 12)
        if bound < best_score:
            continue
        if k == n:
            choice = [0] * n
            for i, c in zip(order, taken):
                choice[i] = c
            rms, score = judged(choice)
            if score > best_score or (score == best_score and choice < best):
                best, best_rms, best_score = choice, rms, score
            continue
        i = order[k]
        for c in sorted(range(len(errors[i])), key=lambda c: -abs(errors[i][c] - mean)):
            off = errors[i][c] - mean
            stack.append((k + 1, mean + off / (k + 1), squares + off * off * k / (k + 1), likely * plausibility[i][c], (*taken, c)))
    return best, best_rms, best_score, not stack


def global_solution(observations: DataFrame, keys: list[str], name: str, timing: str, modes: str, most_nodes: int = 20_000) -> DataFrame:
    """Per key the clock's error from all its observations at once, and the path of each.

    ``observations`` has a row for each key and broadcast, of which there are few dozens
    at most by nature: its arrival against the second in ms and its plausible paths
    (``path_modes``; one without any counts as of unknown path). The best assignment of
    paths is that whose pairwise differences fit the observed ones. A key with one
    observation has no solution: confidence 0, grade D. Rows without an arrival are
    left out. ``exact`` is false where the search stopped at ``most_nodes``.
    """
    unknown = F.array(F.struct(F.lit("UNKNOWN").alias("mode"), F.lit(0).alias("hops"), F.lit(0.0).alias("delay"), F.lit(0.1).alias("plausibility"))).cast(f"array<{MODE}>")
    known = observations.where(F.col(timing).isNotNull() & ~F.isnan(timing)).withColumn("_m", F.when(F.size(modes) > 0, F.col(modes)).otherwise(unknown))
    row = F.struct(F.col(name).cast("string").alias("name"), F.col(timing).alias("timing"), F.col("_m").alias("modes"), F.col("_m.delay").alias("delays"), F.col("_m.plausibility").alias("likely"))
    gathered = known.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_o"))

    @F.pandas_udf("struct<chosen:array<int>,rms:double,score:double,exact:boolean>")
    def solve(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for timings, delays, likely in parts:
            rows = []
            for t, d, p in zip(timings, delays, likely):
                errors = [[at - x for x in option] for at, option in zip(t, d)]
                rows.append(best_assignment(errors, [list(x) for x in p], most_nodes) if len(t) > 1 else ([0] * len(t), None, None, True))
            yield pd.DataFrame(rows, columns=["chosen", "rms", "score", "exact"])

    # Not to be moved into what reads it: Python cannot run within a function over arrays.
    told = gathered.withColumn("_s", solve.asNondeterministic()("_o.timing", "_o.delays", "_o.likely"))
    paths_of = F.zip_with("_o", F.col("_s.chosen"), lambda o, c: F.struct(o["name"].alias("name"), o["timing"].alias("timing"), F.get(o["modes"], c).alias("_m")))
    flat = F.transform(paths_of, lambda x: F.struct(x["name"].alias("name"), x["timing"].alias("timing"), x["_m"]["mode"].alias("mode"), x["_m"]["hops"].alias("hops"), x["_m"]["delay"].alias("delay")))
    out = told.select(*keys, F.size("_o").cast("long").alias("n"), flat.alias("assignments"), F.col("_s.rms").alias("rms"), F.col("_s.score").alias("score"), F.col("_s.exact").alias("exact"))
    errors = F.transform(F.filter("assignments", lambda x: x["hops"] > 0), lambda x: x["timing"] - x["delay"])
    consistency = F.when(F.col("rms") < 0.5, 1.0).when(F.col("rms") < 1.0, 0.8).when(F.col("rms") < 2.0, 0.5).otherwise(0.2)
    out = out.withColumns({
        "pairs": (F.col("n") * (F.col("n") - 1) / 2).cast("long"),
        "clock_error": F.when(F.col("n") > 1, F.try_divide(F.aggregate(errors, F.lit(0.0), lambda a, e: a + e), F.size(errors))),
        "_c": consistency,
    }).withColumn("uncertainty", F.col("rms") / F.sqrt(F.nullif("pairs", F.lit(0))))
    bonus = F.least(F.lit(2.0), 1.0 + 0.1 * F.col("n")) / 2
    u = F.col("uncertainty")
    grade = F.when((u < 0.5) & (F.col("_c") > 0.8) & (F.col("n") >= 3), "A").when((u < 1.0) & (F.col("_c") > 0.5), "B").when(u < 2.0, "C").otherwise("D")
    return out.select(
        *keys, "n", "pairs", "clock_error", "rms", "uncertainty", "score", F.when(F.col("n") > 1, F.least(F.lit(1.0), F.col("score") * F.col("_c") * bonus)).otherwise(0.0).alias("confidence"),
        F.coalesce((F.col("_c") > 0.5) & (F.col("n") > 1) & F.col("rms").isNotNull(), F.lit(False)).alias("verified"), grade.alias("grade"), "assignments", "exact",
    )


def pair_solutions(observations: DataFrame, keys: list[str], name: str, timing: str, modes: str, spread: str | None = None) -> DataFrame:
    """Each two observations of a key: the pair of paths whose difference fits best, and what clock error each side gives.

    Pairs meet in a join of the key's few observations with themselves, the name of the
    first before that of the second. Within a pair the at most sixteen pairs of paths
    are one array: no shuffle. A residual of 2 ms or more, of 1 or of 0.5 lowers the
    score, and so does a ``spread`` (ms) over 1. Sides that agree to 1 ms verify their mean.
    """
    cols = [F.col(name).alias("_n"), F.col(timing).alias("_t"), F.col(modes).alias("_m"), (F.lit(0.0) if spread is None else F.coalesce(F.col(spread), F.lit(0.0))).alias("_w")]
    known = observations.where(F.col(timing).isNotNull() & ~F.isnan(timing)).select(*keys, *cols)
    a, b = (known.select(*keys, *[F.col(c).alias(c + side) for c in ("_n", "_t", "_m", "_w")]) for side in "ab")
    pairs = a.join(b, keys).where("_na < _nb").withColumn("observed", F.col("_ta") - F.col("_tb"))
    penalty = F.when(F.greatest("_wa", "_wb") > 1.0, 0.7).otherwise(1.0)

    def option(x: Column, y: Column, i: Column, j: Column) -> Column:
        apart = F.abs(x["hops"] - y["hops"])
        likely = x["plausibility"] * y["plausibility"] * F.when(apart == 0, 1.0).when(apart == 1, 0.9).otherwise(0.7)
        expected = x["delay"] - y["delay"]
        off = F.abs(F.col("observed") - expected)
        score = F.when(off > 2.0, 0.1).when(off > 1.0, 0.4).when(off > 0.5, 0.7).otherwise(1.0) * likely * penalty
        return F.struct((-score).alias("_s"), i.alias("_i"), j.alias("_j"), x.alias("a"), y.alias("b"), expected.alias("expected"))

    options = F.flatten(F.transform("_ma", lambda x, i: F.transform("_mb", lambda y, j: option(x, y, i, j))))
    best = pairs.withColumn("_o", F.array_sort(options)).where(F.size("_o") > 0)
    first, second = F.col("_o")[0], F.get("_o", F.lit(1))
    best = best.withColumns({"mode_a": first["a"]["mode"], "mode_b": first["b"]["mode"], "expected": first["expected"], "separation": F.coalesce(F.abs(first["expected"] - second["expected"]), F.lit(10.0)), "error_a": F.col("_ta") - first["a"]["delay"], "error_b": F.col("_tb") - first["b"]["delay"], "_best": -first["_s"]})
    best = best.withColumn("agreement", F.abs(F.col("error_a") - F.col("error_b")))
    sure = F.col("_best") * F.least(F.lit(1.0), F.col("separation") / 0.5)
    verified = F.col("agreement") < 1.0
    confidence = F.when(verified, F.least(F.lit(1.0), sure * 1.3)).when(F.col("agreement") < 2.0, sure * 0.7).otherwise(sure * 0.3)
    error = F.when(verified, (F.col("error_a") + F.col("error_b")) / 2).otherwise(F.col("error_a"))
    return best.select(*keys, F.col("_na").alias("a"), F.col("_nb").alias("b"), "mode_a", "mode_b", "observed", "expected", error.alias("clock_error"), "agreement", verified.alias("verified"), confidence.alias("confidence"), "separation")


def anchored(rows: DataFrame, solutions: DataFrame, cycle: str, source: str, broadcast: str, value: str, weight: str, anchor: str = "GLOBAL") -> DataFrame:
    """``rows`` with a further one for each verified solution: its clock error at a weight of 100 times its confidence, 10 at least."""
    found = solutions.where("verified and clock_error is not null").select(
        F.col(cycle), F.lit(anchor).alias(source), F.lit(None).cast(rows.schema[broadcast].dataType).alias(broadcast), F.col("clock_error").alias(value), F.greatest(F.lit(10.0), 100.0 * F.col("confidence")).alias(weight)
    )
    return rows.select(cycle, source, broadcast, value, weight).unionByName(found)
