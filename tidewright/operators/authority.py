"""Which source of time is in charge: availability with hysteresis, demotion, cross-checks by witnesses, published offset."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StringType, StructType

from tidewright.operators import blocks

#: Levels from the highest, sigmas in ms of those trusted without a measurement, least bounds in ms of pairs, and levels that a witness by the system clock cannot overrule.
LEVELS = ("T6", "T5", "T4", "T3", "T2", "T1", "T0")
TRUST_MS = {"T5": 1.0, "T4": 2.0, "T2": 20.0, "T1": 1.0}
PAIR_FLOOR_MS = {("T6", "T5"): 5.0, ("T3", "T4"): 2.0, ("T3", "T2"): 5.0}
SHIELDED = ("T6", "T5")
FORCED_DOWN_MS = 1000.0

RESULT = "struct<level:string,available:boolean,offset:double,sigma:double,frame:string,breach:boolean,grounded:boolean>"


def ticks(probes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each tick: the results of all levels in order of rank, those without a probe as unavailable.

    Of several results of a level at a tick the last in order of values counts. Columns
    that are absent are null: offset, sigma (ms), frame ('sysclock' if null), breach and
    grounded (false if null).
    """
    have = set(probes.columns)
    part = lambda c, kind, rest: (F.coalesce(F.col(c).cast(kind), F.lit(rest)) if c in have else F.lit(rest).cast(kind)).alias(c)
    row = F.struct("level", part("available", "boolean", False), part("offset", "double", None), part("sigma", "double", None), part("frame", "string", "sysclock"), part("breach", "boolean", False), part("grounded", "boolean", False))
    gathered = probes.groupBy(*keys, at).agg(*[F.max(F.when(F.col("level") == level, row)).alias(level) for level in LEVELS])
    absent = lambda level: F.struct(F.lit(level).alias("level"), F.lit(False).alias("available"), F.lit(None).cast("double").alias("offset"), F.lit(None).cast("double").alias("sigma"), F.lit("sysclock").alias("frame"), F.lit(False).alias("breach"), F.lit(False).alias("grounded"))
    return gathered.select(*keys, at, F.array(*[F.coalesce(F.col(level), absent(level)) for level in LEVELS]).cast(f"array<{RESULT}>").alias("results"))


def picked(rows: DataFrame, keys: list[str], at: str, block: Column, hysteresis: int = 3) -> DataFrame:
    """``ticks`` with the levels that have been there for ``hysteresis`` ticks, the highest of them and how long it has been in breach.

    Counters are islands, as a level's counter is the number of ticks since it was last
    away: for each tick the number of the level's last absence, by running maxima over
    blocks of ticks. ``block`` grows with ``at``; keys are not null.
    """
    numbered = blocks.with_running(rows, keys, [at], block, F.lit(1), "_n")

    def since(frame: DataFrame, lost: dict[str, Column]) -> DataFrame:
        """For each name, how many ticks ago its condition last held."""
        parts = frame.withColumns({"_block": block, **{f"_{c}": F.when(x, F.col("_n")) for c, x in lost.items()}})
        tops = parts.groupBy(*keys, "_block").agg(*[F.max(f"_{c}").alias(f"_m{c}") for c in lost])
        along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        tops = tops.select(*keys, "_block", *[F.max(f"_m{c}").over(along).alias(f"_m{c}") for c in lost])
        within = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        local = parts.withColumns({f"_{c}": F.max(f"_{c}").over(within) for c in lost}).join(tops, [*keys, "_block"])
        told = {c: F.col("_n") - F.coalesce(F.greatest(f"_{c}", f"_m{c}"), F.lit(0)) for c in lost}
        return local.withColumns(told).drop("_block", *[f"_{c}" for c in lost], *[f"_m{c}" for c in lost])

    counted = since(numbered, {level: ~F.col("results")[i]["available"] for i, level in enumerate(LEVELS)})
    ready = F.filter(F.array(*[F.when(F.col(level) >= hysteresis, F.lit(level)) for level in LEVELS]), lambda x: x.isNotNull())
    # With a hysteresis of nothing a level still has to be there.
    ready = F.filter(ready, lambda x: F.exists("results", lambda r: (r["level"] == x) & r["available"]))
    out = counted.withColumn("counted", ready).withColumn("picked", F.get("counted", F.lit(0))).drop(*LEVELS)
    breach = F.coalesce((F.col("picked") == "T6") & F.col("results")[0]["breach"], F.lit(False))
    return since(out, {"breaches": ~breach}).drop("_n")


class Picker(StatefulProcessor):
    """The same automaton on a stream: a counter a level and the breach's, kept for each key."""

    def __init__(self, keys: list[str], at: str, hysteresis: int):
        self.keys, self.at, self.hysteresis = keys, at, hysteresis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", ", ".join(f"{level} long" for level in LEVELS) + ", breaches long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *counts, breaches = self.counters.get() if self.counters.exists() else [0] * (len(LEVELS) + 1)
        batch = pd.concat(list(rows)).sort_values(self.at)
        told = []
        for available, breach in zip(batch["available"], batch["breach"]):
            counts = [n + 1 if there else 0 for n, there in zip(counts, available)]
            counted = [level for level, n in zip(LEVELS, counts) if n >= max(1, self.hysteresis)]
            pick = counted[0] if counted else None
            breaches = breaches + 1 if pick == "T6" and breach else 0
            told.append((pick, counted, breaches))
        self.counters.update((*counts, breaches))
        out = batch[[self.at]].reset_index(drop=True)
        out[["picked", "counted", "breaches"]] = pd.DataFrame(told, columns=["picked", "counted", "breaches"])
        for i, (name, value) in enumerate(zip(self.keys, key)):
            out.insert(i, name, value)
        yield out


def picked_stream(rows: DataFrame, keys: list[str], at: str, hysteresis: int = 3) -> DataFrame:
    """Picks of a stream of ticks: keys, at, picked, counted, breaches. Join them to the ticks by key and time for ``decided``. Needs the RocksDB state store."""
    schema = StructType([rows.schema[c] for c in (*keys, at)])
    schema.add("picked", "string").add("counted", ArrayType(StringType())).add("breaches", "long")
    flat = rows.select(*keys, at, F.col("results.available").alias("available"), F.col("results")[0]["breach"].alias("breach"))
    return flat.groupBy(*keys).transformWithStateInPandas(Picker(keys, at, hysteresis), schema, "append", "None")


def _bound(a: Column, b: Column) -> Column:
    """By how much two results may differ: three sigmas of both, and no less than their pair's floor."""
    trust = lambda r: F.coalesce(r["sigma"], reduce(lambda rest, t: F.when(r["level"] == t[0], t[1]).otherwise(rest), TRUST_MS.items(), F.lit(1.0)))
    floor = reduce(lambda rest, p: F.when(((a["level"] == p[0][0]) & (b["level"] == p[0][1])) | ((a["level"] == p[0][1]) & (b["level"] == p[0][0])), p[1]).otherwise(rest), PAIR_FLOOR_MS.items(), F.lit(0.0))
    return F.greatest(3.0 * F.sqrt(trust(a) * trust(a) + trust(b) * trust(b)), floor)


def _differ(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a["offset"] - b["offset"]) > _bound(a, b), F.lit(False))


def decided(rows: DataFrame, demote: bool = False, breach_ticks: int = 3) -> DataFrame:
    """What each tick publishes: active, witnesses, disagreeing, advisory, flags, offset_ns and sigma_ns.

    With ``demote``, a T6 in breach for ``breach_ticks`` ticks gives way to a T5 that
    is ready. A level below that measures an offset is a witness; it disagrees beyond the pair's bound.
    The system clock's word against a T6 or T5 of the signal's own frame is advice
    only. Two or more that disagree with the active level and with none of each other
    take over, the highest of them; a T3 over a second from T2 gives way to it. An
    active level that is kept against others has its sigma widened to the largest
    difference and says so. Each row is decided by itself: no shuffle.
    """
    of = lambda level: F.get(F.filter("results", lambda r: r["level"] == level), F.lit(0))
    gives_way = F.lit(demote) & (F.col("picked") == "T6") & (F.col("breaches") >= breach_ticks) & F.array_contains("counted", "T5")
    out = rows.withColumn("_demoted", F.coalesce(gives_way, F.lit(False))).withColumn("_first", F.when(F.col("_demoted"), "T5").otherwise(F.col("picked")))
    out = out.withColumn("_a", of(F.col("_first")))
    a = F.col("_a")
    shielded = a["level"].isin(*SHIELDED) & (a["frame"] == "rtp")
    seen = F.filter("results", lambda r: r["available"] & r["offset"].isNotNull() & (r["level"] != a["level"]))
    out = out.withColumn("_w", F.when(a.isNull(), F.array().cast(f"array<{RESULT}>")).otherwise(seen))
    out = out.withColumn("_against", F.filter("_w", lambda r: _differ(a, r)))
    out = out.withColumn("_heard", F.filter("_against", lambda r: ~(shielded & (r["frame"] != "rtp"))))
    split = F.exists("_heard", lambda x: F.exists("_heard", lambda y: (x["level"] < y["level"]) & _differ(x, y)))
    outvoted = a["offset"].isNotNull() & (F.size("_heard") >= 2) & ~split
    out = out.withColumn("_second", F.when(outvoted, F.get("_heard", F.lit(0))["level"]).otherwise(F.col("_first")))
    out = out.withColumn("_b", of(F.col("_second")))
    t2 = F.get(F.filter("_w", lambda r: r["level"] == "T2"), F.lit(0))
    forced = F.coalesce((F.col("_second") == "T3") & (F.abs(F.col("_b")["offset"] - t2["offset"]) > FORCED_DOWN_MS), F.lit(False))
    out = out.withColumn("_forced", forced).withColumn("active", F.when(F.col("_forced"), "T2").otherwise(F.col("_second")))
    worst = F.array_max(F.transform("_heard", lambda r: F.abs(a["offset"] - r["offset"])))
    kept = (F.col("active") == F.col("_first")) & worst.isNotNull()
    out = out.withColumns({"_c": of(F.col("active")), "_wide": F.when(kept, F.ceil(worst * 1e6))})
    c = F.col("_c")
    measured = c["level"].isin("T3", "T6")
    trusted = reduce(lambda rest, t: F.when(c["level"] == t[0], t[1]).otherwise(rest), TRUST_MS.items(), F.lit(None).cast("double"))
    offset = F.when(measured, c["offset"]).when(trusted.isNotNull(), F.when(c["grounded"], F.coalesce(c["offset"], F.lit(0.0))).otherwise(0.0))
    sigma = F.when(measured, c["sigma"]).when(trusted.isNotNull(), F.when(c["grounded"], F.coalesce(c["sigma"], trusted)).otherwise(trusted))
    offset_ns, sigma_ns = F.round(offset * 1e6).cast("long"), F.round(sigma * 1e6).cast("long")
    widened = offset_ns.isNotNull() & (F.col("_wide") > F.coalesce(sigma_ns, F.lit(0)))
    names = lambda c: F.transform(c, lambda r: r["level"])
    flags = F.filter(
        F.array(
            F.when(outvoted, F.concat(F.lit("majority-downgrade:"), "_first", F.lit("->"), "_second")), F.when(F.col("_forced"), "asymmetric-T3-T2"),
            F.when(F.col("_demoted"), F.concat(F.lit("demote-t6-breach->t5:"), F.col("breaches").cast("string"), F.lit("cycles"))), F.when(kept & (F.col("_wide") > 0), "TIMING_DISAGREEMENT"),
        ),
        lambda x: x.isNotNull(),
    )
    out = out.withColumns({"witnesses": names("_w"), "disagreeing": names("_against"), "advisory": names(F.array_except("_against", "_heard")), "flags": flags, "offset_ns": offset_ns, "sigma_ns": F.when(widened, F.col("_wide")).otherwise(sigma_ns)})
    return out.drop(*[c for c in out.columns if c in ("_demoted", "_first", "_a", "_w", "_against", "_heard", "_second", "_b", "_forced", "_c", "_wide")])


def transitions(rows: DataFrame, keys: list[str], at: str, block: Column) -> DataFrame:
    """The ticks at which the active level changed: keys, at, before, active. The first counts if it has a level."""
    told = blocks.with_previous(rows, keys, [at], block, ["active"], "_was")
    return told.where(~F.col("active").eqNullSafe(F.col("_was.active"))).select(*keys, at, F.col("_was.active").alias("before"), "active")
