"""The authority automaton: a table of cases, batch against stream, and restarts."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import authority

SCHEMA = "unit string, at long, level string, available boolean, offset double, sigma double, frame string, breach boolean, grounded boolean"


def measure(level, offset, sigma, frame="rtp", **more):
    return dict(level=level, available=True, offset=offset, sigma=sigma, frame=frame) | more


def trust(level, offset=0.0):
    return measure(level, offset, authority.TRUST_MS[level], "sysclock")


def gone(level):
    return dict(level=level, available=False)


#: Name: the results of each tick, hysteresis, demotion, and what is expected of the last tick.
CASES = {
    "none until the hysteresis is met": ([[measure("T3", 0.8, 0.5)]] * 2, 3, False, dict(active=None, witnesses=[])),
    "then active": ([[measure("T3", 0.8, 0.5)]] * 3, 3, False, dict(active="T3", offset_ns=800_000, sigma_ns=500_000)),
    "down at once": ([[measure("T3", 0.8, 0.5)]] * 4 + [[gone("T3")]], 3, False, dict(active=None, offset_ns=None, sigma_ns=None)),
    "and up late again": ([[measure("T3", 0.8, 0.5)]] * 4 + [[gone("T3")]] + [[measure("T3", 0.8, 0.5)]] * 2, 3, False, dict(active=None)),
    "the highest wins": ([[trust("T4"), measure("T3", 0.5, 0.3)]], 1, False, dict(active="T4", witnesses=["T3"], flags=[], offset_ns=0, sigma_ns=2_000_000)),
    "kept against one is widened": ([[trust("T4"), measure("T3", 20.0, 0.5)]], 1, False, dict(active="T4", disagreeing=["T3"], flags=["TIMING_DISAGREEMENT"], sigma_ns=20_000_000)),
    "two of one mind take over": ([[measure("T3", 100.0, 1.0), trust("T2"), trust("T1")]], 1, False, dict(active="T2", flags=["majority-downgrade:T3->T2"], sigma_ns=20_000_000)),
    "two at odds do not": ([[measure("T3", 100.0, 0.1), trust("T2", 400.0), measure("T1", -300.0, 1.0, "sysclock")]], 1, False, dict(active="T3", flags=["TIMING_DISAGREEMENT"], sigma_ns=400_000_000)),
    "a second from T2 forces T3 down": ([[measure("T3", 1500.0, 1.0), trust("T2")]], 1, False, dict(active="T2", flags=["asymmetric-T3-T2"])),
    "the system clock cannot overrule T6": ([[measure("T6", 0.0, 0.001), trust("T4", 500.0), trust("T2", 500.0)]], 1, False, dict(active="T6", disagreeing=["T4", "T2"], advisory=["T4", "T2"], flags=[], sigma_ns=1_000)),
    "the same frame can": ([[measure("T6", 0.0, 0.001), measure("T5", 500.0, 1.0), measure("T3", 500.0, 1.0)]], 1, False, dict(active="T5", flags=["majority-downgrade:T6->T5"], offset_ns=0)),
    "within the pair's floor": ([[measure("T6", 0.0, 0.001), measure("T5", 4.9, 0.001)]], 1, False, dict(active="T6", disagreeing=[])),
    "breach too short": ([[measure("T6", 0.0, 0.1, breach=True), measure("T5", 0.1, 0.1, grounded=True)]] * 2, 1, True, dict(active="T6", breaches=2)),
    "breach long enough": ([[measure("T6", 0.0, 0.1, breach=True), measure("T5", 0.1, 0.2, grounded=True)]] * 3, 1, True, dict(active="T5", flags=["demote-t6-breach->t5:3cycles"], offset_ns=100_000, sigma_ns=200_000)),
    "not without the switch": ([[measure("T6", 0.0, 0.1, breach=True), measure("T5", 0.1, 0.1)]] * 5, 1, False, dict(active="T6", breaches=5)),
    "the breach clears": ([[measure("T6", 0.0, 0.1, breach=True), measure("T5", 0.1, 0.1)]] * 3 + [[measure("T6", 0.0, 0.1), measure("T5", 0.1, 0.1)]], 1, True, dict(active="T6", breaches=0)),
    "nothing to give way to": ([[measure("T6", 0.0, 0.1, breach=True), gone("T5")]] * 6, 1, True, dict(active="T6", flags=[])),
    "T5 not ready yet": ([[measure("T6", 0.0, 0.1, breach=True), gone("T5")]] * 4 + [[measure("T6", 0.0, 0.1, breach=True), measure("T5", 0.1, 0.1)]], 2, True, dict(active="T6")),
    "T0 publishes nothing": ([[measure("T0", 0.0, 1.0)]], 1, False, dict(active="T0", offset_ns=None, sigma_ns=None)),
    "no probes": ([[gone("T4")]], 1, False, dict(active=None, witnesses=[], disagreeing=[], flags=[])),
}


def table(spark):
    rows = [(name, at, *[r.get(c) for c in ("level", "available", "offset", "sigma", "frame", "breach", "grounded")]) for name, (ticks, *_) in CASES.items() for at, results in enumerate(ticks) for r in results]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def decisions(spark):
    """Each case's last tick under its hysteresis and switch, with blocks of two ticks."""
    ticks = authority.ticks(table(spark), ["unit"], "at")
    out = {}
    for hysteresis in {c[1] for c in CASES.values()}:
        picked = authority.picked(ticks, ["unit"], "at", F.floor(F.col("at") / 2), hysteresis).cache()
        for demote in (False, True):
            for r in authority.decided(picked, demote).collect():
                out[r.unit, r["at"], hysteresis, demote] = r
    return out


@pytest.mark.parametrize("name", CASES)
def test_cases(decisions, name):
    ticks, hysteresis, demote, want = CASES[name]
    got = decisions[name, len(ticks) - 1, hysteresis, demote].asDict()
    assert {k: got[k] for k in want} == want


def test_stream_equals_table(spark, tmp_path):
    ticks = authority.ticks(table(spark), ["unit"], "at").cache()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(3):
            ticks.where(F.floor(F.col("at") / 3) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = authority.picked_stream(stream, ["unit"], "at", 2).writeStream.format("memory").queryName("picks").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        key = lambda rows: sorted((r.unit, r["at"], str(r.picked), tuple(r.counted), r.breaches) for r in rows)
        want = authority.picked(ticks, ["unit"], "at", F.floor(F.col("at") / 4), 2)
        assert key(spark.table("picks").collect()) == key(want.collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_transitions(spark):
    rows = spark.createDataFrame([("u", i, a) for i, a in enumerate([None, None, "T3", "T3", "T4", None, "T4"])], "unit string, at long, active string")
    got = authority.transitions(rows, ["unit"], "at", F.floor(F.col("at") / 2)).orderBy("at").collect()
    assert [(r["at"], r.before, r.active) for r in got] == [(2, None, "T3"), (4, "T3", "T4"), (5, "T4", None), (6, None, "T4")]
