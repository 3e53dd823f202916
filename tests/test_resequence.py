"""Packets in order: any shuffle within the buffer, batch against stream, restarts, wraps, gaps, late and doubled packets."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import blocks
from tidewright.streaming.resequence import Line, resequenced, resequenced_stream

SCHEMA = "stream string, arrival long, sequence long, timestamp long, payload string"


def packets(draw, n=300, lost=0.1, start=65_400, reach=12):
    """Arrivals (sequence, timestamp, payload) of a session, the first in place, and the packets sent in order; the counters wrap."""
    sent = [((start + i) % 65_536, (4_294_900_000 + 400 * i) % 2**32, f"p{start}.{i}") for i in range(n) if i == 0 or i == n - 1 or draw.random() > lost]
    keyed = sorted(range(1, len(sent) - 1), key=lambda i: i + draw.uniform(0, reach))
    return [sent[0], *[sent[i] for i in keyed], sent[-1]], sent


def run(arrivals, buffer=64, ended=True):
    line, out = Line(), []
    for s, t, p in arrivals:
        out += line.push(s, t, p, 400, buffer, 200_000)
    return out + (line.drained(400, 200_000) if ended else []), line


@pytest.mark.parametrize("seed", range(8))
def test_any_shuffle_within_the_buffer_gives_the_sorted_stream(seed):
    draw = random.Random(seed)
    arrivals, sent = packets(draw)
    out, _ = run(arrivals)
    assert [(o[2], o[3], o[6]) for o in out] == sent
    missing = [int(b[2].split(".")[1]) - int(a[2].split(".")[1]) - 1 for a, b in zip(sent, sent[1:])]
    assert [o[4] for o in out] == [0, *missing] and [o[5] for o in out] == [0, *[400 * m for m in missing]]


def test_state_is_bounded_and_late_and_doubled_packets_go():
    line, most = Line(), 0
    draw = random.Random(1)
    arrivals, _ = packets(draw, n=3_000, lost=0.4, reach=500)
    for s, t, p in arrivals:
        line.push(s, t, p, 400, 16, 10**9)
        most = max(most, len(line.held))
    assert most < 8
    out, _ = run([(5, 0, "a"), (5, 0, "again"), (7, 800, "c"), (7, 800, "again"), (4, 2**32 - 400, "late"), (6, 400, "b"), (6, 400, "late")])
    assert [o[6] for o in out] == ["a", "b", "c"] and [o[4] for o in out] == [0, 0, 0]


def test_restart_hands_on_what_is_held():
    out, line = run([(1, 0, "a"), (3, 800, "c"), (900, 50_000_000, "x"), (901, 50_000_400, "y")])
    assert [(o[0], o[1], o[4], o[6]) for o in out] == [(0, 0, 0, "a"), (0, 2, 1, "c"), (1, 0, 0, "x"), (1, 1, 0, "y")] and line.session == 1
    # Time that moves back by less than the bound fills nothing; a gap is at most the bound.
    assert [o[5] for o in run([(1, 10_000, "a"), (2, 9_000, "b"), (3, 209_000, "c")])[0]] == [0, 0, 199_600]


@pytest.fixture
def table(spark):
    rows, draw = [], random.Random(4)
    for k, name in enumerate("ab"):
        arrivals, _ = packets(draw, n=200, start=65_450 + k)
        again, _ = packets(draw, n=150, start=100)
        again = [(s, (t + 10**9) % 2**32, p + "'") for s, t, p in again]
        arrivals = [*arrivals, *again, again[-1]]
        rows += [(name, i, *x) for i, x in enumerate(arrivals)]
    return spark.createDataFrame(rows, SCHEMA)


KEYS = ["stream", "session", "place", "sequence", "timestamp", "gap_packets", "gap_samples", "payload"]


def by_hand(table, ended=True):
    out = []
    rows = sorted(table.collect(), key=lambda r: r.arrival)
    for name in "ab":
        out += [(name, *x) for x in run([(r.sequence, r.timestamp, r.payload) for r in rows if r.stream == name], ended=ended)[0]]
    return sorted(out)


@pytest.mark.parametrize("block, places", [(1, 1), (37, 50), (10**6, 65_536)])
def test_table_equals_line(table, block, places):
    got = resequenced(table, ["stream"], ["arrival"], F.floor(F.col("arrival") / block), "sequence", "timestamp", places=places)
    assert sorted(map(tuple, got.select(*KEYS).collect())) == by_hand(table)
    assert resequenced(table.limit(0), ["stream"], ["arrival"], F.lit(0), "sequence", "timestamp").count() == 0


def test_stream_equals_line(spark, table, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(4):
            table.where(F.floor(F.col("arrival") / 100) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = resequenced_stream(stream, ["stream"], "arrival", "sequence", "timestamp", "payload", patience_ms=None)
        q = out.writeStream.format("memory").queryName("packets").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert sorted(map(tuple, spark.table("packets").select(*KEYS).collect())) == by_hand(table, ended=False)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_blocks_equal_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 199).alias("at"), (F.col("id") % 5).alias("v"))
    w = Window.partitionBy("k").orderBy("at")
    want = rows.select("k", "at", F.lag("v").over(w).alias("p"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"))
    for size in (1, 13, 1000):
        block = F.floor(F.col("at") / size)
        got = blocks.with_running(blocks.with_previous(rows, ["k"], ["at"], block, ["v"], "p"), ["k"], ["at"], block, F.col("v"), "t")
        assert sorted(map(tuple, got.select("k", "at", F.col("p.v"), "t").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
