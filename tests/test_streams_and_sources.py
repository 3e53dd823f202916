import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import kernels
from tidewright.sources import samples, sinks, text
from tidewright.streaming import state, windows


def measured(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [(k, float(60 * i), float(0.01 * i * (k + 1) + rng.normal() * 0.2 + (50 if i == 40 else 0)), 20.0) for k in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "channel long, at double, measured double, snr double")


def test_tracks_lock_and_reject(spark):
    rows = state.tracks(measured(spark), ["channel"]).where("channel = 1").orderBy("at").collect()
    assert rows[-1].state == "LOCKED" and rows[40].status == "MODE_CHANGE"
    assert abs(rows[-1].offset - 0.02 * 59) < 0.3 and rows[-1].sigma < rows[0].sigma


def test_stream_equals_table(spark, tmp_path):
    df = measured(spark)
    for i in range(3):
        df.where((F.col("at") >= i * 1200) & (F.col("at") < (i + 1) * 1200)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = state.track_stream(stream, ["channel"]).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda rows: sorted((r.channel, r["at"], round(r.offset, 9), r.status, r.state) for r in rows)
    assert key(spark.table("tracks").collect()) == key(state.tracks(df, ["channel"]).collect())


def test_windowed_stream(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds("id").alias("ts"), (F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.windowed(windows.once(stream, "ts", ["v"]), "ts", ["g"], "v").writeStream.format("memory").queryName("w").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("w").columns == ["start", "g", "n", "mean", "low", "high", "spread"]
    batch = windows.windowed(df, "ts", ["g"], "v")
    assert batch.where("g = 0").agg(F.sum("n")).first()[0] == 50


def test_kernels(spark):
    t = np.arange(2000)
    x = np.cos(2 * np.pi * 0.05 * t)
    template = np.sin(np.arange(40) * 0.9) * np.hanning(40)
    y = np.zeros(500)
    y[100:140] += template
    y[130:170] += 0.4 * template
    y += np.random.default_rng(0).normal(size=500) * 0.01
    df = spark.createDataFrame([(x.tolist(), y.tolist()), (None, [])], "x array<double>, y array<double>")
    r = df.select(kernels.tone_power("x", 0.05).alias("p"), kernels.decimated("x", 4).alias("d"), kernels.match("y", template).alias("m"), kernels.multipath("y", template).alias("c"), kernels.power("x").alias("q")).collect()
    assert r[0].p == pytest.approx(0.25, abs=0.01) and len(r[0].d) == 500 and abs(np.array(r[0].d)[100:400]).max() == pytest.approx(1, abs=0.05)
    assert abs(r[0].m.lag - 100) < 0.5 and r[0].m.snr_db > 20
    strong = sorted(r[0].c, key=lambda a: -abs(a.amplitude))[:2]
    assert {a.lag for a in strong} == {100, 130} and r[0].q == pytest.approx(0.5, abs=0.01)
    assert r[1].p is None and r[1].m.lag is None and r[1].c is None
    both = spark.createDataFrame([(x[:300].tolist(), np.roll(x[:300] + t[:300] * 0.01, 7).tolist())], "a array<double>, b array<double>")
    assert both.select(kernels.best_lag("a", "b", 9).alias("r")).first().r.lag == 7
    assert spark.createDataFrame([([0.0, 1.0, 3.0], [0.0, 2.0, 2.0])], "x array<double>, y array<double>").select(kernels.integral(F.col("x"), F.col("y")).alias("i")).first().i == 5.0


def test_text_sources(spark, tmp_path):
    report = "Reference ID    : C0A80101 (gps)\nSystem time     : 0.000001 seconds slow\njunk"
    got = spark.createDataFrame([(report,)], "t string").select(text.key_values(F.col("t")).alias("m")).first().m
    assert got == {"Reference ID": "C0A80101 (gps)", "System time": "0.000001 seconds slow"}
    (tmp_path / "leap").write_text("# comment\n2272060800 10 # 1 Jan 1972\n3692217600 37 # 1 Jan 2017\n")
    leaps = text.leap_seconds(spark, f"file://{tmp_path}/leap")
    rows = spark.createDataFrame([(0.0,), (63072000.0,), (1.7e9,)], "s double")
    assert [r.offset for r in text.offset_at(rows, leaps, "s", otherwise=9).orderBy("s").collect()] == [9, 10, 37]
    ionex = "     -1                                                     EXPONENT\n     1                                                      START OF TEC MAP\n  2024     1     1     2     0     0                        EPOCH OF CURRENT MAP\n    87.5-180.0 180.0 180.0 450.0                            LAT/LON1/LON2/DLON/H\n   10   20 9999\n    85.0-180.0 180.0 180.0 450.0                            LAT/LON1/LON2/DLON/H\n   30   40   50\n     1                                                      END OF TEC MAP\n"
    (tmp_path / "map.24i").write_text(ionex)
    got = {(r.lat, r.lon): r.tec for r in text.ionex(spark, f"file://{tmp_path}/map.24i").collect()}
    assert got == {(87.5, -180.0): 1.0, (87.5, 0.0): 2.0, (87.5, 180.0): None, (85.0, -180.0): 3.0, (85.0, 0.0): 4.0, (85.0, 180.0): 5.0}
    grid = spark.createDataFrame([(y, x, 10.0 * y + x) for y in (0.0, 2.5) for x in (0.0, 5.0)], "lat double, lon double, tec double")
    at = spark.createDataFrame([(1.0, 2.0), (9.0, 9.0)], "la double, lo double")
    assert [r.tec for r in text.gridded(at, grid, "la", "lo", "tec", 2.5, 5.0).orderBy("la").collect()] == [pytest.approx(12.0), None]


def test_samples_and_sinks(spark, tmp_path):
    import zstandard

    (tmp_path / "chan").mkdir()
    x = np.arange(20, dtype="<f4")
    (tmp_path / "chan" / "120.bin").write_bytes(x.tobytes())
    (tmp_path / "chan" / "240.bin.zst").write_bytes(zstandard.compress(x.tobytes()))
    rows = samples.read_samples(spark, f"file://{tmp_path}/chan", rate=1, chunk_seconds=60)
    assert {(r.channel, r["at"], tuple(r.i[:2]), tuple(r.q[:2])) for r in rows.collect()} == {("chan", 120, (0.0, 2.0), (1.0, 3.0)), ("chan", 240, (0.0, 2.0), (1.0, 3.0))}
    spine = samples.spined_minutes(rows, 120, 300, 10).orderBy("at").collect()
    assert [(r["at"], r.complete, len(r.i)) for r in spine] == [(120, 1.0, 10), (180, 0.0, 10), (240, 1.0, 10)]
    sinks.gap_report(samples.spined_minutes(rows, 120, 300, 10), f"{tmp_path}/gaps")
    assert spark.read.json(f"{tmp_path}/gaps").first().missing == 1
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", ["a"])], "k int, ts string, l array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.daily_csv(events.drop("l"), f"{tmp_path}/csv", "ts")
    sinks.ledger(events, f"{tmp_path}/json", "ts")
    sinks.snapshot(events, f"{tmp_path}/snap", ["l"], ["k", "l", "unknown"])
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 1 and spark.read.json(f"{tmp_path}/json").first().l == ["a"]
    assert spark.read.parquet(f"{tmp_path}/snap").first().asDict() == {"k": 1, "l": '["a"]'}
