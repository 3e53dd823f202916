"""Time frames bit by bit, and Student's t against sums that end."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import student, timecode

WORD = 6_578_970


def bits_of(spark, **more):
    return spark.range(1).select(timecode.encoded_frame(F.lit(timecode.EPOCH_S + WORD * 60 + 59), **{k: F.lit(v) for k, v in more.items()}).alias("f")).first().f


def test_every_single_error_is_mended(spark):
    frame = bits_of(spark, saving=3, leap=2, next_code=37, notice=1)
    assert len(frame) == 60 and frame.startswith(timecode.SYNC)
    flipped = [(i, frame[:i] + str(1 - int(frame[i])) + frame[i + 1 :]) for i in range(60)] + [(-1, frame), (-2, frame[:-1]), (-3, None), (-4, "2" + frame[1:])]
    got = {r.i: r.t for r in spark.createDataFrame(flipped, "i int, f string").select("i", timecode.time_frame(F.col("f")).alias("t")).collect()}
    counter = [13, 14, 15, 16, 17, 18, *range(20, 29), *range(30, 39), *range(40, 47)]
    minute = got[-1].minute
    assert (got[-1].saving, got[-1].leap, got[-1].next_code, got[-1].notice, got[-1].sync_errors, got[-1].parity_errors, got[-1].lsb_differs) == (3, 2, 37, 1, 0, 0, False)
    for i in range(60):
        assert got[i].minute == minute and got[i].parity_errors == (i in counter) and got[i].sync_errors == (i < 13) and got[i].lsb_differs == (i == 19)
    assert got[-2] is None and got[-3] is None and got[-4] is None
    assert spark.createDataFrame([(minute,)], "m timestamp").select(F.unix_timestamp("m")).first()[0] == timecode.EPOCH_S + WORD * 60


def test_a_frame_is_worked_out_once(spark):
    frame = bits_of(spark, saving=1, next_code=5)
    df = spark.createDataFrame([(frame[::-1],), ("1" * 80,), (None,), ("",)], "f string").select(timecode.time_frame(F.reverse("f")).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    got = [r.t for r in df.collect()]
    assert (got[0].saving, got[0].next_code, got[0].parity_errors) == (1, 5, 0) and got[1:] == [None, None, None]


def test_double_errors_look_like_one_elsewhere(spark):
    rows = [(WORD ^ (1 << i) ^ (1 << j),) for i in range(26) for j in range(i)]
    sent = sum((bin(WORD & sum(1 << t for t in taps)).count("1") % 2) << k for k, taps in enumerate(timecode.PARITY_TAPS))
    word, errors = timecode.corrected(F.col("w"), F.lit(sent).cast("long"))
    got = spark.createDataFrame(rows, "w long").select(word.alias("w"), errors.alias("e")).collect()
    assert len(got) == 325 and all(r.w != WORD and r.e == 1 for r in got)


def test_codes_and_bounds(spark):
    rows = [(s, x) for s in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "s int, x int").select("s", "x", timecode.encoded_frame(F.lit(10**9), F.col("s"), F.col("x")).alias("f"))
    got = {(r.s, r.x): r.t for r in df.select("s", "x", timecode.time_frame(F.col("f")).alias("t")).collect()}
    assert all((t is None) == (x == 1) and (t is None or (t.saving, t.leap) == (s, x)) for (s, x), t in got.items())
    assert spark.range(1).select(timecode.encoded_frame(F.lit(10**8))).first()[0] is None


def p_by_sums(t, n):
    """For whole degrees of freedom the tail is a finite sum."""
    angle = math.atan(t / math.sqrt(n))
    c, s = math.cos(angle), math.sin(angle)
    term, total = 1.0, 0.0
    if n % 2:
        term = c
        for k in range(1, (n - 1) // 2 + 1):
            total += term
            term *= c * c * (2 * k) / (2 * k + 1)
        return 1 - 2 / math.pi * (angle + s * total)
    for k in range(n // 2):
        total += term
        term *= c * c * (2 * k + 1) / (2 * k + 2)
    return 1 - s * total


def test_two_sided_p(spark):
    rows = [(t, n) for n in (1, 2, 3, 4, 7, 10, 31, 200) for t in (0.0, 0.1, 0.5, 1.0, 2.0, 3.5, 6.0)]
    got = spark.createDataFrame([(t, float(n), n) for t, n in rows], "t double, d double, n int").select("t", "n", student.two_sided_p(F.col("t"), F.col("d")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(p_by_sums(r.t, r.n), rel=1e-6, abs=1e-13)
    assert spark.range(1).select(student.two_sided_p(F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_correlation_p(spark):
    rows = [(0.5, 2.0, 1), (0.5, 12.0, 1), (-0.5, 12.0, 3), (1.0, 30.0, 1), (0.1, 5.0, 100), (None, 9.0, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "r double, n double, k int").select(student.correlation_p(F.col("r"), F.col("n"), F.col("k"))).collect()]
    single = p_by_sums(0.5 * math.sqrt(10 / 0.75), 10)
    assert got[0] == 1.0 and got[1] == pytest.approx(single, rel=1e-9) and got[2] == pytest.approx(3 * single, rel=1e-9) and got[3] < 1e-30 and got[4] == 1.0 and got[5] is None


def test_coverage_95(spark):
    draw = random.Random(0)
    rows = [(d,) for d in (1.0, 2.0, 3.0, 5.0, 10.0, 30.0, 120.0, *(draw.uniform(1, 60) for _ in range(5)))]
    got = spark.createDataFrame(rows, "d double").withColumn("k", student.coverage_95(F.col("d"))).withColumn("p", student.two_sided_p(F.col("k"), F.col("d"))).collect()
    assert all(r.p == pytest.approx(0.05, abs=1e-9) for r in got)
    known = {1.0: 12.7062, 2.0: 4.3027, 5.0: 2.5706, 10.0: 2.2281, 30.0: 2.0423}
    assert all(abs(r.k - known[r.d]) < 1e-4 for r in got if r.d in known)
    odd = spark.createDataFrame([(0.0,), (-1.0,), (float("inf"),), (float("nan"),), (None,)], "d double").select(student.coverage_95(F.col("d"))).collect()
    assert all(r[0] == student.Z_975 for r in odd)
