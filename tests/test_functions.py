import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions import geometry, quality, timing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_wrapping_counters(spark):
    assert one(spark, timing.counter_delta(F.lit(5), F.lit(2**32 - 5))) == 10
    assert one(spark, timing.counter_delta(F.lit(2**32 - 5), F.lit(5))) == -10
    assert one(spark, timing.sequence_distance(F.lit(65535), F.lit(2))) == 3
    assert one(spark, timing.signed_mod(F.lit(0.7), 1.0)) == pytest.approx(-0.3)
    assert one(spark, timing.sequence_distance(F.lit(2), F.lit(65535))) == -3
    rate, turn = 24_000, (1 << 32) * 1_000_000_000 // 24_000
    assert one(spark, timing.unwrapped_near(F.lit(24_000), F.lit(0), F.lit(0), F.lit(turn + 900_000_000), rate)) == turn + 1_000_000_000


def test_sample_counters_keep_their_nanoseconds(spark):
    rate, anchor_ns, anchor = 24_000, 1_700_000_000_123_456_789, 4_000_000_000
    for samples in (1, 7, 24_001, 2**32 + 5, -3, 5 * 2**32 + 12_345):
        true = anchor_ns + samples * 1_000_000_000 // rate
        got = one(spark, timing.unwrapped_near(F.lit((anchor + samples) % 2**32), F.lit(anchor), F.lit(anchor_ns), F.lit(true + 3_000_000_000), rate))
        assert got == true


def test_names_and_units(spark):
    assert one(spark, timing.channel_mhz(F.lit("SHARED_2 10.5 mhz"))) == 10.5
    assert one(spark, timing.broadcast_key(F.lit("ALL"), F.lit(0.0))) == "ALL" and one(spark, timing.broadcast_key(F.lit("CHU"), F.lit(3.33))) == "CHU_3.33"
    assert one(spark, timing.unit_microseconds(F.lit("-1.5e-2s"))) == -15_000 and one(spark, timing.unit_microseconds(F.lit("10us later"))) is None
    assert one(spark, timing.frequency_khz(F.lit(7.85))) == 7850 and one(spark, timing.frequency_khz(F.lit(7850.0))) == 7850
    assert one(spark, timing.channel_mhz(F.lit("WWV_10_MHz"))) == 10.0 and one(spark, timing.channel_mhz(F.lit("CHU 7850"))) == 7.85
    assert one(spark, timing.channel_mhz(F.lit("none"))) is None
    assert one(spark, timing.unit_microseconds(F.lit("+12.5 ms"))) == 12_500 and one(spark, timing.unit_microseconds(F.lit("?"))) is None
    assert one(spark, timing.minutes_since_2000(F.lit("2000-01-02 00:00:30").cast("timestamp"))) == 1440
    assert one(spark, timing.parsed(F.lit("2024-01-01T00:00:00Z"))) == one(spark, timing.parsed(F.lit("2024-01-01T01:00:00+01:00")))


def test_grades_flags_and_bounds(spark):
    assert [one(spark, quality.uncertainty_grade(F.lit(x))) for x in (0.5, 1.0, 2.5, 3.0)] == ["A", "B", "C", "D"]
    assert one(spark, quality.quality_flag(F.lit("A"), F.lit(0.9), F.lit(False))) == "BAD"
    assert one(spark, quality.quality_flag(F.lit("A"), F.lit(0.6), F.lit(True))) == "MARGINAL"
    assert one(spark, quality.quality_flag(F.lit(None).cast("string"), F.lit(0.6), F.lit(True))) == "MISSING"
    assert one(spark, quality.finite(F.lit(float("nan")))) is None
    assert one(spark, quality.xray_class(F.lit(2.5e-5))) == "M2.5"
    assert one(spark, quality.arrival_uncertainty_ms(F.lit(20.0), F.lit(0.8), F.lit(50.0))) == pytest.approx(1000 / (2 * math.pi * math.sqrt(2 * 100 * 40)))
    assert one(spark, quality.arrival_uncertainty_ms(F.lit(0.0), F.lit(0.0), F.lit(50.0))) == 10.0
    assert one(spark, quality.effective_dof([(F.lit(1.0), F.lit(4.0)), (F.lit(0.0), None)])) == pytest.approx(4.0)
    assert one(spark, quality.effective_dof([(F.lit(1.0), None)])) is None


def test_geometry(spark):
    assert one(spark, geometry.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(6371 * math.pi / 2)
    lat, lon = geometry.midpoint(F.lit(0.0), F.lit(170.0), F.lit(0.0), F.lit(-170.0))
    assert one(spark, lat) == pytest.approx(0, abs=1e-9) and abs(one(spark, lon)) == pytest.approx(180)
    for hops in (1, 2):
        path = geometry.hop_path_km(F.lit(2000.0), F.lit(300.0), F.lit(hops))
        assert one(spark, geometry.height_of_path(path, F.lit(2000.0), F.lit(hops))) == pytest.approx(300)
    assert one(spark, geometry.hops_needed(F.lit(100.0), F.lit(300.0))) == 1
    lat, lon = geometry.grid_latlon(F.lit("EM38ww"))
    assert (round(one(spark, lat), 3), round(one(spark, lon), 3)) == (38.938, -92.125)
    noon = geometry.solar_elevation(F.lit("2024-03-20 12:07:00").cast("timestamp"), F.lit(0.0), F.lit(0.0))
    assert one(spark, noon) > 88
    assert one(spark, geometry.f2_critical_mhz(F.lit(-20.0))) == 3.0 and one(spark, geometry.e_critical_mhz(F.lit(-1.0))) == 0.5
