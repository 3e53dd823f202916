import pytest
from pyspark.sql import functions as F

from tidewright import catalog

PRODUCT = catalog.Product("clock", (
    catalog.Field("ts", "timestamp", required=True), catalog.Field("station", "string", allowed=("WWV", "CHU")),
    catalog.Field("value", "float", low=-10, high=10, allow_nan=False), catalog.Field("n", "integer"), catalog.Field("ok", "boolean"),
))


def rows(spark, *given):
    return spark.createDataFrame(list(given), "channel string, ts string, station string, value double, n string, ok int, extra string")


def test_rules(spark):
    df = rows(spark, ("a", "2024-01-01", "WWV", 10.0, "1", 1, "x"), ("a", None, "BBC", 11.0, "x", 0, None), ("a", "2024-01-01", None, float("nan"), None, None, None), ("a", "2024-01-01", None, -10.0, None, None, None))
    told = [sorted(r.problems) for r in PRODUCT.judged(df).collect()]
    assert told == [[], ["station is not allowed", "ts is missing", "value is too high"], ["value is NaN"], []]
    good, bad = PRODUCT.accepted(df)
    assert good.count() == 2 and bad.count() == 2 and "extra" not in good.columns
    assert good.first().n == 1 and good.first().ok is True


def test_append_read_and_evolution(spark, tmp_path):
    root = str(tmp_path)
    assert PRODUCT.read(spark, root).count() == 0
    PRODUCT.append(rows(spark, ("a", "2024-01-01T10:00:00Z", "WWV", 1.0, "1", 1, None)), root)
    with pytest.raises(ValueError):
        PRODUCT.append(rows(spark, ("a", "2024-01-01", "WWV", 1.0, "1", 1, None), ("a", None, "WWV", 1.0, "1", 1, None)), root)
    assert PRODUCT.read(spark, root).count() == 1
    newer = catalog.Product("clock", (*PRODUCT.fields, catalog.Field("added", "float")))
    newer.append(rows(spark, ("b", "2024-01-02T10:00:00Z", "CHU", 2.0, "2", 0, None)).withColumn("added", F.lit(0.5)), root)
    got = {r.channel: r.added for r in newer.read(spark, root).collect()}
    assert got == {"a": None, "b": 0.5}
    assert {r.channel for r in newer.latest(newer.read(spark, root)).collect()} == {"a", "b"}


def test_scan_defaults_for_missing_values(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "A", "GOOD", 0.9), ("2024-01-02 00:00:00", None, None, None), ("2024-01-03 00:00:00", "C", "MARGINAL", 0.5)], "ts string, grade string, flag string, confidence double").withColumn("ts", F.col("ts").cast("timestamp"))
    n = lambda **k: catalog.scan(df, "2024-01-01", "2024-01-03", **k).count()
    assert n() == 3 and n(grade="D") == 3 and n(grade="C") == 2 and n(flags=["BAD"]) == 1 and n(confidence=0.0) == 3 and n(confidence=0.6) == 1
    assert catalog.scan(df, "2024-01-02", "2024-01-02").count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.timestamp_seconds("id").alias("ts"), F.col("id").alias("a"), F.col("id").alias("b")).write.parquet(f"{tmp_path}/t")
    plan = catalog.scan(spark.read.parquet(f"{tmp_path}/t"), "1970-01-01", "1970-01-01 00:00:05").select("ts", "a")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp,a:bigint>" in plan
