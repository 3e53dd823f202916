"""Versions that are whole, batches that come again, kills, and merged statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.streaming import upsert

SCHEMA = StructType().add("k", "string").add("at", "long").add("v", "double")
STATS = StructType().add("k", "string").add("n", "long").add("mean", "double").add("spread", "double")


def table(spark, root, schema=SCHEMA):
    return sorted(map(tuple, upsert.read(spark, root, schema).collect()))


def test_batch_that_comes_again_changes_nothing(spark, tmp_path):
    root, merge = f"{tmp_path}/t", upsert.newest(["k"], "at")
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    assert table(spark, root) == []
    assert upsert.apply_batch(batch(("a", 1, 1.0), ("a", 3, 2.0), ("b", 1, 5.0)), 0, root, SCHEMA, merge)
    assert upsert.apply_batch(batch(("a", 2, 9.0), ("b", 4, 6.0), ("c", 0, None)), 1, root, SCHEMA, merge)
    want = [("a", 3, 2.0), ("b", 4, 6.0), ("c", 0, None)]
    assert table(spark, root) == want
    assert not upsert.apply_batch(batch(("a", 99, 99.0)), 1, root, SCHEMA, merge) and not upsert.apply_batch(batch(("a", 99, 99.0)), 0, root, SCHEMA, merge)
    assert table(spark, root) == want and upsert.versions(spark, root) == [0, 1]
    for i in range(2, 6):
        upsert.apply_batch(batch(("d", i, float(i))), i, root, SCHEMA, merge)
    assert upsert.versions(spark, root) == [3, 4, 5] and table(spark, root)[-1] == ("d", 5, 5.0)


def test_killed_batch_leaves_the_old_table(spark, tmp_path):
    root, merge = f"{tmp_path}/t", upsert.newest(["k"], "at")
    upsert.apply_batch(spark.createDataFrame([("a", 1, 1.0)], SCHEMA), 0, root, SCHEMA, merge)

    @F.udf("double")
    def fails(v):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        upsert.apply_batch(spark.createDataFrame([("a", 2, 2.0)], SCHEMA).withColumn("v", fails("v")), 1, root, SCHEMA, merge)
    # What a killed writer has left beside is in nobody's way.
    spark.createDataFrame([("x", 9, 9.0)], SCHEMA).write.mode("overwrite").parquet(f"{root}/_next-1")
    assert table(spark, root) == [("a", 1, 1.0)]
    assert upsert.apply_batch(spark.createDataFrame([("a", 2, 2.0)], SCHEMA), 1, root, SCHEMA, merge) and table(spark, root) == [("a", 2, 2.0)]


def test_stream_merges_statistics(spark, tmp_path):
    values = np.random.default_rng(0).normal(size=300) + 1e6
    rows = spark.createDataFrame([("ab"[i % 2], float(v), i // 100) for i, v in enumerate(values)] + [("a", None, 0), ("a", float("nan"), 1)], "k string, v double, part long")
    for i in range(3):
        rows.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # started again, it has nothing to do
        q = upsert.upserted(stream, f"{tmp_path}/t", STATS, upsert.averaged(["k"], "v")).option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    got = {r.k: r for r in upsert.read(spark, f"{tmp_path}/t", STATS).collect()}
    for key, mine in (("a", values[::2]), ("b", values[1::2])):
        assert got[key].n == 150 and got[key].mean == pytest.approx(mine.mean(), abs=1e-6) and got[key].spread == pytest.approx(mine.std(), rel=1e-6)


def test_mean_follows_a_drift(spark, tmp_path):
    root, merge = f"{tmp_path}/t", upsert.averaged(["k"], "v", most=10)
    for i in range(8):
        upsert.apply_batch(spark.createDataFrame([("a", float(i > 3))] * 10, "k string, v double"), i, root, STATS, merge)
    r = upsert.read(spark, root, STATS).first()
    assert r.n == 20 and r["mean"] == pytest.approx(1 - 0.5**4)
