"""A keyed table that a stream keeps up to date: one new version a batch, whole or not at all, and the same for a batch that comes again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The batches whose versions are whole, oldest first."""
    fs, path = _files(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(root))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def read(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The newest version, or an empty table."""
    found = versions(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def newest(keys: list[str], order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Of a key's old and new rows that with the latest ``order`` stays; of equal ones that with the largest values."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in old.columns if c not in (*keys, order)]
        both = old.unionByName(new.select(*old.columns))
        return both.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*keys, "_r.*").select(*old.columns)

    return merge


def averaged(keys: list[str], value: str, most: int | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Keeps keys, n, mean and spread (root mean square about the mean) of ``value``, merged with those of the new rows.

    With ``most`` the old n counts as that at most, so that the mean follows a slow
    drift. Null and NaN values are left out. Sums of squares are about the means of
    the parts, which keeps their digits.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        known = new.where(F.col(value).isNotNull() & ~F.isnan(value))
        told = known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))
        kept = F.col("n") if most is None else F.least("n", F.lit(most))
        both = old.select(*keys, kept.alias("n"), "mean", "spread").unionByName(told).withColumn("_p", F.struct("n", "mean", "spread"))
        sums = both.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.collect_list("_p").alias("_parts"))
        # Two parts at most: the old and the new.
        squares = F.aggregate("_parts", F.lit(0.0), lambda t, p: t + p["n"] * (p["spread"] * p["spread"] + (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean"))))
        return sums.select(*keys, "n", "mean", F.sqrt(squares / F.col("n")).alias("spread"))

    return merge


def apply_batch(new: DataFrame, batch: int, root: str, schema: StructType, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 3) -> bool:
    """Write version ``batch`` from the one before it and the new rows; False where that batch has been written already.

    The version is written beside and then renamed, which a file system does whole: a
    batch that is killed leaves the table as it was and is written anew when it comes
    again. The last ``keep`` versions stay for those who are reading.
    """
    spark = new.sparkSession
    fs, path = _files(spark, root)
    found = versions(spark, root)
    if found and found[-1] >= batch:
        return False
    beside = f"{root}/_next-{batch}"
    merge(read(spark, root, schema), new).write.mode("overwrite").parquet(beside)
    if not fs.rename(path(beside), path(f"{root}/v{batch}")):
        raise OSError(f"{beside} could not be renamed")
    for old in found[: max(0, len(found) + 1 - keep)]:
        fs.delete(path(f"{root}/v{old}"), True)
    return True


def upserted(stream: DataFrame, root: str, schema: StructType, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 3) -> DataStreamWriter:
    """The writer of a stream whose batches go into the table at ``root``; give it a checkpoint location and start it."""
    return stream.writeStream.foreachBatch(lambda new, batch: apply_batch(new, batch, root, schema, merge, keep) and None)
