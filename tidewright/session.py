"""Session settings that the library relies on; everything else is the cluster's own choice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Timestamps in the measurement model are UTC, and AQE re-plans joins from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(app: str = "tidewright", cores: int | str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session it gives you."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g", **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, read by Spark so that any path its file systems know works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the session's executors, once; those that have it installed lose nothing by it."""
    context = spark.sparkContext
    if getattr(context, "_tidewright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    # The driver serves the file to executors for as long as it runs.
    folder = tempfile.mkdtemp(prefix="tidewright-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "tidewright.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tidewright_shipped = True
