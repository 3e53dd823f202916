"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session that has none gets a temporary one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidewright-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir()


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later work has no lineage before this point.

    Unlike ``checkpoint()`` the rows are computed once. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Python tasks of the session get at most ``rows`` texts at a time, as texts are long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or it with as many underscores before it as no column of ``taken`` has; case does not tell columns apart."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else. ``lower`` does the same where no other letters occur, and faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\x09-\\x0D, A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is this very definition.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes over all columns, nulls told apart: equal for repeated rows only."""
    cols = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(i), *cols).alias(f"_h{i}") for i in (1, 2)]


#: Tables of more rows than this are joined by shuffles; fewer rows of some tens of bytes each are broadcast.
MOST_BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, most_rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, with a broadcast hint where its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= most_rows else df
