"""Minutes of complex samples in binary files, as rows with arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_samples(spark: SparkSession, path: str, rate: int, chunk_seconds: int = 60) -> DataFrame:
    """Files of interleaved 32-bit floats, named after the Unix time they start at, as channel, at, i and q, a row for each chunk.

    The channel is the folder's name. Files may end in .bin or .bin.zst; a last part
    that does not fill a chunk is a shorter row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bin*").load(path).select("path", "content")
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("channel"), F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long").alias("start"), F.col("path").endswith(".zst").alias("packed"), "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for channel, start, packed, content in b.itertuples(index=False):
                if packed:
                    import zstandard

                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                x = np.frombuffer(content[: len(content) // 8 * 8], dtype="<f4").reshape(-1, 2)
                for n in range(0, len(x), rate * chunk_seconds):
                    part = x[n : n + rate * chunk_seconds]
                    yield pd.DataFrame({"channel": [channel], "at": [start + n // rate], "i": [part[:, 0]], "q": [part[:, 1]]})

    return named.mapInPandas(unpack, "channel string, at long, i array<float>, q array<float>")


def spined_minutes(rows: DataFrame, start: int, end: int, samples: int) -> DataFrame:
    """A row for each channel and minute from ``start`` to ``end`` (exclusive, Unix time); absent ones hold zeros and complete = 0."""
    spine = rows.select("channel").distinct().withColumn("at", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end - 60).cast("long"), F.lit(60).cast("long"))))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), samples)
    held = spine.join(rows, ["channel", "at"], "left")
    complete = F.least(F.lit(1.0), F.coalesce(F.size("i"), F.lit(0)) / F.lit(float(samples)))
    return held.select("channel", "at", F.coalesce("i", zeros).alias("i"), F.coalesce("q", zeros).alias("q"), F.when(F.col("i").isNull(), 0.0).otherwise(complete).alias("complete"))
