"""Measurement tables: declared fields, validation, scans and forward-only evolution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from tidewright.functions.quality import grade_rank

#: Names of declared types.
TYPES: dict[str, DataType] = {"float": DoubleType(), "integer": LongType(), "string": StringType(), "boolean": BooleanType(), "timestamp": TimestampType(), "array": ArrayType(DoubleType()), "composite": StringType()}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    allow_nan: bool = True

    def problems(self) -> list[tuple[Column, str]]:
        """Conditions under which a row fails, and what to call them."""
        c, out = F.col(f"`{self.name}`"), []
        if self.required:
            out.append((c.isNull(), f"{self.name} is missing"))
        if self.allowed:
            out.append((c.isNotNull() & ~c.isin(*self.allowed), f"{self.name} is not allowed"))
        nan = F.isnan(c) if self.kind == "float" else F.lit(False)
        if self.low is not None:
            out.append((~nan & (c < self.low), f"{self.name} is too low"))
        if self.high is not None:
            out.append((~nan & (c > self.high), f"{self.name} is too high"))
        if not self.allow_nan and self.kind == "float":
            out.append((nan, f"{self.name} is NaN"))
        return out


@dataclass(frozen=True)
class Product:
    """A declared table. Rows lie in Parquet by channel and day; there is no primary key, as several rows may share a time stamp."""

    name: str
    fields: tuple[Field, ...]
    at: str = "ts"
    channel: str = "channel"

    def schema(self) -> StructType:
        return StructType([StructField(self.channel, StringType()), *[StructField(f.name, TYPES[f.kind]) for f in self.fields]])

    def conformed(self, rows: DataFrame) -> DataFrame:
        """``rows`` cast to the schema: unknown columns go, absent ones are null. Values that a type cannot hold become null."""
        have = set(rows.columns)
        cast = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        return rows.select(*[cast(f).alias(f.name) for f in self.schema().fields])

    def judged(self, rows: DataFrame) -> DataFrame:
        """The conformed rows with ``problems``: the names of all rules that each one breaks."""
        rules = [F.when(bad, F.lit(name)) for f in self.fields for bad, name in f.problems()]
        found = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
        return self.conformed(rows).withColumn("problems", found)

    def accepted(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that break no rule, and the others with their problems."""
        told = self.judged(rows)
        return told.where(F.size("problems") == 0).drop("problems"), told.where(F.size("problems") > 0)

    def path(self, root: str) -> str:
        return f"{root}/{self.name}"

    def append(self, rows: DataFrame, root: str, strict: bool = True) -> None:
        """Add rows. With ``strict`` one row that breaks a rule refuses them all; else such rows are left out."""
        good, bad = self.accepted(rows)
        if strict and not bad.isEmpty():
            raise ValueError(f"{self.name}: {bad.select(F.explode('problems')).distinct().limit(5).collect()}")
        day = F.to_date(self.at)
        good.withColumn("day", day).write.mode("append").partitionBy(self.channel, "day").parquet(self.path(root))

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        """All rows, with the fields of today; an empty table where none has been written."""
        try:
            found = spark.read.option("mergeSchema", "true").parquet(self.path(root))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return spark.createDataFrame([], self.schema())
            raise
        return self.conformed(found)

    def latest(self, rows: DataFrame) -> DataFrame:
        """The newest time of each channel."""
        return rows.groupBy(self.channel).agg(F.max(self.at).alias("latest"))


def scan(rows: DataFrame, start: str, end: str, at: str = "ts", grade: str | None = None, flags: Sequence[str] = (), confidence: float | None = None, station: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included, of a grade or better, a flag, a confidence or more, and a station.

    A missing grade counts as D, a missing flag as BAD and a missing confidence as 0.
    ``columns`` names the columns where they are called otherwise. Comparisons of
    the bare time column reach the Parquet scan.
    """
    name = {"grade": "grade", "flag": "flag", "confidence": "confidence", "station": "station"} | (columns or {})
    tests = [F.col(at) >= F.lit(start).cast("timestamp"), F.col(at) <= F.lit(end).cast("timestamp")]
    if grade is not None:
        tests.append(grade_rank(F.coalesce(F.col(name["grade"]), F.lit("D"))) <= grade_rank(F.lit(grade)))
    if flags:
        tests.append(F.coalesce(F.col(name["flag"]), F.lit("BAD")).isin(*flags))
    if confidence is not None:
        tests.append(F.coalesce(F.col(name["confidence"]), F.lit(0.0)) >= confidence)
    if station is not None:
        tests.append(F.col(name["station"]) == station)
    return rows.where(reduce(lambda a, b: a & b, tests))


def evicted(days: DataFrame, day: str, size: str, keep_bytes: int) -> DataFrame:
    """The oldest days whose removal leaves at most ``keep_bytes``: retention by a running sum from the newest day. Days are few."""
    from pyspark.sql import Window

    held = F.sum(size).over(Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("held", held).where(F.col("held") > keep_bytes)
