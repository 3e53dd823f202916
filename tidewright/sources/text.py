"""Readers of text files and reports, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.timing import unit_microseconds


def key_values(report: Column, entry: str = "\n", between: str = ":") -> Column:
    """A report of ``name : value`` lines as a map of trimmed strings; lines without the mark are left out."""
    lines = F.filter(F.split(report, entry), lambda x: F.instr(x, between) > 0)
    pair = lambda x: F.struct(F.trim(F.substring_index(x, between, 1)).alias("k"), F.trim(F.substring(x, F.instr(x, between) + len(between), F.length(x))).alias("v"))
    return F.map_from_entries(F.array_distinct(F.transform(lines, pair)))


def columns(lines: DataFrame, names: list[str], text: str = "value", comment: str = "#") -> DataFrame:
    """Lines split at white space into named strings; comments, blank and short lines go."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    told = lines.where((F.trim(text) != "") & ~F.ltrim(text).startswith(comment)).withColumn("_p", parts).where(F.size("_p") >= len(names))
    return told.select(*[F.col("_p")[i].alias(n) for i, n in enumerate(names)])


def time_sources(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines of a time daemon's list of sources: mode, state, name, stratum, poll, reach (from octal), last_rx (seconds), offset_us and error_us.

    Heads and lines of another form are left out; a last_rx of ``-`` is null.
    """
    pattern = r"^\s*([#^=])([*+\-x~?])\s+(\S+)\s+(\d+)\s+(\d+)\s+([0-7]+)\s+(\S+)\s+([+-]?[\d.]+(?:ns|us|ms|s))\[[^\]]*\]\s+\+/-\s+([\d.]+(?:ns|us|ms|s))\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    age, factor = part(7), F.when(part(7).endswith("m"), 60).when(part(7).endswith("h"), 3600).when(part(7).endswith("d"), 86400).when(part(7).endswith("y"), 365 * 86400).otherwise(1)
    return lines.where(F.col(text).rlike(pattern)).select(
        part(1).alias("mode"), part(2).alias("state"), part(3).alias("name"), part(4).cast("int").alias("stratum"), part(5).cast("int").alias("poll"), F.conv(part(6), 8, 10).cast("int").alias("reach"),
        (F.regexp_extract(age, r"^(\d+)[mhdy]?$", 1).try_cast("long") * factor).alias("last_rx"), unit_microseconds(part(8)).alias("offset_us"), unit_microseconds(part(9)).alias("error_us"),
    )


def source_statistics(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines of a time daemon's statistics by source: name, samples, frequency_ppm, skew_ppm, offset_us and deviation_us."""
    names = ["name", "samples", "runs", "span", "frequency", "skew", "offset", "deviation"]
    told = columns(lines, names, text).where(F.col("samples").rlike(r"^\d+$"))
    return told.select("name", F.col("samples").cast("int").alias("samples"), F.col("frequency").try_cast("double").alias("frequency_ppm"), F.col("skew").try_cast("double").alias("skew_ppm"), unit_microseconds(F.col("offset")).alias("offset_us"), unit_microseconds(F.col("deviation")).alias("deviation_us"))


#: Fixed value: seconds from 1900 to 1970.
NTP_EPOCH = 2_208_988_800


def leap_seconds(spark: SparkSession, path: str) -> DataFrame:
    """A leap-second list (seconds since 1900 and the offset that holds from then on) as from_s, to_s (Unix time) and offset."""
    rows = columns(spark.read.text(path), ["ntp", "offset"]).select((F.col("ntp").cast("long") - NTP_EPOCH).alias("from_s"), F.col("offset").cast("int").alias("offset"))
    # The list has a few dozen lines.
    return rows.withColumn("to_s", F.lead("from_s").over(Window.orderBy("from_s")))


def offset_at(rows: DataFrame, leaps: DataFrame, seconds: str, otherwise: int = 37) -> DataFrame:
    """``rows`` with the offset that holds at their time; ``otherwise`` before the list."""
    held = F.broadcast(leaps.select("from_s", "to_s", "offset"))
    inside = (F.col(seconds) >= F.col("from_s")) & (F.col("to_s").isNull() | (F.col(seconds) < F.col("to_s")))
    return rows.join(held, inside, "left").withColumn("offset", F.coalesce("offset", F.lit(otherwise))).drop("from_s", "to_s")


def ionex(spark: SparkSession, path: str) -> DataFrame:
    """Maps of an IONEX file as rows: map, epoch, lat, lon, tec (in units of TEC; null for 9999).

    A file is one row of its whole text, as maps depend on the lines before them;
    maps then unfold into rows.
    """
    files = spark.read.text(path, wholetext=True)
    exponent = F.coalesce(F.nullif(F.regexp_extract("value", r"(?m)^\s*(-?\d+)\s+EXPONENT", 1), F.lit("")).cast("int"), F.lit(-1))
    blocks = F.regexp_extract_all("value", F.lit(r"(?s)START OF TEC MAP(.*?)END OF TEC MAP"), F.lit(1))
    maps = files.select(exponent.alias("e"), F.posexplode(blocks).alias("map", "block"))
    stamp = F.regexp_extract("block", r"(?m)^\s*(\d+(?:\s+\d+){5})\s+EPOCH", 1)
    epoch = F.try_to_timestamp(F.regexp_replace(F.trim(stamp), r"\s+", "-"), F.lit("y-M-d-H-m-s"))
    bands = F.regexp_extract_all("block", F.lit(r"(?s)((?:\s*-?\d+\.\d+){5}\s*LAT/LON1/LON2/DLON/H\s*\n(?:[\s\d-]+\n)+)"), F.lit(1))
    rows = maps.select("map", "e", epoch.alias("epoch"), F.explode(bands).alias("band"))
    # Numbers may run into one another where the second has a sign.
    head = F.regexp_extract_all(F.substring_index("band", "LAT/LON1", 1), F.lit(r"(-?\d+\.\d+)"), F.lit(1))
    values = F.regexp_extract_all(F.regexp_extract("band", r"(?s)DLON/H[^\n]*\n(.*)$", 1), F.lit(r"(-?\d+)"), F.lit(1))
    told = rows.select("map", "epoch", "e", head.alias("h"), F.posexplode(values).alias("i", "v"))
    number = F.col("v").cast("int")
    lat, lon = F.col("h")[0].cast("double"), F.col("h")[1].cast("double") + F.col("i") * F.col("h")[3].cast("double")
    return told.select("map", "epoch", lat.alias("lat"), lon.alias("lon"), F.when(number != 9999, number * F.pow(F.lit(10.0), "e")).alias("tec"))


def gridded(rows: DataFrame, grid: DataFrame, lat: str, lon: str, value: str, step_lat: float, step_lon: float) -> DataFrame:
    """``rows`` with the bilinear value of ``grid`` (lat, lon, value on whole steps) at their place; null at its edges.

    The four corners come by equi-joins on whole numbers of steps.
    """
    y, x = F.floor(F.col(lat) / step_lat), F.floor(F.col(lon) / step_lon)
    told = rows.withColumns({"_y": y, "_x": x, "_fy": F.col(lat) / step_lat - y, "_fx": F.col(lon) / step_lon - x})
    nodes = grid.select(F.round(F.col("lat") / step_lat).cast("long").alias("_gy"), F.round(F.col("lon") / step_lon).cast("long").alias("_gx"), F.col(value).alias("_v"))
    total = F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            corner = nodes.select((F.col("_gy") - dy).alias("_y"), (F.col("_gx") - dx).alias("_x"), F.col("_v").alias(f"_v{dy}{dx}"))
            told = told.join(corner, ["_y", "_x"], "left")
            total = total + F.col(f"_v{dy}{dx}") * (F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx"))
    return told.withColumn(value, total).select(*rows.columns, value)
