"""Writers of reports and daily files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_csv(rows: DataFrame, path: str, at: str) -> None:
    """Rows appended as CSV with a header, a folder for each day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").csv(path, header=True)


def ledger(rows: DataFrame, path: str, at: str) -> None:
    """Rows appended as JSON lines, a folder for each day."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(path)


def snapshot(rows: DataFrame, path: str, lists: list[str], columns: list[str]) -> None:
    """The known columns appended to Parquet, lists as JSON text."""
    kept = [c for c in columns if c in rows.columns]
    rows.select(*[F.to_json(c).alias(c) if c in lists else F.col(c) for c in kept]).write.mode("append").parquet(path)


def gap_report(minutes: DataFrame, path: str) -> None:
    """Per channel and day, minutes there, minutes missing and mean completeness (``complete`` of ``spined_minutes``), as JSON."""
    day = F.to_date(F.timestamp_seconds("at")).alias("day")
    report = minutes.groupBy("channel", day).agg(F.count(F.when(F.col("complete") > 0, 1)).alias("present"), F.count(F.when(F.col("complete") == 0, 1)).alias("missing"), F.avg("complete").alias("completeness"))
    report.write.mode("overwrite").json(path)


def ionex_files(grid: DataFrame, path: str, name: str, epoch: str, lat: str = "lat", lon: str = "lon", value: str = "value", height_km: float = 350.0, program: str = "tidewright", interval: int = 3600) -> None:
    """IONEX files, a folder ``name=...`` for each map: values in tenths, cut off, and 9999 for none.

    A map's bands and then its text are put together where its rows meet; a map is a
    grid of some thousand cells at most by nature. ``epoch`` is the map's time (UTC).
    Bands go by rising latitude, values by rising longitude, sixteen a line; a grid's
    steps are those between its first two values, 1 for a single one.
    """
    line = lambda text, label: F.concat(F.rpad(text, 60, " "), F.lit(label))
    number = F.coalesce(F.when(~F.isnan(value), (F.col(value) * 10).cast("int")), F.lit(9999))
    rows = F.sort_array(F.collect_list(F.struct(F.col(lon).alias("lon"), number.alias("v"))))
    bands = grid.groupBy(name, epoch, F.col(lat).alias("_lat")).agg(rows.alias("_r"))
    values = F.array_join(F.transform(F.sequence(F.lit(1), F.size("_r"), F.lit(16)), lambda i: F.array_join(F.transform(F.slice("_r", i, 16), lambda r: F.lpad(r["v"].cast("string"), 5, " ")), "")), "\n")
    step = lambda c, at: F.coalesce(F.get(c, F.lit(1))[at] - c[0][at], F.lit(1.0))
    first, last = F.col("_r")[0]["lon"], F.element_at("_r", -1)["lon"]
    bands = bands.withColumns({"_o": F.struct(first.alias("a"), last.alias("z"), step(F.col("_r"), "lon").alias("d")), "_values": values})
    head = line(F.format_string("  %6.1f%6.1f%6.1f%6.1f%6.1f", F.col("_lat"), first, last, F.col("_o")["d"], F.lit(height_km)), "LAT/LON1/LON2/DLON/H")
    bands = bands.withColumn("_text", F.concat(head, F.lit("\n"), F.col("_values")))
    maps = bands.groupBy(name, epoch).agg(F.sort_array(F.collect_list(F.struct(F.col("_lat").alias("lat"), "_o", "_text"))).alias("_b"))
    at = F.format_string("%6d%6d%6d%6d%6d%6d", *[f(epoch).cast("int") for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)])
    b = F.col("_b")
    lons = b[0]["_o"]
    lines = [
        line(F.format_string("%8.1f            %-20s%-20s", F.lit(1.0), F.lit("IONOSPHERE MAPS"), F.lit("REGIONAL")), "IONEX VERSION / TYPE"), line(F.format_string("%-20s%-20s%-20s", F.lit(program), F.lit(""), F.date_format(epoch, "yyyyMMdd HHmmss")), "PGM / RUN BY / DATE"),
        line(at, "EPOCH OF FIRST MAP"), line(at, "EPOCH OF LAST MAP"), line(F.format_string("%6d", F.lit(interval)), "INTERVAL"), line(F.format_string("%6d", F.lit(1)), "# OF MAPS IN FILE"),
        line(F.lit("  NONE"), "MAPPING FUNCTION"), line(F.format_string("%8.1f", F.lit(6371.0)), "BASE RADIUS"), line(F.format_string("%6d", F.lit(2)), "MAP DIMENSION"),
        line(F.format_string("  %6.1f%6.1f%6.1f", F.lit(height_km), F.lit(height_km), F.lit(0.0)), "HGT1 / HGT2 / DHGT"), line(F.format_string("  %6.1f%6.1f%6.1f", b[0]["lat"], F.element_at(b, -1)["lat"], step(b, "lat")), "LAT1 / LAT2 / DLAT"),
        line(F.format_string("  %6.1f%6.1f%6.1f", lons["a"], lons["z"], lons["d"]), "LON1 / LON2 / DLON"), line(F.format_string("%6d", F.lit(-1)), "EXPONENT"), line(F.lit(""), "END OF HEADER"),
        line(F.format_string("%6d", F.lit(1)), "START OF TEC MAP"), line(at, "EPOCH OF CURRENT MAP"), F.array_join(F.transform(b, lambda x: x["_text"]), "\n"), line(F.format_string("%6d", F.lit(1)), "END OF TEC MAP"), line(F.lit(""), "END OF FILE"),
    ]
    maps.select(name, F.concat_ws("\n", *lines).alias("value")).write.mode("overwrite").partitionBy(name).text(path)
