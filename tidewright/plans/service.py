"""What a service over the measurement stream answers: conditions, histories, states and validation, each with its SQL.

"Now" is the time of the newest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import geometry, quality, timing
from tidewright.operators import aggregates, joins, reports, series
from tidewright.plans.measurements import _UNWRAP, ORDER, _phases, measurements, query, r

HOUR, DAY = 3600.0, 86400.0
_NOW = "(SELECT max(s) FROM m)"


def _text(at: Column | str, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(at, form)


@query(f"""v AS (SELECT * FROM m WHERE s > {_NOW} - 86400), c AS (SELECT station, mode, count(*) AS n, min((ts, event_id)) AS f, sum(snr) AS q, max(mhz) FILTER (snr >= 15) AS top, count(*) FILTER (snr >= 15) AS strong FROM v GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY n DESC, f) AS place, sum(n) OVER (PARTITION BY station) AS total, sum(q) OVER (PARTITION BY station) AS sq FROM c)
SELECT station, CAST(total AS BIGINT) AS n, mode AS dominant, round(n / total, 6) AS share, round(sq / total, 6) AS mean_snr, round(CASE WHEN regexp_matches(mode, '^[0-9]+F') AND strong >= 3 THEN top * 1.15 END, 6) AS usable FROM d WHERE place = 1""")
def current_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.recent(measurements(spark, sf_dir), "ts", DAY)
    out = reports.conditions(rows, ["station"], "mode", "snr", "mhz", ORDER)
    return out.withColumns({c: r(F.col(c)) for c in ("share", "mean_snr", "usable")})


@query("""g AS (SELECT date_trunc('hour', ts) AS h, station, max(mhz) FILTER (snr >= 15 AND mode IN ('1F', '2F')) * 1.15 AS muf FROM m GROUP BY 1, 2)
SELECT strftime(h, '%Y-%m-%d') AS day, round(max(muf) FILTER (muf > 0), 6) AS muf, count(DISTINCT station) AS stations FROM g GROUP BY 1""")
def daily_usable_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest positive usable frequency of each day, from those of its hours and stations."""
    good = (F.col("snr") >= 15) & F.col("mode").isin("1F", "2F")
    hours = measurements(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("h"), "station").agg((F.max(F.when(good, F.col("mhz"))) * 1.15).alias("muf"))
    return hours.groupBy(_text("h", "yyyy-MM-dd").alias("day")).agg(r(F.max(F.when(F.col("muf") > 0, F.col("muf")))).alias("muf"), F.countDistinct("station").alias("stations"))


_HOURLY = """a AS (SELECT date_trunc('hour', ts) AS h, station, stddev_pop(value) / nullif(avg(value), 0) AS x, max(s) AS s FROM m WHERE k % 4 = 0 GROUP BY 1, 2 HAVING count(*) >= 2),
b AS (SELECT date_trunc('hour', ts) AS h, station, stddev_pop(k / 100.0) AS x, max(s) AS s FROM m WHERE k % 4 <> 0 GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _hourly_indices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Amplitude index of the test signals and phase index of all others, per hour and station."""
    m = measurements(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts"))
    told = lambda rows, x: rows.groupBy("h", "station").agg(x.alias("x"), F.max("s").alias("s"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    amplitude = told(m.where("k % 4 = 0"), F.stddev_pop("value") / F.nullif(F.avg("value"), F.lit(0.0)))
    return amplitude, told(m.where("k % 4 <> 0"), F.stddev_pop(F.col("k") / 100.0))


@query(f"""{_HOURLY}, c AS (SELECT station, avg(x) AS m4, max(x) AS x4 FROM a WHERE s > {_NOW} - 172800 GROUP BY 1), d AS (SELECT station, avg(x) AS mp, max(x) AS xp FROM b WHERE s > {_NOW} - 172800 GROUP BY 1)
SELECT station, round(m4, 6) AS mean_s4, round(x4, 6) AS max_s4, round(mp, 6) AS mean_phase, round(xp, 6) AS max_phase,
  CASE WHEN m4 < 0.3 THEN 'weak' WHEN m4 < 0.6 THEN 'moderate' WHEN m4 IS NOT NULL THEN 'strong' WHEN mp < 0.2 THEN 'weak' WHEN mp < 0.5 THEN 'moderate' WHEN mp IS NOT NULL THEN 'strong' ELSE 'unknown' END AS severity FROM c FULL JOIN d USING (station)""")
def scintillation_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both indices of the last two days side by side, whichever a station has, and the severity by the mean amplitude or else the mean phase."""
    newest = measurements(spark, sf_dir).agg(F.max("s")).first()[0] or 0.0
    sides = [rows.where(F.col("s") > newest - 2 * DAY).groupBy("station").agg(F.avg("x").alias(f"mean_{n}"), F.max("x").alias(f"max_{n}")) for rows, n in zip(_hourly_indices(spark, sf_dir), ("s4", "phase"))]
    band = lambda x, strong, moderate: F.when(x >= strong, "strong").when(x >= moderate, "moderate").otherwise("weak")
    out = sides[0].join(sides[1], "station", "full")
    severity = F.when(F.col("mean_s4").isNotNull(), band(F.col("mean_s4"), 0.6, 0.3)).when(F.col("mean_phase").isNotNull(), band(F.col("mean_phase"), 0.5, 0.2)).otherwise("unknown")
    return out.withColumn("severity", severity).withColumns({c: r(F.col(c)) for c in ("mean_s4", "max_s4", "mean_phase", "max_phase")})


@query(f"""{_HOURLY} SELECT 'amplitude' AS kind, strftime(h, '%Y-%m-%d %H') AS hour, station, round(x, 6) AS x FROM a UNION ALL SELECT 'phase', strftime(h, '%Y-%m-%d %H'), station, round(x, 6) FROM b""")
def scintillation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [rows.select(F.lit(kind).alias("kind"), _text("h", "yyyy-MM-dd HH").alias("hour"), "station", r(F.col("x")).alias("x")) for rows, kind in zip(_hourly_indices(spark, sf_dir), ("amplitude", "phase"))]
    return sides[0].unionByName(sides[1]).orderBy("hour", "kind", "station")


_EVENTS = f"""j AS (SELECT event_id, ts, s, snr - lag(snr) OVER w AS d, lag(mode) OVER w <> mode AS c FROM m WINDOW w AS (PARTITION BY channel ORDER BY ts, event_id)),
f AS (SELECT event_id, ts, s, mhz, lag(mhz) OVER (PARTITION BY channel ORDER BY ts, event_id) AS b FROM m),
e AS (SELECT event_id, ts, s, CASE WHEN d > 10 THEN 'rise' WHEN d < -10 THEN 'fall' ELSE 'change' END AS kind FROM j WHERE d > 10 OR d < -10 OR c UNION ALL SELECT event_id, ts, s, CASE WHEN mhz > b THEN 'up' ELSE 'down' END FROM f WHERE abs(mhz - b) > 7)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of the signal and moves to a distant frequency."""
    m = measurements(spark, sf_dir)
    signal = series.jumps(m, ["channel"], ORDER, "snr", 10, "mode").select("event_id", "ts", "s", F.col("event").alias("kind"))
    moved = series.jumps(m, ["channel"], ORDER, "mhz", 7).select("event_id", "ts", "s", F.when(F.col("event") == "rise", "up").otherwise("down").alias("kind"))
    return signal.unionByName(moved)


@query(f"{_EVENTS} SELECT event_id, kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM e WHERE s > {_NOW} - 259200")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent(_events(spark, sf_dir), "ts", 3 * DAY, base=measurements(spark, sf_dir)).orderBy(F.desc("ts"), "event_id", "kind").select("event_id", "kind", _text("ts").alias("at"))


@query(f"{_EVENTS} SELECT kind, count(*) AS n FROM e WHERE s > {_NOW} - 21600 GROUP BY 1")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent(_events(spark, sf_dir), "ts", 6 * HOUR, base=measurements(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


_SUN = """y AS (SELECT *, 2 * pi() / 365 * (dayofyear(ts) + (hour(ts) - 12) / 24.0 - 1) AS g FROM m),
t AS (SELECT *, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) AS tilt,
  hour(ts) * 60 + minute(ts) + floor(second(ts)) / 60.0 + 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) + 4 * (-105.0) AS mi FROM y),
z AS (SELECT *, 90 - degrees(asin(least(greatest(sin(radians(40.0)) * sin(tilt) + cos(radians(40.0)) * cos(tilt) * cos(radians(mi / 4 - 180)), -1), 1))) AS zenith FROM t)"""


def _zeniths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).withColumn("zenith", 90 - geometry.solar_elevation(F.col("ts"), F.lit(40.0), F.lit(-105.0)))


@query(f"""{_SUN} SELECT station, mhz, count(*) AS n, round(corr(snr, zenith), 6) AS r, round(regr_slope(snr, zenith), 6) AS slope, round(regr_intercept(snr, zenith), 5) AS intercept, round(regr_r2(snr, zenith), 6) AS r2 FROM z GROUP BY 1, 2 HAVING count(*) >= 10""")
def signal_by_zenith(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zeniths(spark, sf_dir).groupBy("station", "mhz").agg(
        F.count("*").alias("n"), r(F.corr("snr", "zenith")).alias("r"), r(F.regr_slope("snr", "zenith")).alias("slope"), r(F.regr_intercept("snr", "zenith"), 5).alias("intercept"), r(F.regr_r2("snr", "zenith")).alias("r2")
    ).where("n >= 10")


@query(f"""{_SUN} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, round(90 - max(zenith), 4) AS lowest, round(90 - min(zenith), 4) AS highest, count(*) FILTER (zenith > 90) AS in_the_dark FROM z GROUP BY 1""")
def sun_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _zeniths(spark, sf_dir).groupBy(_text("ts", "yyyy-MM-dd HH").alias("hour"))
    return rows.agg(r(90 - F.max("zenith"), 4).alias("lowest"), r(90 - F.min("zenith"), 4).alias("highest"), F.count(F.when(F.col("zenith") > 90, 1)).alias("in_the_dark"))


@query(f"""g AS (SELECT station, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, max(s) AS s FROM m WHERE grade IN ('A', 'B') AND confidence >= 0.3 GROUP BY 1)
SELECT station, event_id, value, round({_NOW} - s, 3) AS age, CASE WHEN {_NOW} - s <= 3600 THEN 'fresh' WHEN {_NOW} - s <= 86400 THEN 'late' ELSE 'stale' END AS state FROM g""")
def current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest credible row of each station and its age."""
    m = measurements(spark, sf_dir)
    newest = m.agg(F.max("s")).first()[0] or 0.0
    good = m.where(F.col("grade").isin("A", "B") & (F.col("confidence") >= 0.3))
    last = good.groupBy("station").agg(F.max_by(F.struct("event_id", "value", "s"), F.struct("ts", "event_id")).alias("_l")).select("station", "_l.*")
    age = F.lit(newest) - F.col("s")
    return last.select("station", "event_id", "value", r(age, 3).alias("age"), reports.by_age(age, [(HOUR, "fresh"), (DAY, "late")], "stale").alias("state"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value, snr FROM m WHERE station = 'view' AND abs(mhz - 5.0) < 0.1 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25'")
def station_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station's rows near a frequency within a range of time; station and range reach the scan."""
    m = measurements(spark, sf_dir).where((F.col("station") == "view") & (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-25") & (F.abs(F.col("mhz") - 5.0) < 0.1))
    return m.orderBy("ts", "event_id").select("event_id", _text("ts").alias("at"), "value", "snr")


@query(_UNWRAP + """, l AS (SELECT u.channel, m.station, arg_max(u.phase, (u.ts, u.event_id)) AS phase, arg_max(snr, (u.ts, u.event_id)) AS snr, count(*) AS n, max(u.ts) AS t FROM u JOIN m USING (event_id) GROUP BY 1, 2)
SELECT l.channel, station, round(phase, 5) AS phase, snr, n, strftime(t, '%Y-%m-%d %H:%M:%S') AS at FROM l""")
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("phase", "snr"), F.struct("ts", "event_id"))
    out = _phases(spark, sf_dir).groupBy("channel", "station").agg(last.alias("_l"), F.count("*").alias("n"), F.max("ts").alias("at"))
    return out.select("channel", "station", r(F.col("_l.phase"), 5).alias("phase"), "_l.snr", "n", _text("at").alias("at"))


@query("""h AS (SELECT DISTINCT channel, date_trunc('hour', ts) AS h FROM m), d AS (SELECT channel, date_trunc('day', h) AS d, count(*) AS hours FROM h GROUP BY 1, 2)
SELECT channel, count(*) AS days, CAST(sum(hours) AS BIGINT) AS hours, count(*) FILTER (hours >= 12) AS good_days, round(avg(hours / 24.0), 6) AS coverage, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last FROM d GROUP BY 1""")
def day_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with rows for each channel and day, then each channel's days."""
    hours = measurements(spark, sf_dir).select("channel", F.date_trunc("hour", "ts").alias("h")).distinct()
    days = hours.groupBy("channel", F.to_date("h").alias("d")).agg(F.count("*").alias("hours"))
    return days.groupBy("channel").agg(
        F.count("*").alias("days"), F.sum("hours").alias("hours"), F.count(F.when(F.col("hours") >= 12, 1)).alias("good_days"), r(F.avg(F.col("hours") / 24.0)).alias("coverage"),
        _text(F.min("d"), "yyyy-MM-dd").alias("first"), _text(F.max("d"), "yyyy-MM-dd").alias("last"),
    )


@query("""h AS (SELECT channel, count(DISTINCT date_trunc('hour', ts)) / 720.0 AS share FROM m GROUP BY 1)
SELECT count(*) AS channels, round(avg(least(share, 1.0)) * 100, 6) AS completeness, count(*) FILTER (share < 0.01) AS sparse FROM h""")
def data_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = measurements(spark, sf_dir).groupBy("channel").agg((F.countDistinct(F.date_trunc("hour", "ts")) / 720.0).alias("share"))
    return hours.agg(F.count("*").alias("channels"), r(F.avg(F.least("share", F.lit(1.0))) * 100).alias("completeness"), F.count(F.when(F.col("share") < 0.01, 1)).alias("sparse"))


#: Broadcasts and what each one's value is expected to be.
BROADCASTS = [("click", 2.5, 12.0), ("click", 5.0, 15.0), ("view", 5.0, 20.0), ("view", 10.0, 25.0), ("purchase", 15.0, 30.0)]
_B = "b(station, mhz, expected) AS (VALUES ('click', 2.5, 12.0), ('click', 5.0, 15.0), ('view', 5.0, 20.0), ('view', 10.0, 25.0), ('purchase', 15.0, 30.0))"


def _listed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` of the broadcasts above, which are few, with what is expected of each."""
    return rows.join(F.broadcast(spark.createDataFrame(BROADCASTS, "station string, mhz double, expected double")), ["station", "mhz"])


@query(f"{_B} SELECT event_id, station || '_' || printf('%.2f', mhz) AS broadcast, round(value - expected, 6) AS error FROM m JOIN b USING (station, mhz) WHERE confidence >= 0.2")
def timing_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listed(spark, measurements(spark, sf_dir).where("confidence >= 0.2"))
    return rows.select("event_id", timing.broadcast_key(F.col("station"), F.col("mhz")).alias("broadcast"), r(F.col("value") - F.col("expected")).alias("error"))


@query(f"""{_B}, g AS (SELECT station, mhz, date_trunc('hour', ts) AS h, avg(snr) AS q, count(*) AS n FROM m GROUP BY 1, 2, 3)
SELECT station, mhz, count(*) AS hours, round(max(q), 6) AS best, round(avg(q), 6) AS mean, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n >= 2) AS repeated FROM g JOIN b USING (station, mhz) GROUP BY 1, 2""")
def broadcast_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _listed(spark, measurements(spark, sf_dir)).groupBy("station", "mhz", F.date_trunc("hour", "ts").alias("h")).agg(F.avg("snr").alias("q"), F.count("*").alias("n"))
    return hours.groupBy("station", "mhz").agg(F.count("*").alias("hours"), r(F.max("q")).alias("best"), r(F.avg("q")).alias("mean"), F.sum("n").alias("n"), F.count(F.when(F.col("n") >= 2, 1)).alias("repeated"))


@query(f"""g AS (SELECT channel, max(s) AS s, count(*) AS n, count(*) FILTER (s > {_NOW} - 86400) AS today FROM m GROUP BY 1)
SELECT channel, n, today, CASE WHEN {_NOW} - s <= 7200 THEN 'ok' WHEN {_NOW} - s <= 43200 THEN 'stale' ELSE 'offline' END AS state FROM g""")
def channel_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    newest = m.agg(F.max("s")).first()[0] or 0.0
    out = m.groupBy("channel").agg(F.max("s").alias("s"), F.count("*").alias("n"), F.count(F.when(F.col("s") > newest - DAY, 1)).alias("today"))
    return out.select("channel", "n", "today", reports.by_age(F.lit(newest) - F.col("s"), [(2 * HOUR, "ok"), (12 * HOUR, "stale")], "offline").alias("state"))


@query("""g AS (SELECT station, date_trunc('day', ts) AS d, count(*) AS n FROM m GROUP BY 1, 2), t AS (SELECT sum(n) AS total FROM g)
SELECT station, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, round(100.0 * sum(n) / any_value(total), 6) AS percent, max(n) AS largest_day FROM g, t GROUP BY 1""")
def storage_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = measurements(spark, sf_dir).groupBy("station", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    out = days.groupBy("station").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.max("n").alias("largest_day"))
    # A row for each category, of which there are few, shares the total.
    return out.withColumn("percent", r(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())))


@query(f"""v AS (SELECT *, value - 30 AS e FROM m WHERE s > {_NOW} - 864000)
SELECT grade, count(*) AS n, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS deviation, round(sqrt(avg(e * e)), 6) AS rms, round(min(e), 6) AS low, round(max(e), 6) AS high, round(100 * avg(CASE WHEN abs(e) <= 10 THEN 1.0 ELSE 0 END), 6) AS within_10, count(DISTINCT date_trunc('hour', ts)) AS hours FROM v GROUP BY 1""")
def validation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.recent(measurements(spark, sf_dir), "ts", 10 * DAY).withColumn("e", F.col("value") - 30)
    return rows.groupBy("grade").agg(
        F.count("*").alias("n"), r(F.avg("e")).alias("mean"), r(F.stddev_samp("e")).alias("deviation"), r(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rms"), r(F.min("e")).alias("low"), r(F.max("e")).alias("high"),
        r(100 * F.avg(F.when(F.abs("e") <= 10, 1.0).otherwise(0.0))).alias("within_10"), F.countDistinct(F.date_trunc("hour", "ts")).alias("hours"),
    )


@query("""g AS (SELECT date_trunc('hour', ts) AS h, station, count(*) AS n, avg(value) AS v FROM m GROUP BY 1, 2), p AS (SELECT *, avg(v) OVER (PARTITION BY h) AS mid FROM g)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, count(*) AS stations, CAST(sum(n) AS BIGINT) AS n, round(max(v) - min(v), 6) AS range, arg_max(station, (round(abs(v - mid), 9), station)) AS farthest FROM p GROUP BY 1""")
def hour_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = measurements(spark, sf_dir).groupBy(_text("ts", "yyyy-MM-dd HH").alias("hour"), "station").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    told = means.withColumn("off", F.round(F.abs(F.col("v") - F.avg("v").over(Window.partitionBy("hour"))), 9))
    return told.groupBy("hour").agg(F.count("*").alias("stations"), F.sum("n").alias("n"), r(F.max("v") - F.min("v")).alias("range"), F.max_by("station", F.struct("off", "station")).alias("farthest"))


_RUNS = """a AS (SELECT *, value > 40 AS f, row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS p FROM m), b AS (SELECT channel, ts, p - row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS i FROM a WHERE f),
w AS (SELECT channel, min(ts) AS first, max(ts) AS last, count(*) AS length FROM b GROUP BY channel, i HAVING count(*) >= 3)"""


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.runs(measurements(spark, sf_dir), ["channel"], ORDER, F.col("value") > 40, least=3)


@query(f"""{_RUNS} SELECT strftime(first, '%Y-%m-%d') AS day, count(*) AS n, round(avg(length), 6) AS mean_length, max(length) AS longest, round(avg(epoch_us(last) - epoch_us(first)) / 1e6, 3) AS mean_seconds, count(DISTINCT channel) AS channels FROM w GROUP BY 1""")
def wave_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).groupBy(_text("first", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), r(F.avg("length")).alias("mean_length"), F.max("length").alias("longest"), r(F.avg(F.unix_micros("last") - F.unix_micros("first")) / 1e6, 3).alias("mean_seconds"), F.countDistinct("channel").alias("channels")
    )


@query(f"""{_RUNS} SELECT channel, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, length FROM w WHERE last >= TIMESTAMP '2024-01-10' AND first < TIMESTAMP '2024-01-20'""")
def waves_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that overlap a range of time, newest first."""
    rows = _waves(spark, sf_dir).where((F.col("last") >= "2024-01-10") & (F.col("first") < "2024-01-20"))
    return rows.orderBy(F.desc("first"), "channel").select("channel", _text("first").alias("first"), _text("last").alias("last"), "length")


@query(f"""v AS (SELECT *, s > {_NOW} - 86400 AS today FROM m)
SELECT station, count(*) AS n, count(*) FILTER (today) AS n_today, round(avg(snr) FILTER (today), 6) AS snr_today, count(DISTINCT mhz) FILTER (today) AS frequencies_today, count(*) FILTER (today AND grade = 'A') AS grade_a_today, round(arg_max(value, (ts, event_id)), 6) AS newest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM v GROUP BY 1""")
def station_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    newest = m.agg(F.max("s")).first()[0] or 0.0
    today = lambda c: F.when(F.col("s") > newest - DAY, c)
    return m.groupBy("station").agg(
        F.count("*").alias("n"), F.count(today(F.lit(1))).alias("n_today"), r(F.avg(today(F.col("snr")))).alias("snr_today"), F.countDistinct(today(F.col("mhz"))).alias("frequencies_today"),
        F.count(today(F.when(F.col("grade") == "A", 1))).alias("grade_a_today"), r(F.max_by("value", F.struct("ts", "event_id"))).alias("newest"), _text(F.max("ts")).alias("at"),
    )


@query("""g AS (SELECT mhz, station, count(*) AS n FROM m WHERE snr >= 10 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT mhz, string_agg(station, ',' ORDER BY station) AS stations, count(*) > 1 AS shared, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1""")
def channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies with the stations that are usable on each."""
    pairs = measurements(spark, sf_dir).where("snr >= 10").groupBy("mhz", "station").agg(F.count("*").alias("n")).where("n >= 3")
    return pairs.groupBy("mhz").agg(F.array_join(F.array_sort(F.collect_set("station")), ",").alias("stations"), (F.count("*") > 1).alias("shared"), F.sum("n").alias("n"))


@query("""g AS (SELECT channel, station, avg(snr) AS q, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT channel, arg_max(station, (round(q, 9), n, station)) AS best, round(max(q), 6) AS mean_snr, count(*) FILTER (q >= 15) AS usable FROM g GROUP BY 1""")
def best_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = measurements(spark, sf_dir).groupBy("channel", "station").agg(F.avg("snr").alias("q"), F.count("*").alias("n")).where("n >= 2")
    return means.groupBy("channel").agg(F.max_by("station", F.struct(F.round("q", 9), "n", "station")).alias("best"), r(F.max("q")).alias("mean_snr"), F.count(F.when(F.col("q") >= 15, 1)).alias("usable"))


@query("""g AS (SELECT date_trunc('hour', ts) AS h, station, count(*) FILTER (grade IN ('A', 'B') AND snr >= 10) AS good FROM m GROUP BY 1, 2),
p AS (SELECT h, station, list_position(['purchase', 'signup', 'click', 'view'], station) AS place FROM g WHERE good > 0)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, arg_min(station, place) AS active, count(*) AS able FROM p WHERE place > 0 GROUP BY 1""")
def active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour the first source, in the order of authority, that has a good row."""
    place = F.array_position(F.array(*map(F.lit, ("purchase", "signup", "click", "view"))), F.col("station"))
    good = F.max(F.col("grade").isin("A", "B") & (F.col("snr") >= 10))
    able = measurements(spark, sf_dir).groupBy(_text("ts", "yyyy-MM-dd HH").alias("hour"), "station").agg(good.alias("good")).where("good").withColumn("place", place).where("place > 0")
    return able.groupBy("hour").agg(F.min_by("station", "place").alias("active"), F.count("*").alias("able"))


@query("""SELECT 'timing' AS product, event_id, value, snr, NULL::VARCHAR AS mode FROM m WHERE station = 'click' UNION ALL SELECT 'tick', event_id, NULL, snr, mode FROM m WHERE station = 'view'""")
def united_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two products with different fields as one, nulls where one has none."""
    m = measurements(spark, sf_dir)
    a = m.where("station = 'click'").select(F.lit("timing").alias("product"), "event_id", "value", "snr")
    return a.unionByName(m.where("station = 'view'").select(F.lit("tick").alias("product"), "event_id", "snr", "mode"), allowMissingColumns=True)


@query("SELECT channel, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS variance FROM m GROUP BY 1")
def online_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.merged_statistics(measurements(spark, sf_dir), ["channel"], F.to_date("ts"), "value")
    return out.select("channel", "n", r(F.col("mean")).alias("mean"), r(F.col("variance"), 5).alias("variance"))


@query("""v AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts DESC, event_id DESC) AS q FROM m)
SELECT station, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(sqrt(avg((value - 30) * (value - 30))), 6) AS rms FROM v WHERE q <= 50 GROUP BY 1""")
def recent_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each station's newest fifty rows, found among those of its days."""
    newest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))
    rows = measurements(spark, sf_dir).select("station", "ts", "event_id", "value").withColumn("day", F.to_date("ts"))
    last = rows.withColumn("q", newest("station", "day")).where("q <= 50").withColumn("q", newest("station")).where("q <= 50")
    off = F.col("value") - 30
    return last.groupBy("station").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("deviation"), r(F.sqrt(F.avg(off * off))).alias("rms"))


@query("""l AS (SELECT station, arg_max(value, (ts, event_id)) AS value, arg_max(snr, (ts, event_id)) AS snr, max(value) AS top FROM m GROUP BY 1)
SELECT station, round(value, 6) AS value, snr, CASE WHEN value >= 100 THEN 'alert' WHEN value >= 50 THEN 'warning' ELSE 'quiet' END AS now, CASE WHEN top >= 100 THEN 'alert' WHEN top >= 50 THEN 'warning' ELSE 'quiet' END AS ever FROM l""")
def feed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each feed and its level of alert, now and at worst."""
    last = measurements(spark, sf_dir).groupBy("station").agg(F.max_by(F.struct("value", "snr"), F.struct("ts", "event_id")).alias("_l"), F.max("value").alias("top"))
    level = lambda x: F.when(x >= 100, "alert").when(x >= 50, "warning").otherwise("quiet")
    return last.select("station", r(F.col("_l.value")).alias("value"), "_l.snr", level(F.col("_l.value")).alias("now"), level(F.col("top")).alias("ever"))


@query("""p AS (SELECT event_id, s, 1 + k % 3 AS hops, 500.0 + k * 150.0 AS d FROM m),
q AS (SELECT event_id, s, 2 * hops * sqrt(6371.0 ** 2 + 6671.0 ** 2 - 2 * 6371.0 * 6671.0 * cos(d / (2 * hops * 6371.0))) / 299792.458 AS delay FROM p)
SELECT event_id, round(delay * 1000, 6) AS delay_ms, round(s - delay - floor(s - delay), 4) AS second_part FROM q""")
def emission_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each row was sent: its arrival less the delay of its path."""
    hops = 1 + F.col("k") % 3
    delay = geometry.hop_path_km(500.0 + F.col("k") * 150.0, F.lit(300.0), hops) / 299_792.458
    sent = F.col("s") - delay
    return measurements(spark, sf_dir).select("event_id", r(delay * 1000).alias("delay_ms"), r(sent - F.floor(sent), 4).alias("second_part"))


@query("""s AS (SELECT station, mhz, count(*) AS n, max(confidence) AS best FROM m GROUP BY 1, 2)
SELECT station || CASE WHEN mhz <= 0 THEN '' ELSE '_' || printf('%.2f', mhz) END AS broadcast, CAST(round(mhz * 1000) AS INTEGER) AS khz, n, best, CASE WHEN n >= 40 AND best >= 0.8 THEN 'GOOD' WHEN n >= 20 AND best >= 0.5 THEN 'MARGINAL' ELSE 'BAD' END AS flag FROM s""")
def broadcast_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = measurements(spark, sf_dir).groupBy("station", "mhz").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    return pairs.select(timing.broadcast_key(F.col("station"), F.col("mhz")).alias("broadcast"), timing.frequency_khz(F.col("mhz")).alias("khz"), "n", "best", quality.completeness_flag(F.col("n"), F.col("best")).alias("flag"))


@query("""SELECT a.event_id, b.event_id AS earlier_id, round(a.s - b.s, 3) AS apart FROM m AS a JOIN m AS b ON a.channel = b.channel AND b.station = 'view' AND b.s <= a.s AND a.s - b.s <= 3600 AND a.event_id <> b.event_id WHERE a.station = 'purchase'""")
def views_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one product within an hour before a row of another on the same channel."""
    m = measurements(spark, sf_dir)
    events = m.where("station = 'purchase'").select("event_id", "channel", F.col("s").alias("e_s"))
    samples = m.where("station = 'view'").select(F.col("event_id").alias("earlier_id"), F.col("channel").alias("c2"), F.col("s").alias("s2"))
    near = joins.within(events, samples, "e_s", "s2", HOUR).where((F.col("channel") == F.col("c2")) & (F.col("s2") <= F.col("e_s")))
    return near.select("event_id", "earlier_id", r(F.col("e_s") - F.col("s2"), 3).alias("apart"))


QUERIES = {f.__name__: f for f in (
    current_conditions, daily_usable_frequency, scintillation_by_path, scintillation_history, recent_events, event_counts, signal_by_zenith, sun_by_hour, current_values, station_history, phase_summary, day_coverage,
    data_completeness, timing_errors, broadcast_hours, channel_health, storage_inventory, validation_statistics, hour_details, wave_statistics, waves_in_range, station_dashboard, channel_list, best_stations,
    active_sources, united_products, online_statistics, recent_accuracy, feed_alerts, emission_times, broadcast_list, views_before_purchase,
)}
