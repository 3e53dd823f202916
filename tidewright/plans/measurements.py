"""Queries that apply the operators to the ``events`` table as a stream of measurements, each with its SQL.

An event is a measurement: its type is the station, its user the channel, its
value the measured quantity; k, the number in its properties, gives the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import catalog
from tidewright.functions import quality
from tidewright.operators import aggregates, joins, series
from tidewright.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The common table expression that every query's SQL starts with, and the same rows in Spark.
M = """m AS (SELECT event_id, ts, event_type AS station, user_id AS channel, value, k, k % 40 AS snr, (k % 11) / 10.0 AS confidence,
  CASE k % 4 WHEN 0 THEN '1F' WHEN 1 THEN '2F' WHEN 2 THEN '1E' ELSE 'x' END AS mode,
  CASE WHEN value < 20 THEN 'A' WHEN value < 50 THEN 'B' WHEN value < 100 THEN 'C' ELSE 'D' END AS grade,
  2.5 * (1 + k % 6) AS mhz, epoch_us(ts) / 1e6 AS s
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) AS e)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts) / 1e6").alias("s"), F.col("event_type").alias("station"), F.col("user_id").alias("channel"), "value", k.alias("k"))
    mode = F.when(F.col("k") % 4 == 0, "1F").when(F.col("k") % 4 == 1, "2F").when(F.col("k") % 4 == 2, "1E").otherwise("x")
    grade = quality.banded(F.col("value"), [(20, "A"), (50, "B"), (100, "C")], "D")
    return rows.withColumns({
        "snr": F.col("k") % 40, "confidence": (F.col("k") % 11) / 10.0, "mode": mode, "grade": grade,
        "mhz": 2.5 * (1 + F.col("k") % 6),
    })


def query(sql: str | None = None, name: str = ""):
    """Registers a query under its function's name, and its SQL, which may use m. SQL that begins with RECURSIVE_ refers to tables of its own before they end."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            head, rest = ("WITH RECURSIVE", sql[len("RECURSIVE_") :]) if sql.startswith("RECURSIVE_") else ("WITH", sql)
            ORACLES[name or f.__name__] = f"{head} {M}{',' if rest.lstrip()[:6].upper() != 'SELECT' else ''} {rest}"
        return f

    return keep


def r(c, n: int = 6):
    return F.round(c, n)


ORDER = ["ts", "event_id"]


@query("SELECT event_id, station, grade, confidence FROM m WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND grade IN ('A', 'B') AND confidence >= 0.3")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.scan(measurements(spark, sf_dir), "2024-01-05", "2024-01-20", grade="B", confidence=0.3)
    return rows.select("event_id", "station", "grade", "confidence")


@query("SELECT channel, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, count(*) AS n, count(DISTINCT station) AS stations FROM m GROUP BY channel")
def channel_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    return m.groupBy("channel").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"), F.count("*").alias("n"), F.countDistinct("station").alias("stations"))


def _mode_sql(unit: str, fmt: str, expected: int) -> str:
    return f"""g AS (SELECT strftime(date_trunc('{unit}', ts), '{fmt}') AS period, station, mhz, count(*) AS n, avg(CASE WHEN mode = '1F' THEN 1.0 ELSE 0 END) AS f1,
  avg(CASE WHEN mode = '2F' THEN 1.0 ELSE 0 END) AS f2, avg(CASE WHEN mode = '1E' THEN 1.0 ELSE 0 END) AS e1, avg(CASE WHEN mode NOT IN ('1F', '2F', '1E') THEN 1.0 ELSE 0 END) AS un, avg(snr) AS mean_snr
  FROM m GROUP BY 1, 2, 3), h AS (SELECT *, least(1.0, n / {expected}.0) AS c, CASE WHEN f1 + f2 < 0.3 THEN NULL WHEN f1 + f2 > 0.7 THEN mhz * 1.2 WHEN f1 + f2 > 0.5 THEN mhz * 1.1 ELSE mhz END AS u FROM g)
SELECT period, station, mhz, n, round(f1, 6) AS share_1f, round(f2, 6) AS share_2f, round(e1, 6) AS share_1e, round(un, 6) AS share_unknown, round(mean_snr, 6) AS mean_snr, round(c, 6) AS completeness,
  CASE WHEN n >= 40 AND c >= 0.8 THEN 'GOOD' WHEN n >= 20 AND c >= 0.5 THEN 'MARGINAL' ELSE 'BAD' END AS flag, round(u, 6) AS usable, CASE WHEN u IS NOT NULL THEN round(least(1.0, n / 60.0 * (f1 + f2)), 6) END AS usable_confidence FROM h"""


def _mode_stats(spark: SparkSession, sf_dir: str, unit: str, fmt: str, expected: int) -> DataFrame:
    rows = measurements(spark, sf_dir).withColumn("period", F.date_format(F.date_trunc(unit, "ts"), fmt))
    out = aggregates.mode_statistics(rows, ["period", "station", "mhz"], "mode", ["1F", "2F", "1E"], F.lit(float(expected)), "snr", "mhz")
    rounded = ["share_1f", "share_2f", "share_1e", "share_unknown", "mean_snr", "completeness", "usable", "usable_confidence"]
    return out.withColumns({c: r(F.col(c)) for c in rounded})


@query(_mode_sql("hour", "%Y-%m-%d %H:%M", 60))
def hourly_mode_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode_stats(spark, sf_dir, "hour", "yyyy-MM-dd HH:mm", 60)


@query(_mode_sql("day", "%Y-%m-%d", 1440))
def daily_mode_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mode_stats(spark, sf_dir, "day", "yyyy-MM-dd", 1440)


_MAD = """a AS (SELECT station, median(value) AS med, count(*) AS n FROM m GROUP BY station), b AS (SELECT m.*, med, n FROM m JOIN a USING (station)),
c AS (SELECT station, median(abs(value - med)) AS mad FROM b GROUP BY station),
o AS (SELECT b.*, mad, coalesce(abs(value - med) > 3.0 * 1.4826 * mad AND n >= 3 AND mad >= 0.01, false) AS outlier FROM b JOIN c USING (station))"""


@query(_MAD + " SELECT event_id, round(med, 6) AS median, round(mad, 6) AS mad, outlier FROM o")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.robust_split(measurements(spark, sf_dir), ["station"], "value")
    return rows.select("event_id", r(F.col("median")).alias("median"), r(F.col("mad")).alias("mad"), "outlier")


_EST = _MAD + """, w AS (SELECT *, CASE WHEN snr >= 5 THEN CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 WHEN 'C' THEN 0.4 ELSE 0.15 END
  * least(greatest((snr - 5) / 25.0, 0.1), 1.0) * greatest(confidence, 0.1) ELSE 0 END AS w, date_trunc('day', ts) AS day FROM o WHERE NOT outlier),
q AS (SELECT day, station, sum(w * value) / sum(w) AS mean FROM w GROUP BY day, station HAVING sum(w) >= 0.01),
e AS (SELECT day, station, any_value(mean) AS estimate, CASE WHEN count(*) > 1 THEN sqrt(sum(w * (value - mean) ** 2) / sum(w)) ELSE 2.0 END AS uncertainty, count(*) AS n, min(grade) AS best_grade, avg(snr) AS mean_snr
  FROM w JOIN q USING (day, station) GROUP BY day, station)"""


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = aggregates.robust_split(measurements(spark, sf_dir), ["station"], "value").where("not outlier")
    weight = aggregates.consensus_weight(F.col("grade"), F.col("snr"), F.col("confidence"))
    return aggregates.station_estimates(kept.withColumns({"weight": weight, "day": F.date_format("ts", "yyyy-MM-dd")}), ["day", "station"])


@query(_EST + " SELECT strftime(day, '%Y-%m-%d') AS day, station, round(estimate, 5) AS estimate, round(uncertainty, 5) AS uncertainty, n, best_grade, round(mean_snr, 5) AS mean_snr FROM e")
def station_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _estimates(spark, sf_dir).withColumns({c: r(F.col(c), 5) for c in ("estimate", "uncertainty", "mean_snr")})


@query(_EST + """, z AS (SELECT *, n / greatest(uncertainty, 0.1) AS v FROM e),
y AS (SELECT day, count(*) AS stations, sum(v * estimate) / sum(v) AS consensus, max(estimate) - min(estimate) AS agreement,
  sqrt(sum(v * v * uncertainty * uncertainty) / (sum(v) * sum(v)) + ((max(estimate) - min(estimate)) / 2) ** 2) AS uncertainty FROM z GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, stations, round(consensus, 5) AS consensus, round(agreement, 5) AS agreement, round(uncertainty, 5) AS uncertainty,
  CASE WHEN stations = 1 THEN 'SINGLE_SOURCE' WHEN agreement < 1 THEN 'LOCKED' WHEN agreement < 3 THEN 'CONVERGING' ELSE 'DIVERGENT' END AS state FROM y""")
def daily_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.consensus(_estimates(spark, sf_dir), ["day"]).withColumns({c: r(F.col(c), 5) for c in ("consensus", "agreement", "uncertainty")})


@query("""b AS (SELECT station, date_trunc('day', ts) AS day, 1 / (mhz * mhz) AS x, value AS y, 1.0 + snr AS w FROM m),
c AS (SELECT station, day, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM b GROUP BY station, day),
d AS (SELECT station, day, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(w) AS sw, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy, sum(w * (y - my) * (y - my)) AS syy FROM b JOIN c USING (station, day) GROUP BY station, day)
SELECT station, strftime(day, '%Y-%m-%d') AS day, n, round(sxy / nullif(sxx, 0), 4) AS slope, round(my - sxy / nullif(sxx, 0) * mx, 4) AS intercept, round(sqrt(greatest(syy - sxy / nullif(sxx, 0) * sxy, 0) / sw), 4) AS rms FROM d""")
def dispersion_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = aggregates.weighted_line(m, ["station", "day"], 1 / (F.col("mhz") * F.col("mhz")), F.col("value"), 1.0 + F.col("snr"))
    return out.select("station", "day", "n", *[r(F.col(c), 4).alias(c) for c in ("slope", "intercept", "rms")])


@query("""a AS (SELECT station, value, sum(1.0 + k) OVER (PARTITION BY station ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS c, sum(1.0 + k) OVER (PARTITION BY station) / 2 AS h FROM m)
SELECT station, min(value) AS weighted_median FROM a WHERE c >= h GROUP BY station""")
def weighted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.weighted_median(measurements(spark, sf_dir).withColumn("w", 1.0 + F.col("k")), ["station"], "value", "w", "event_id")


@query("""a AS (SELECT station, date_trunc('day', ts) AS day, mhz, avg(value) AS v FROM m GROUP BY 1, 2, 3)
SELECT station, strftime(day, '%Y-%m-%d') AS day, count(*) AS groups, round(max(v) - min(v), 6) AS spread, count(*) > 1 AND max(v) - min(v) > 20 AS inconsistent FROM a GROUP BY station, day""")
def cross_frequency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return aggregates.layered_range(m, ["station", "day"], ["mhz"], "value", 20.0).withColumn("spread", r(F.col("spread")))


@query("""a AS (SELECT channel, k, count(*) AS n, min(event_id) AS f FROM m GROUP BY channel, k)
SELECT channel, k, n FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, f) AS q FROM a) AS b WHERE q = 1""")
def modal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.modal(measurements(spark, sf_dir), ["channel"], "k", "event_id")


@query("SELECT s.i AS sector, count(m.k) AS n FROM (SELECT unnest(range(8)) AS i) AS s LEFT JOIN m ON CAST(floor(((m.k * 3.6 + 22.5) % 360) / 45) AS INTEGER) = s.i GROUP BY s.i")
def direction_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sectors(measurements(spark, sf_dir).withColumn("angle", F.col("k") * 3.6), "angle")


@query("""h AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, avg(value) AS a, stddev_samp(value) AS sd, stddev_pop(value) AS sp, min(value) AS lo, max(value) AS hi,
  avg(CASE WHEN abs(value - 30) <= 1 THEN 100.0 ELSE 0 END) AS w1, avg(CASE WHEN abs(value - 30) <= 5 THEN 100.0 ELSE 0 END) AS w5, avg(CASE WHEN grade = 'A' THEN 100.0 ELSE 0 END) AS ga, arg_max(event_id, (value, event_id)) AS worst FROM m GROUP BY 1)
SELECT day, n, round(a, 6) AS mean, round(sd, 6) AS sample_std, round(sp, 6) AS population_std, lo, hi, round(w1, 6) AS within_1, round(w5, 6) AS within_5, round(ga, 6) AS grade_a, worst FROM h""")
def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    share = lambda c: r(F.avg(F.when(c, 100.0).otherwise(0.0)))
    off = F.abs(F.col("value") - 30)
    return m.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("sample_std"), r(F.stddev_pop("value")).alias("population_std"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), share(off <= 1).alias("within_1"), share(off <= 5).alias("within_5"), share(F.col("grade") == "A").alias("grade_a"),
        F.max_by("event_id", F.struct("value", "event_id")).alias("worst"),
    )


@query("""a AS (SELECT channel, count(*) AS n, regr_slope(value, s - 1704067200) AS b, regr_intercept(value, s - 1704067200) AS i FROM m GROUP BY channel)
SELECT channel, n, round(b * 86400, 5) AS drift_per_day, round(i, 4) AS offset_start FROM a""")
def channel_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("s") - 1_704_067_200
    return measurements(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), r(F.regr_slope("value", t) * 86400, 5).alias("drift_per_day"), r(F.regr_intercept("value", t), 4).alias("offset_start"))


def _adev_sql(steps: list[int], extra: str = "") -> str:
    parts = " UNION ALL ".join(
        f"SELECT station, {m}.0 AS tau, count(*) AS n, sqrt(avg(d * d) / (2 * {m}.0 * {m}.0)) AS adev FROM (SELECT station, p, c, lead(value, {2 * m}) OVER w - 2 * lead(value, {m}) OVER w + value AS d FROM o WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)) AS x WHERE d IS NOT NULL{extra.format(m=m)} GROUP BY station"
        for m in steps
    )
    return f"o AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY station) AS c FROM m), f AS ({parts})"


_STEPS = [1, 2, 4, 8, 16]


@query(_adev_sql(_STEPS) + " SELECT station, tau, n, round(adev, 6) AS adev FROM f")
def phase_adev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.phase_adev(measurements(spark, sf_dir), ["station"], ORDER, "value", _STEPS).withColumn("adev", r(F.col("adev")))


@query(_adev_sql(_STEPS, " AND p % {m} = 0 AND p / {m} < floor((c - 2 * {m}) / {m})") + " SELECT station, tau, n, round(adev, 6) AS adev FROM f")
def phase_adev_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.phase_adev(measurements(spark, sf_dir), ["station"], ORDER, "value", _STEPS, overlapping=False).withColumn("adev", r(F.col("adev")))


@query(_adev_sql(_STEPS) + """, g AS (SELECT station, count(*) AS n, regr_slope(log10(adev), log10(tau)) AS slope FROM f WHERE adev > 0 GROUP BY station)
SELECT station, n, round(slope, 6) AS slope, CASE WHEN n < 3 THEN 'Insufficient data' WHEN slope < -0.75 THEN 'White Phase Noise' WHEN slope < -0.25 THEN 'Flicker Phase Noise' WHEN slope < 0.25 THEN 'White Frequency Noise'
  WHEN slope < 0.75 THEN 'Flicker Frequency Noise' ELSE 'Random Walk Frequency' END AS noise FROM g""")
def noise_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    adev = series.phase_adev(measurements(spark, sf_dir), ["station"], ORDER, "value", _STEPS)
    return series.noise_type(adev, ["station"]).withColumn("slope", r(F.col("slope")))


def _fadev_sql(steps: list[int]) -> str:
    part = "SELECT station, {m}.0 AS tau, count(*) AS n, sqrt(avg(d * d) / 2) AS adev FROM (SELECT station, p, c, lead(v, {m}) OVER (PARTITION BY station ORDER BY p) - v AS d FROM (SELECT station, p, c, avg(value) OVER (PARTITION BY station ORDER BY p ROWS BETWEEN CURRENT ROW AND {l} FOLLOWING) AS v FROM o) AS y) AS x WHERE p + {t} <= c GROUP BY station"
    return "o AS (SELECT station, value, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) AS p, count(*) OVER (PARTITION BY station) AS c FROM m), f AS (" + " UNION ALL ".join(part.format(m=m, l=m - 1, t=2 * m - 1) for m in steps) + ")"


@query(_fadev_sql([1, 4, 16]) + " SELECT station, tau, n, round(adev, 6) AS adev FROM f")
def frequency_adev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.frequency_adev(measurements(spark, sf_dir), ["station"], ORDER, "value", [1, 4, 16]).withColumn("adev", r(F.col("adev")))


@query("""a AS (SELECT station, ts, event_id, lead(value, 4) OVER (PARTITION BY station ORDER BY ts, event_id) - value AS d FROM m), b AS (SELECT * FROM a WHERE d IS NOT NULL),
c AS (SELECT station, lead(d) OVER (PARTITION BY station ORDER BY ts, event_id) - d AS e FROM b)
SELECT station, count(e) AS n, round(sqrt(avg(e * e) / 2) / 1000 / 4, 8) AS adev FROM c GROUP BY station HAVING count(e) >= 1""")
def tracker_adev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.tracker_adev(measurements(spark, sf_dir), ["station"], ORDER, "value", 4, 4.0).withColumn("adev", r(F.col("adev"), 8))


_UNWRAP = """a AS (SELECT event_id, channel, ts, s, k / 100.0 * 6.0 AS x FROM m), b AS (SELECT *, x - lag(x) OVER (PARTITION BY channel ORDER BY ts, event_id) AS d FROM a),
c AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < pi() THEN 0 ELSE -2 * pi() * round(d / (2 * pi())) END AS f FROM b),
u AS (SELECT event_id, channel, ts, s, x + sum(f) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM c)"""


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).withColumn("x", F.col("k") / 100.0 * 6.0)
    return series.unwrapped(rows, ["channel"], ORDER, "x", "phase")


@query(_UNWRAP + " SELECT event_id, round(phase, 6) AS phase FROM u")
def phase_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phases(spark, sf_dir).select("event_id", r(F.col("phase")).alias("phase"))


@query(_UNWRAP + """, d AS (SELECT event_id, channel, ts, -(phase - lag(phase) OVER w) / (2 * pi() * nullif(s - lag(s) OVER w, 0)) AS hz, s - (s - lag(s) OVER w) / 2 AS mid FROM u WINDOW w AS (PARTITION BY channel ORDER BY ts, event_id))
SELECT event_id, round(mid, 3) AS middle, round(sum(hz) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 * 1000, 5) AS doppler_mhz FROM d WHERE hz IS NOT NULL""")
def doppler_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.doppler(_phases(spark, sf_dir), ["channel"], ORDER, "s", "phase", smooth=3)
    return out.select("event_id", r(F.col("middle"), 3).alias("middle"), r(F.col("doppler") * 1000, 5).alias("doppler_mhz"))


@query(_UNWRAP + """, v AS (SELECT channel, s, phase, m.value FROM u JOIN m USING (event_id, channel, s)),
z AS (SELECT channel, floor(s / 43200) * 43200 AS window_start, s, phase, value FROM v UNION ALL SELECT channel, floor(s / 43200) * 43200 - 43200, s, phase, value FROM v),
g AS (SELECT channel, window_start, count(*) AS n, var_pop(phase) AS vy, var_pop(s - 1704067200) AS vx, covar_pop(phase, s - 1704067200) AS c, avg(value) AS p, var_pop(value) AS vp FROM z GROUP BY channel, window_start HAVING count(*) >= 5)
SELECT channel, CAST(window_start AS BIGINT) AS window_start, n, round(sqrt(greatest(vy - coalesce(c * c / nullif(vx, 0), 0), 0)), 4) AS sigma_phi, round(sqrt(vp) / nullif(p, 0), 5) AS s4 FROM g""")
def scintillation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.hopping_windows(_phases(spark, sf_dir), "s", 86400.0).withColumn("t", F.col("s") - 1_704_067_200)
    out = series.scintillation(rows, ["channel", "window_start"], "t", "phase", "value")
    return out.select("channel", F.col("window_start").cast("long").alias("window_start"), "n", r(F.col("sigma_phi"), 4).alias("sigma_phi"), r(F.col("s4"), 5).alias("s4"))


@query("""a AS (SELECT event_id, value, avg(value) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, count(*) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS nb,
  avg(value) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS f, count(*) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nf FROM m)
SELECT event_id, value, CASE WHEN value / 0.997e6 >= 1e-4 THEN 'X' || format('{:.1f}', value / 0.997e6 / 1e-4) WHEN value / 0.997e6 >= 1e-5 THEN 'M' || format('{:.1f}', value / 0.997e6 / 1e-5) ELSE 'other' END AS class FROM a WHERE nb = 5 AND nf = 5 AND value >= 50 AND value > b * 1.5 AND value > f""")
def flare_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.peaks(measurements(spark, sf_dir), ["station"], ORDER, "value", 50.0)
    return out.select("event_id", "value", quality.xray_class(F.col("value") / 0.997e6).alias("class"))


@query("""a AS (SELECT event_id, snr - lag(snr) OVER w AS d, lag(mode) OVER w <> mode AS c FROM m WINDOW w AS (PARTITION BY channel ORDER BY ts, event_id))
SELECT event_id, d AS change, CASE WHEN d > 10 THEN 'rise' WHEN d < -10 THEN 'fall' WHEN c THEN 'change' END AS event FROM a WHERE d > 10 OR d < -10 OR c""")
def signal_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.jumps(measurements(spark, sf_dir), ["channel"], ORDER, "snr", 10, "mode").select("event_id", "change", "event")


@query("""a AS (SELECT channel, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY channel ORDER BY ts, event_id))) / 1e6 AS g FROM m),
b AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT channel, session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(max(CASE WHEN g > 14400 THEN g END), 3) AS gap FROM b GROUP BY channel, session""")
def channel_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.sessions(measurements(spark, sf_dir), ["channel"], ORDER, "ts", 14400)
    return out.select("channel", "session", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", r(F.col("gap"), 3).alias("gap"))


@query("""a AS (SELECT *, value > 40 AS f, row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS p FROM m),
b AS (SELECT channel, ts, p - row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) AS i FROM a WHERE f)
SELECT channel, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS length FROM b GROUP BY channel, i HAVING count(*) >= 3""")
def over_limit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.runs(measurements(spark, sf_dir), ["channel"], ORDER, F.col("value") > 40, least=3)
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("channel", when("first"), when("last"), "length")


@query("""a AS (SELECT event_id, (k - lag(k) OVER w) AS d, s - lag(s) OVER w AS t FROM m WINDOW w AS (PARTITION BY channel ORDER BY ts, event_id))
SELECT event_id, CASE WHEN d >= 0 AND t > 0 THEN round(d / t * 3600, 6) END AS per_hour FROM a""")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rates(measurements(spark, sf_dir), ["channel"], ORDER, "k", "s").select("event_id", r(F.col("rate") * 3600).alias("per_hour"))


@query("""a AS (SELECT channel, value - lag(value) OVER (PARTITION BY channel ORDER BY ts, event_id) AS d FROM m) SELECT channel, count(d) AS n, round(stddev_pop(d), 6) AS jitter FROM a GROUP BY channel""")
def channel_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.jitter(measurements(spark, sf_dir), ["channel"], ORDER, "value").withColumn("jitter", r(F.col("jitter")))


@query("""a AS (SELECT channel, value, row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) > floor(count(*) OVER (PARTITION BY channel) / 2) AS l FROM m)
SELECT channel, count(*) AS n, round(avg(value) FILTER (l) - avg(value) FILTER (NOT l), 6) AS shift FROM a GROUP BY channel""")
def snr_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.halves_shift(measurements(spark, sf_dir), ["channel"], ORDER, "value").withColumn("shift", r(F.col("shift")))


@query("""g AS (SELECT station, unnest(range(CAST(ceil(min(s) / 3600) AS BIGINT), CAST(floor(max(s) / 3600) AS BIGINT) + 1)) * 3600.0 AS at FROM m GROUP BY station),
p AS (SELECT station, s AS a, value AS va, lead(s) OVER (PARTITION BY station ORDER BY s) AS b, lead(value) OVER (PARTITION BY station ORDER BY s) AS vb FROM m)
SELECT g.station, CAST(g.at AS BIGINT) AS at, round(CASE WHEN p.a = g.at OR p.b IS NULL THEN va ELSE va + (g.at - a) / (b - a) * (vb - va) END, 5) AS value FROM g JOIN p ON g.station = p.station AND g.at >= p.a AND (g.at < p.b OR p.b IS NULL)""")
def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.resampled(measurements(spark, sf_dir), ["station"], "s", "value", 3600)
    return out.select("station", F.col("at").cast("long").alias("at"), r(F.col("value"), 5).alias("value"))


@query("SELECT channel, station, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY channel, station ORDER BY ts DESC, event_id DESC) AS q FROM m) AS x WHERE q = 1")
def last_of_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    return joins.last_wins(m.select("channel", "station", "ts", "event_id", "value"), ["channel", "station"], ORDER).drop("ts")


@query("SELECT hour, channel, event_id FROM (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, channel, event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts), channel ORDER BY ts, event_id) AS q FROM m) AS x WHERE q = 1")
def first_of_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "channel", "ts", "event_id")
    return joins.first_wins(m, ["hour", "channel"], ORDER).drop("ts")


@query("""a AS (SELECT m.event_id, g.event_id AS g_id, g.value AS g_value, row_number() OVER (PARTITION BY m.event_id ORDER BY abs(g.s - m.s), g.event_id) AS q FROM m JOIN m AS g ON g.station = 'purchase' AND g.s BETWEEN m.s - 1800 AND m.s + 1800 WHERE m.station = 'click')
SELECT m.event_id, CASE WHEN a.g_value > 5 AND a.g_value <= 60 THEN a.g_id END AS g_id, CASE WHEN a.g_value > 5 AND a.g_value <= 60 THEN a.g_value END AS g_value FROM m LEFT JOIN a ON a.event_id = m.event_id AND a.q = 1 WHERE m.station = 'click'""")
def nearest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    left = m.where("station = 'click'").select("event_id", "s")
    right = m.where("station = 'purchase'").select(F.col("event_id").alias("g_id"), F.col("s").alias("g_s"), F.col("value").alias("g_value"))
    good = (F.col("g_value") > 5) & (F.col("g_value") <= 60)
    return joins.nearest(left, right, "event_id", "s", "g_s", 1800.0, ["g_id"], keep=good).select("event_id", "g_id", "g_value")


@query("""a AS (SELECT m.event_id, g.event_id AS g_id, g.value AS g_value, row_number() OVER (PARTITION BY m.event_id ORDER BY g.ts DESC) AS q FROM m LEFT JOIN m AS g ON g.station = 'view' AND g.channel = m.channel AND g.ts <= m.ts WHERE m.station = 'purchase')
SELECT event_id, g_id, g_value FROM a WHERE q = 1""")
def backward_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    left = m.where("station = 'purchase'").select("event_id", "channel", "ts")
    right = m.where("station = 'view'").select("channel", F.col("ts").alias("g_ts"), F.col("event_id").alias("g_id"), F.col("value").alias("g_value"))
    return joins.backward(left, right, ["channel"], "ts", "g_ts", ["g_id", "g_value"]).select("event_id", "g_id", "g_value")


@query("""SELECT e.event_id, count(*) AS n, round(avg(x.value), 6) AS mean FROM m AS e JOIN m AS x ON x.station = 'view' AND x.s BETWEEN e.s - 1800 AND e.s + 1800 WHERE e.station = 'signup' AND e.value > 50 GROUP BY e.event_id""")
def around_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    events = m.where("station = 'signup' and value > 50").select("event_id", F.col("s").alias("e_s"))
    samples = m.where("station = 'view'").select("s", "value")
    return joins.within(events, samples, "e_s", "s", 1800.0).groupBy("event_id").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("SELECT CASE WHEN k >= 0 AND k < 30 THEN 'quiet' WHEN k >= 30 AND k < 50 THEN 'unsettled' WHEN k >= 50 AND k < 90 THEN 'storm' END AS bin, count(*) AS n, round(avg(value), 6) AS mean, round(corr(k, value), 6) AS correlation FROM m GROUP BY 1")
def activity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.in_bins(measurements(spark, sf_dir), "k", [(0, 30, "quiet"), (30, 50, "unsettled"), (50, 90, "storm")])
    return rows.groupBy("bin").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.corr("k", "value")).alias("correlation"))


@query("""a AS (SELECT date_trunc('day', ts) AS day, station, avg(value) AS v FROM m GROUP BY 1, 2)
SELECT strftime(a.day, '%Y-%m-%d') AS day, a.station AS a, b.station AS b, round(a.v - b.v, 6) AS difference, abs(a.v - b.v) > 5 AS disagree FROM a JOIN a AS b ON a.day = b.day AND a.station < b.station""")
def station_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = measurements(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "station").agg(F.avg("value").alias("v"))
    out = joins.key_pairs(means, ["day"], "station", "v")
    return out.withColumns({"disagree": F.abs("difference") > 5, "difference": r(F.col("difference"))})


@query("""b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS b), t AS (SELECT DISTINCT station FROM m)
SELECT t.station, strftime(b.b, '%Y-%m-%d %H:%M') AS bucket, count(m.event_id) AS n FROM t CROSS JOIN b LEFT JOIN m ON m.station = t.station AND date_trunc('hour', m.ts) = b.b GROUP BY 1, 2""")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.spined(measurements(spark, sf_dir), ["station"], "ts", "hour", "2024-01-01", "2024-01-31")
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


@query("SELECT DISTINCT CAST(date_trunc('hour', ts) AS VARCHAR)[:13] AS hour FROM m WHERE station = 'view' AND date_trunc('hour', ts) IN (SELECT date_trunc('hour', ts) FROM m WHERE station = 'purchase')")
def hours_with_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select("station", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    return m.where("station = 'view'").join(m.where("station = 'purchase'"), "hour", "left_semi").select("hour").distinct()


@query("SELECT count(*) AS n FROM (SELECT DISTINCT channel, date_trunc('day', ts) AS d FROM m WHERE station = 'click') AS a WHERE NOT EXISTS (SELECT 1 FROM m WHERE station = 'error' AND m.channel = a.channel AND date_trunc('day', m.ts) = a.d)")
def not_yet_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select("station", "channel", F.to_date("ts").alias("d"))
    done = m.where("station = 'error'").select("channel", "d")
    return m.where("station = 'click'").select("channel", "d").distinct().join(done, ["channel", "d"], "left_anti").agg(F.count("*").alias("n"))


@query("""a AS (SELECT date_trunc('hour', ts) AS h, channel, ts, event_id, value FROM m WHERE station = 'view'),
b AS (SELECT date_trunc('hour', ts) AS h, channel, arg_max(value, (ts, event_id)) AS late FROM m WHERE station = 'click' GROUP BY 1, 2)
SELECT a.event_id, round(coalesce(b.late, a.value), 6) AS value, CASE WHEN b.late IS NULL THEN 'L1' ELSE 'L2' END AS level FROM a LEFT JOIN b USING (h, channel)""")
def layered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts"))
    fine = m.where("station = 'view'").select("h", "channel", "event_id", "value")
    out = joins.merged_layers(fine, m.where("station = 'click'"), ["h", "channel"], ORDER, ["value"])
    return out.select("event_id", r(F.coalesce("value_late", "value")).alias("value"), F.when(F.col("value_late").isNull(), "L1").otherwise("L2").alias("level"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, arg_max(value, (ts, event_id)) FILTER (station = 'view') AS long, arg_max(value, (ts, event_id)) FILTER (station = 'click') AS short FROM m GROUP BY 1 HAVING count(*) FILTER (station = 'view') > 0""")
def two_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    band = lambda s: F.max_by(F.when(F.col("station") == s, F.col("value")), F.when(F.col("station") == s, F.struct("ts", "event_id")))
    return m.groupBy("hour").agg(band("view").alias("long"), band("click").alias("short")).where("long is not null")


@query("SELECT station, event_id, q AS rank FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts DESC, event_id DESC) AS q FROM m) AS x WHERE q <= 20")
def newest_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty of each day first, so that no task sorts a whole station."""
    newest = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))
    rows = measurements(spark, sf_dir).select("station", "ts", "event_id").withColumn("day", F.to_date("ts"))
    few = rows.withColumn("rank", newest("station", "day")).where("rank <= 20")
    return few.withColumn("rank", newest("station")).where("rank <= 20").select("station", "event_id", "rank")


@query("""d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, channel, station FROM m), a AS (SELECT day, channel FROM d WHERE station = 'view'), b AS (SELECT day, channel FROM d WHERE station = 'click')
SELECT 'both' AS side, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) AS x UNION ALL SELECT 'first', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) AS y UNION ALL SELECT 'second', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) AS z""")
def channel_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select("station", F.date_format("ts", "yyyy-MM-dd").alias("day"), "channel")
    a, b = (m.where(F.col("station") == s).select("day", "channel").distinct() for s in ("view", "click"))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "day", "channel")
    return side(a.intersect(b), "both").union(side(a.subtract(b), "first")).union(side(b.subtract(a), "second"))


@query("""a AS (SELECT event_id, snr, 0.5 AS u1, snr / 10.0 AS u2, k / 50.0 AS u3, confidence FROM m), b AS (SELECT *, sqrt(u1 * u1 + u2 * u2 + u3 * u3) AS u FROM a),
c AS (SELECT *, u * u * u * u / nullif(u1 * u1 * u1 * u1 / 10 + u2 * u2 * u2 * u2 / 5, 0) AS dof, CASE WHEN 2 * u < 1 THEN 'A' WHEN 2 * u < 2 THEN 'B' WHEN 2 * u < 3 THEN 'C' ELSE 'D' END AS g FROM b)
SELECT event_id, round(u, 6) AS combined, round(dof, 4) AS dof, g AS grade, CASE WHEN confidence < 0.5 OR g = 'D' THEN 'BAD' WHEN g = 'C' OR confidence < 0.7 THEN 'MARGINAL' ELSE 'GOOD' END AS flag FROM c""")
def uncertainty_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumns({"u1": F.lit(0.5), "u2": F.col("snr") / 10.0, "u3": F.col("k") / 50.0})
    m = m.withColumn("u", quality.root_sum_square(F.col("u1"), F.col("u2"), F.col("u3")))
    dof = quality.effective_dof([(F.col("u1"), F.lit(10.0)), (F.col("u2"), F.lit(5.0)), (F.col("u3"), None)])
    m = m.withColumn("g", quality.uncertainty_grade(2 * F.col("u")))
    return m.select("event_id", r(F.col("u")).alias("combined"), r(dof, 4).alias("dof"), F.col("g").alias("grade"), quality.quality_flag(F.col("g"), F.col("confidence"), F.lit(True)).alias("flag"))


EVENTS = catalog.Product(
    "events",
    (
        catalog.Field("ts", "timestamp", required=True),
        catalog.Field("station", "string", required=True, allowed=("view", "click", "purchase", "error")),
        catalog.Field("value", "float", low=0.0, high=200.0, allow_nan=False),
        catalog.Field("k", "integer", low=0, high=89),
        catalog.Field("note", "string"),
    ),
)


@query("""p AS (SELECT unnest(list_filter([CASE WHEN station NOT IN ('view', 'click', 'purchase', 'error') THEN 'station is not allowed' END, CASE WHEN value > 200 THEN 'value is too high' END, CASE WHEN k > 89 THEN 'k is too high' END], lambda x: x IS NOT NULL)) AS problem FROM m)
SELECT problem, count(*) AS n FROM p GROUP BY problem""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = EVENTS.judged(measurements(spark, sf_dir).withColumn("channel", F.col("channel").cast("string")))
    return judged.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("""a AS (SELECT date_trunc('day', ts) AS day, count(*) AS size FROM m GROUP BY 1), b AS (SELECT day, sum(size) OVER (ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS held FROM a)
SELECT strftime(day, '%Y-%m-%d') AS day, held FROM b WHERE held > 3000""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = measurements(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("size"))
    return catalog.evicted(days, "day", "size", 3000).select("day", "held")


@query("""a AS (SELECT event_id, channel, ts, (event_id * 7919) % 65536 AS q FROM m), b AS (SELECT event_id, (q - lag(q) OVER (PARTITION BY channel ORDER BY ts, event_id) + 32768) % 65536 AS d FROM a)
SELECT event_id, (CASE WHEN d < 0 THEN d + 65536 ELSE d END) - 32768 AS step, (CASE WHEN d < 0 THEN d + 65536 ELSE d END) - 32768 > 1 AS gap FROM b WHERE d IS NOT NULL""")
def packet_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions import timing

    m = measurements(spark, sf_dir).withColumn("q", F.pmod(F.col("event_id") * 7919, F.lit(65536)))
    step = timing.counter_delta(F.col("q"), F.lag("q").over(Window.partitionBy("channel").orderBy(*ORDER)), bits=16)
    return m.withColumn("step", step).where("step is not null").select("event_id", "step", (F.col("step") > 1).alias("gap"))


@query()
def kalman_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock filter over each channel's rows: recursive, so no SQL tells the same; tests hold it against streams."""
    from tidewright.streaming import state

    m = measurements(spark, sf_dir).select("channel", F.col("s").alias("at"), F.col("value").alias("measured"), F.col("snr").cast("double").alias("snr"))
    return state.tracks(m, ["channel"])


def _geometry(sql: str, name: str):
    """As ``query``, without the measurements."""

    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


_PLACES = "p AS (SELECT n_nationkey AS k, n_nationkey * 6.5 - 80 AS lat1, n_nationkey * 13.0 - 170 AS lon1, 40.0 AS lat2, -105.0 AS lon2, n_nationkey * 3.5 + 1 AS el FROM nation)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("k"), (k * 6.5 - 80).alias("lat1"), (k * 13.0 - 170).alias("lon1"), F.lit(40.0).alias("lat2"), F.lit(-105.0).alias("lon2"), (k * 3.5 + 1).alias("el"))


@_geometry(f"""WITH {_PLACES}, h AS (SELECT *, sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2 AS h FROM p), d AS (SELECT *, 2 * 6371.0 * asin(sqrt(least(h, 1.0))) AS d FROM h),
n AS (SELECT *, greatest(CAST(ceil(d / (2 * 6371.0 * acos(6371.0 / 6671.0))) AS INTEGER), 1) AS n FROM d)
SELECT k, round(d, 4) AS km, n AS hops, round(sqrt(6371.0 ** 2 + 6671.0 ** 2 - 2 * 6371.0 * 6671.0 * cos(d / (2 * n * 6371.0))) * 2 * n, 4) AS path_km, round(least(1 / sqrt(1 - (6371.0 * cos(radians(greatest(el, 3.0))) / 6721.0) ** 2), 10.0), 6) AS obliquity,
  round(40.3 * 20 * 1e16 * CASE WHEN el > 5 THEN 1 / sin(radians(el)) ELSE 5.0 END / (299792458.0 * 1e7 * 1e7) * 2 * n * 1000, 6) AS delay_ms FROM n""", "path_geometry")
def path_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions import geometry as g

    p = _places(spark, sf_dir).withColumn("km", g.great_circle_km(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]))
    p = p.withColumn("hops", g.hops_needed(F.col("km"), F.lit(300.0)))
    path = g.hop_path_km(F.col("km"), F.lit(300.0), F.col("hops"))
    delay = g.group_delay_ms(F.lit(20.0), F.lit(10.0), F.col("hops"), F.col("el"))
    return p.select("k", r(F.col("km"), 4).alias("km"), "hops", r(path, 4).alias("path_km"), r(g.obliquity(F.col("el"))).alias("obliquity"), r(delay).alias("delay_ms"))


@_geometry(f"""WITH {_PLACES}, e AS (SELECT k, el, k * 4.0 - 40 AS sun FROM p), f AS (SELECT *, CASE WHEN sun <= -18 THEN 3.0 WHEN sun <= 0 THEN 3.0 + (sun + 18) / 18 * (10.9 * 0.6 - 3.0) ELSE greatest(10.9 * greatest(sin(radians(sun)), 0.01) ** 0.25, 3.0) END AS f2 FROM e)
SELECT k, round(f2, 6) AS f2, round(CASE WHEN sun <= 0 THEN 0.5 ELSE greatest(0.9 * ((180 + 1.44 * 70) * greatest(sin(radians(sun)), 0)) ** 0.25, 0.5) END, 6) AS e,
  round(CASE WHEN el <= 0 OR el >= 89 THEN f2 ELSE f2 * least(sqrt(1 + 600.0 / 6371.0) / greatest(sin(radians(el)), 0.05), 4.5) END, 6) AS muf FROM f""", "layer_frequencies")
def layer_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.functions import geometry as g

    p = _places(spark, sf_dir).withColumn("sun", F.col("k") * 4.0 - 40)
    p = p.withColumn("f2", g.f2_critical_mhz(F.col("sun")))
    return p.select("k", r(F.col("f2")).alias("f2"), r(g.e_critical_mhz(F.col("sun"))).alias("e"), r(g.oblique_muf_mhz(F.col("f2"), F.col("el"))).alias("muf"))


@_geometry("SELECT vec_id, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]) / len(embedding), 6) AS power, len(embedding) AS n FROM embeddings", "array_power")
def array_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators import kernels

    return table(spark, sf_dir, "embeddings").select("vec_id", r(kernels.power(F.col("embedding"))).alias("power"), F.size("embedding").cast("long").alias("n"))


@_geometry("""SELECT c_mktsegment AS segment, n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1, 2""", "fact_dimensions")
def fact_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts joined to two dimensions and kept where a child row exists; AQE picks each join by the sizes it measures."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    kept = orders.join(large, "o_orderkey", "left_semi").join(customers, "o_custkey").join(nations, "n_nationkey")
    return kept.groupBy("segment", "nation").agg(F.count("*").alias("orders"), r(F.sum("o_totalprice"), 2).alias("total"), r(F.avg("o_totalprice"), 4).alias("mean"))
