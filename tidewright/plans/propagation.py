"""Queries on propagation paths and station agreement over the measurement stream of ``plans.measurements``, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import geometry
from tidewright.operators import joins, paths
from tidewright.plans.measurements import measurements, query, r

#: Combinations of station and frequency that a query takes.
ALLOWED = [("click", 2.5), ("click", 5.0), ("view", 5.0), ("view", 10.0), ("purchase", 15.0)]


@query("SELECT event_id, station, mhz, value FROM m WHERE (station, mhz) IN (('click', 2.5), ('click', 5.0), ('view', 5.0), ('view', 10.0), ('purchase', 15.0))")
def listed_broadcasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.listed_only(measurements(spark, sf_dir), ALLOWED, ["station", "mhz"]).select("event_id", "station", "mhz", "value")


@query("""d AS (SELECT *, row_number() OVER (PARTITION BY station, mhz ORDER BY ts, event_id) - 1 AS i FROM m WHERE snr >= 10)
SELECT event_id, station, mhz, round(value, 6) AS value FROM d WHERE i % 5 = 0""")
def thinned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = paths.downsampled(measurements(spark, sf_dir).where("snr >= 10"), ["station", "mhz"], ["ts", "event_id"], 5)
    return thin.select("event_id", "station", "mhz", r(F.col("value")).alias("value"))


@query("SELECT station, k % 4 AS rank, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS deviation FROM m WHERE least(snr, 40) >= 5 GROUP BY 1, 2")
def arrival_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).where(F.least("snr", F.lit(40)) >= 5)
    return rows.groupBy("station", (F.col("k") % 4).alias("rank")).agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("deviation"))


@query("""a AS (SELECT date_trunc('hour', ts) AS h, median(value) AS v, median(snr) AS q FROM m WHERE k % 4 = 0 GROUP BY 1), b AS (SELECT date_trunc('hour', ts) AS h, median(value) AS v, median(snr) AS q FROM m WHERE k % 4 > 0 GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, round(b.v - a.v, 6) AS delay_ms, round(299.792458 * (b.v - a.v) / 2, 4) AS height_km FROM a JOIN b USING (h)
WHERE b.v - a.v >= 2 AND least(a.q, b.q) >= 10 AND 299.792458 * (b.v - a.v) / 2 > 100 AND 299.792458 * (b.v - a.v) / 2 < 6000""")
def layer_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the first and of the later arrivals per hour in one aggregation; the height that their distance means."""
    first = F.col("k") % 4 == 0
    middle = lambda c, which: F.median(F.when(which, F.col(c)))
    hours = measurements(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(
        middle("value", first).alias("a"), middle("value", ~first).alias("b"), middle("snr", first).alias("qa"), middle("snr", ~first).alias("qb")
    )
    apart, height = F.col("b") - F.col("a"), F.lit(299.792458) * (F.col("b") - F.col("a")) / 2
    kept = hours.where((apart >= 2) & (F.least("qa", "qb") >= 10) & (height > 100) & (height < 6000))
    return kept.select("hour", r(apart).alias("delay_ms"), r(height, 4).alias("height_km"))


@query("""t AS (SELECT date_trunc('hour', ts) AS h, station, count(*) AS ticks, avg(value) AS v FROM m WHERE confidence >= 0.3 GROUP BY 1, 2),
p AS (SELECT date_trunc('hour', ts) AS h, station, median(snr) AS q FROM m WHERE mode <> 'x' GROUP BY 1, 2),
w AS (SELECT date_trunc('hour', ts) AS h, station, arg_max(mode, (ts, event_id)) AS mode FROM m WHERE grade IN ('A', 'B') GROUP BY 1, 2)
SELECT strftime(t.h, '%Y-%m-%d %H') AS hour, t.station, ticks, round(v, 6) AS value, round(q, 6) AS snr, coalesce(mode, 'UNKNOWN') AS mode FROM t LEFT JOIN p USING (h, station) LEFT JOIN w USING (h, station)""")
def mode_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three products per hour and station: ticks, the median signal of their phases and the last credible mode; one shuffle, as all have the same keys."""
    rows = measurements(spark, sf_dir)
    good = F.when(F.col("grade").isin("A", "B"), F.struct("ts", "event_id"))
    out = rows.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "station").agg(
        F.count(F.when(F.col("confidence") >= 0.3, 1)).alias("ticks"), r(F.avg(F.when(F.col("confidence") >= 0.3, F.col("value")))).alias("value"),
        r(F.median(F.when(F.col("mode") != "x", F.col("snr")))).alias("snr"), F.coalesce(F.max_by("mode", good), F.lit("UNKNOWN")).alias("mode"),
    )
    return out.where("ticks > 0")


@query("""a AS (SELECT hour(ts) AS hour, mhz, station, arg_max(value, (ts, event_id)) AS v FROM m WHERE station IN ('click', 'view') GROUP BY 1, 2, 3)
SELECT x.hour, x.mhz, round(x.v, 6) AS first_value, round(y.v, 6) AS second_value, round(x.v - y.v, 6) AS difference FROM a AS x JOIN a AS y ON x.hour = y.hour AND x.mhz = y.mhz AND x.station = 'click' AND y.station = 'view'""")
def paired_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of two stations for each hour of the day and frequency, side by side."""
    rows = measurements(spark, sf_dir).where(F.col("station").isin("click", "view")).withColumn("hour", F.hour("ts"))
    last = joins.last_wins(rows.select("hour", "mhz", "station", "ts", "event_id", "value"), ["hour", "mhz", "station"], ["ts", "event_id"])
    pair = last.groupBy("hour", "mhz").agg(F.max(F.when(F.col("station") == "click", F.col("value"))).alias("a"), F.max(F.when(F.col("station") == "view", F.col("value"))).alias("b"))
    return pair.where("a is not null and b is not null").select("hour", "mhz", r(F.col("a")).alias("first_value"), r(F.col("b")).alias("second_value"), r(F.col("a") - F.col("b")).alias("difference"))


def _line_sql() -> str:
    by, out, source = "WINDOW p AS (PARTITION BY station, day)", [], "e"
    for i in range(3):
        out.append(f"""a{i} AS (SELECT *, sum(w * x) OVER p / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my, count(*) OVER p AS n FROM {source} {by}),
b{i} AS (SELECT *, sum(w * (x - mx) * (y - my)) OVER p / nullif(sum(w * (x - mx) * (x - mx)) OVER p, 0) AS sl FROM a{i} {by}),
c{i} AS (SELECT *, y - my - sl * (x - mx) AS e FROM b{i}),
d{i} AS (SELECT *, sqrt(sum(w * e * e) OVER p / sum(w) OVER p) AS rms, row_number() OVER (PARTITION BY station, day ORDER BY round(abs(e), 9) DESC, event_id) AS place FROM c{i} {by}),
e{i} AS (SELECT event_id, station, day, x, y, w FROM d{i} WHERE NOT coalesce(place = 1 AND n >= 4 AND abs(e) > 3.0 * rms, false))""")
        source = f"e{i}"
    return f"""e AS (SELECT event_id, station, strftime(ts, '%Y-%m-%d') AS day, 100.0 / (mhz * mhz) AS x, value AS y, 1.0 + confidence AS w FROM m WHERE value IS NOT NULL), {", ".join(out)},
f AS (SELECT *, sum(w * x) OVER p / sum(w) OVER p AS mx, sum(w * y) OVER p / sum(w) OVER p AS my FROM e2 {by})
SELECT station, day, count(*) AS n, round(sum(w * (x - mx) * (y - my)) / nullif(sum(w * (x - mx) * (x - mx)), 0), 5) AS slope FROM f GROUP BY 1, 2"""


@query(_line_sql())
def robust_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    x = 100.0 / (F.col("mhz") * F.col("mhz"))
    return paths.robust_line(rows, ["station", "day"], "event_id", x, F.col("value"), 1.0 + F.col("confidence")).select("station", "day", "n", r(F.col("slope"), 5).alias("slope"))


@query("""g AS (SELECT station, mhz, CAST(floor(s / 86400) AS BIGINT) AS day, median(value) AS med, count(*) AS n, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM m WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT station, mhz, day, round(med, 6) AS median, n, round(CASE WHEN n = 1 THEN 1.0 ELSE greatest((b - a) / 1.35, 0.1) END, 6) AS sigma FROM g""")
def frequency_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).withColumn("day", F.floor(F.col("s") / 86400))
    return paths.frequency_points(rows, ["station", "day"], "mhz", "value").select("station", "mhz", "day", r(F.col("median")).alias("median"), "n", r(F.col("sigma")).alias("sigma"))


_PAIR = """h AS (SELECT CAST(floor(s / 3600) AS BIGINT) AS step, avg(CASE WHEN station = 'click' THEN value END) AS a, avg(CASE WHEN station = 'view' THEN value END) AS b FROM m GROUP BY 1),
l AS (SELECT t.lag, x.a, y.b FROM h AS x CROSS JOIN (SELECT unnest(range(-6, 7)) AS lag) AS t JOIN h AS y ON y.step = x.step + t.lag WHERE x.a IS NOT NULL AND y.b IS NOT NULL),
c AS (SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, corr(a, b) AS r FROM l GROUP BY 1 HAVING count(*) >= 3)"""


def _hourly_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    station = lambda name: F.avg(F.when(F.col("station") == name, F.col("value")))
    steps = measurements(spark, sf_dir).groupBy(F.floor(F.col("s") / 3600).alias("step")).agg(station("click").alias("a"), station("view").alias("b"))
    return paths.lagged_correlation(steps, [], "step", "a", "b", 6)


@query(f"{_PAIR} SELECT lag, n, round(r, 6) AS r FROM c")
def lagged_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly_pair(spark, sf_dir).select("lag", "n", r(F.col("r")).alias("r"))


@query(f"{_PAIR} SELECT lag, n, round(r, 6) AS r FROM c WHERE NOT isnan(r) ORDER BY round(abs(r), 9) DESC, n DESC, lag LIMIT 1")
def best_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.best_delay(_hourly_pair(spark, sf_dir), []).select("lag", "n", r(F.col("r")).alias("r"))


@query("""w AS (SELECT station, CAST(floor(s / 43200) AS BIGINT) AS win, (s - floor(s / 43200) * 43200) / 3600 AS x, value AS y FROM m WHERE value IS NOT NULL),
l AS (SELECT station, win, regr_slope(y, x) AS a, regr_intercept(y, x) AS c, count(*) AS n FROM w GROUP BY 1, 2), e AS (SELECT station, win, y - a * x - c AS e FROM w JOIN l USING (station, win) WHERE n >= 5),
d AS (SELECT station, win, median(e) AS mid FROM e GROUP BY 1, 2), k AS (SELECT station, win, 1.4826 * median(abs(e - mid)) AS s FROM e JOIN d USING (station, win) GROUP BY 1, 2)
SELECT station, round(median(s), 5) AS floor, count(*) AS windows FROM k GROUP BY 1""")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).where("value is not null").withColumn("win", F.floor(F.col("s") / 43200))
    rows = rows.select("station", "win", ((F.col("s") - F.col("win") * 43200) / 3600).alias("x"), F.col("value").alias("y"))
    return paths.noise_floor(rows, ["station"], "win", "x", "y").select("station", r(F.col("floor"), 5).alias("floor"), "windows")


@query("""b AS (SELECT station, floor(value / 1.25) AS bin, count(*) AS n FROM m WHERE value >= -25 AND value <= 225 GROUP BY 1, 2), t AS (SELECT station, sum(n) AS total FROM b GROUP BY 1),
p AS (SELECT CAST(i AS INTEGER) AS point, i * 10.0 AS place FROM range(0, 21) AS r(i))
SELECT station, point, place, round(sum(n * exp(-pow((place - (bin + 0.5) * 1.25) / 5, 2) / 2)) / (any_value(total) * 5 * sqrt(2 * pi())), 9) AS density FROM b JOIN t USING (station) CROSS JOIN p GROUP BY 1, 2, 3""")
def value_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.density(measurements(spark, sf_dir), ["station"], "value", 0.0, 200.0, 20, 5.0).select("station", "point", F.col("at").alias("place"), r(F.col("density"), 9).alias("density"))


@query("""g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 1 + (k % 7) / 10.0 AS a, 1 + (k % 5) / 5.0 AS b, value AS y FROM m WHERE value IS NOT NULL),
s AS (SELECT day, count(*) AS n, sum(a * a) + 0.01 AS aa, sum(b * b) + 0.01 AS bb, sum(a * b) AS ab, sum(a * y) + 0.05 AS ay, sum(b * y) + 0.2 AS vy FROM g GROUP BY 1)
SELECT day, n, round(greatest((bb * ay - ab * vy) / (aa * bb - ab * ab), 0), 5) AS t1, round(greatest((aa * vy - ab * ay) / (aa * bb - ab * ab), 0), 5) AS t2 FROM s""")
def two_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = measurements(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (1 + (k % 7) / 10.0).alias("a"), (1 + (k % 5) / 5.0).alias("b"), "value")
    return paths.two_shells(rows, ["day"], "a", "b", "value", 5.0, 20.0).select("day", "n", r(F.col("t1"), 5).alias("t1"), r(F.col("t2"), 5).alias("t2"))


@query("""w AS (SELECT station, CAST(floor(s / 600) AS BIGINT) AS w, avg(snr) AS q, count(*) AS n, min(value) AS lo, max(value) AS hi, count(*) FILTER (grade = 'A') AS na FROM m GROUP BY 1, 2),
h AS (SELECT station, w // 6 AS hour, count(*) AS windows, avg(q) AS mean_snr, min(lo) AS low, max(hi) AS high, coalesce(stddev_pop(q), 0) AS deviation, regr_slope(q, w % 6) AS trend, sum(na) / sum(n) AS share FROM w GROUP BY 1, 2)
SELECT station, hour, windows, round(mean_snr, 6) AS mean_snr, round(low, 6) AS low, round(high, 6) AS high, round(deviation, 6) AS deviation, CASE WHEN windows > 1 THEN round(trend, 6) END AS trend, round(share, 6) AS share_a FROM h""")
def rolled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short windows, then their roll-up by the hour: two aggregations whose first one leaves little to shuffle."""
    w = F.floor(F.col("s") / 600)
    short = measurements(spark, sf_dir).groupBy("station", w.alias("w")).agg(
        F.avg("snr").alias("q"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.when(F.col("grade") == "A", 1)).alias("na")
    )
    out = short.groupBy("station", F.floor(F.col("w") / 6).alias("hour")).agg(
        F.count("*").alias("windows"), r(F.avg("q")).alias("mean_snr"), r(F.min("lo")).alias("low"), r(F.max("hi")).alias("high"), r(F.stddev_pop("q")).alias("deviation"),
        r(F.regr_slope("q", F.col("w") % 6)).alias("trend"), r(F.sum("na") / F.sum("n")).alias("share_a"),
    )
    return out.withColumn("trend", F.when(F.col("windows") > 1, F.col("trend")))


@query("""d AS (SELECT channel, ts, event_id, mode, lag(mode) OVER (PARTITION BY channel ORDER BY ts, event_id) AS before FROM m)
SELECT channel, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS times FROM d WHERE before IN ('1F', '2F') AND mode = '1E' GROUP BY 1""")
def layer_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("mode").over(Window.partitionBy("channel").orderBy("ts", "event_id"))
    moved = measurements(spark, sf_dir).withColumn("before", before).where(F.col("before").isin("1F", "2F") & (F.col("mode") == "1E"))
    return moved.groupBy("channel").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.count("*").alias("times"))


@query("""v AS (SELECT date_trunc('hour', ts) AS h, station, avg(value) AS x, coalesce(stddev_pop(value), 0) AS u FROM m GROUP BY 1, 2), c AS (SELECT h, avg(x) AS mid, count(*) AS n FROM v GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, any_value(n) AS witnesses, count(*) FILTER (round(abs(x - mid), 6) > round(greatest(0.5 * u, 20.0), 6)) AS against, count(*) FILTER (round(abs(x - mid), 6) > round(greatest(0.5 * u, 20.0), 6)) > any_value(n) / 2 AS outvoted FROM v JOIN c USING (h) GROUP BY h""")
def majority_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stations are far from the mean of their hour, and whether these are the majority."""
    hour = F.date_format("ts", "yyyy-MM-dd HH").alias("hour")
    means = measurements(spark, sf_dir).groupBy(hour, "station").agg(F.avg("value").alias("x"), F.stddev_pop("value").alias("u"))
    told = means.withColumn("mid", F.avg("x").over(Window.partitionBy("hour")))
    against = F.count(F.when(r(F.abs(F.col("x") - F.col("mid"))) > r(F.greatest(0.5 * F.col("u"), F.lit(20.0))), 1))
    return told.groupBy("hour").agg(F.count("*").alias("witnesses"), against.alias("against"), (against > F.count("*") / 2).alias("outvoted"))


@query("""v AS (SELECT strftime(ts, '%Y-%m-%d') AS day, station, avg(value) AS x, coalesce(stddev_pop(value), 0) / sqrt(count(*)) AS u FROM m GROUP BY 1, 2)
SELECT a.day, a.station AS a, b.station AS b, round(a.x - b.x, 6) AS difference, abs(a.x - b.x) > greatest(3 * sqrt(a.u * a.u + b.u * b.u), 0.5) AS flagged FROM v AS a JOIN v AS b ON a.day = b.day AND a.station < b.station""")
def pair_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two stations of a day differ by more than three times what their uncertainties allow. Stations are few, so pairs are too."""
    means = measurements(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "station").agg(F.avg("value").alias("x"), (F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("u"))
    a, b = (means.select("day", F.col("station").alias(n), F.col("x").alias(f"x{n}"), F.col("u").alias(f"u{n}")) for n in "ab")
    apart, bound = F.col("xa") - F.col("xb"), F.greatest(3 * F.sqrt(F.col("ua") * F.col("ua") + F.col("ub") * F.col("ub")), F.lit(0.5))
    return a.join(b, "day").where("a < b").select("day", "a", "b", r(apart).alias("difference"), (F.abs(apart) > bound).alias("flagged"))


@query("""t AS (SELECT mode AS told, CASE WHEN value < 20 THEN '1F' WHEN value < 50 THEN '2F' WHEN value < 100 THEN '1E' ELSE 'x' END AS truth FROM m WHERE value IS NOT NULL)
SELECT told, truth, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM t GROUP BY 1, 2""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    truth = F.when(v < 20, "1F").when(v < 50, "2F").when(v < 100, "1E").otherwise("x")
    counts = measurements(spark, sf_dir).where(v.isNotNull()).groupBy(F.col("mode").alias("told"), truth.alias("truth")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy("truth"))))


@query("""z AS (SELECT event_id, 1 / (1 + exp(-(0.05 * snr + 1.5 * confidence - 1.8))) AS p FROM m)
SELECT event_id, round(p, 6) AS p, round(abs(2 * p - 1), 6) AS margin, round(-(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2), 6) AS entropy, CASE WHEN abs(2 * p - 1) < 0.2 THEN 'uncertain' WHEN p >= 0.5 THEN 'first' ELSE 'second' END AS label FROM z""")
def discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model's label, margin and entropy for each row."""
    p = F.col("_p")
    rows = measurements(spark, sf_dir).withColumn("_p", 1 / (1 + F.exp(-(0.05 * F.col("snr") + 1.5 * F.col("confidence") - 1.8))))
    margin = F.abs(2 * p - 1)
    entropy = -(p * F.log(p) + (1 - p) * F.log(1 - p)) / F.log(F.lit(2.0))
    label = F.when(margin < 0.2, "uncertain").when(p >= 0.5, "first").otherwise("second")
    return rows.select("event_id", r(p).alias("p"), r(margin).alias("margin"), r(entropy).alias("entropy"), label.alias("label"))


@query("""e AS (SELECT event_id, 500.0 + k * 150.0 AS d, value FROM m), c AS (SELECT event_id, value, l.name AS layer, l.height AS height, n, 2 * n * sqrt(6371.0 ** 2 + (6371.0 + l.height) ** 2 - 2 * 6371.0 * (6371.0 + l.height) * cos(d / (2 * n * 6371.0))) / 299.792458 AS ms
  FROM e CROSS JOIN (SELECT unnest(range(1, 5)) AS n) CROSS JOIN (VALUES ('E', 110.0), ('F', 300.0)) AS l(name, height) WHERE d / (2 * n * 6371.0) < acos(6371.0 / (6371.0 + l.height)))
SELECT event_id, arg_min(n || layer, (round(abs(ms - value), 9), n, layer)) AS mode, round(min(abs(ms - value)), 6) AS apart FROM c WHERE value IS NOT NULL GROUP BY event_id""")
def identified_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the paths of one to four hops by two layers that reach over the distance, the one whose delay is nearest to that measured."""
    distance = 500.0 + F.col("k") * 150.0
    layers = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(name).alias("layer"), F.lit(height).alias("height")) for n in range(1, 5) for name, height in (("E", 110.0), ("F", 300.0))]))
    rows = measurements(spark, sf_dir).where("value is not null").select("event_id", "value", distance.alias("d"), layers.alias("_l")).select("event_id", "value", "d", "_l.*")
    reach = F.col("d") / (2 * F.col("n") * 6371.0) < F.acos(F.lit(6371.0) / (6371.0 + F.col("height")))
    ms = geometry.hop_path_km(F.col("d"), F.col("height"), F.col("n")) / 299.792458
    rows = rows.where(reach).withColumn("_off", F.abs(ms - F.col("value")))
    best = F.min_by(F.concat(F.col("n").cast("string"), "layer"), F.struct(F.round("_off", 9), "n", "layer"))
    return rows.groupBy("event_id").agg(best.alias("mode"), r(F.min("_off")).alias("apart"))


def surface_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of a quadratic surface of the values over signal and confidence, for each station; the systems are solved outside SQL."""
    rows = measurements(spark, sf_dir).select("station", (F.col("snr") / 40.0).alias("x"), F.col("confidence").alias("y"), "value", F.lit(1.0).alias("w"))
    fitted = paths.ridge_surface(rows, ["station"], "x", "y", "value", "w")
    return fitted.select("station", "n", *[F.round(F.col("coefficients")[i], 4).alias(f"c{i}") for i in range(6)])


QUERIES = {f.__name__: f for f in (
    listed_broadcasts, thinned_series, arrival_ranks, layer_heights, mode_timeline, paired_stations, robust_dispersion, frequency_medians, lagged_correlations, best_delay, noise_floor,
    value_density, two_shells, rolled_windows, layer_transitions, majority_votes, pair_checks, confusion, discrimination, identified_modes, surface_fits,
)}
