"""Joint solutions over the measurement stream, the fusion cycle that they enter, packets in order, the authority of an hour, maps, time frames, waves and carrier phases, each with SQL of its own making.

A station is at a fixed distance; its first row of an hour is the hour's arrival,
which came late by the clock's error, by one of the paths over that distance and by
a little that its value gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import student, timecode
from tidewright.operators import authority, carrier, maps, reports, solve, waves
from tidewright.plans.measurements import measurements, query, r
from tidewright.streaming import resequence

DAY = 86_400.0
#: Distances in km.
DISTANCES = {"click": 900.0, "signup": 1700.0, "view": 2600.0, "purchase": 3500.0, "error": 6600.0}

_DISTANCES = ", ".join(f"('{name}', {km})" for name, km in DISTANCES.items())
_CHORD = "2 * hops * sqrt((6371.0 + h) ** 2 - (6371.0 * cos(d / (2 * hops * 6371.0))) ** 2) / 299.792458"
#: a: arrivals (h, station, t); o: their possible paths (h, station, i, c, mode, hops, delay, p, t).
_ARRIVALS = f"""s(station, d) AS (VALUES {_DISTANCES}),
w(mode, hops, h, low, high, c) AS (VALUES ('1E', 1, 110.0, 0, 2000, 0), ('1F', 1, 300.0, 0, 4000, 1), ('2F', 2, 300.0, 1500, 8000, 2), ('3F', 3, 300.0, 4000, 1e9, 3)),
y AS (SELECT station, mode, hops, {_CHORD} AS delay, row_number() OVER (PARTITION BY station ORDER BY c) AS c, count(*) OVER (PARTITION BY station) AS many,
  CAST(CASE mode WHEN '1E' THEN CASE WHEN d < 1500 THEN 1.0 ELSE 0.7 END WHEN '1F' THEN CASE WHEN d < 3000 THEN 1.0 ELSE 0.8 END WHEN '2F' THEN CASE WHEN d > 3000 THEN 0.8 ELSE 0.5 END ELSE 0.7 END AS DOUBLE) AS p FROM s, w WHERE d > low AND d < high),
b AS (SELECT date_trunc('hour', ts) AS h, station, arg_min(value, (ts, event_id)) AS value, arg_min(k, (ts, event_id)) AS k FROM m WHERE value IS NOT NULL GROUP BY 1, 2),
a AS (SELECT h, b.station, 5.0 + 0.002 * value + y.delay AS t FROM b JOIN y ON y.station = b.station AND y.c = 1 + b.k % y.many),
o AS (SELECT h, a.station, dense_rank() OVER (PARTITION BY h ORDER BY a.station) AS i, c, mode, hops, delay, p, t FROM a JOIN y ON y.station = a.station)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour (counted from 1970), station, timing and modes."""
    m = measurements(spark, sf_dir).where("value is not null").withColumn("hour", F.floor(F.col("s") / 3600))
    first = m.groupBy("hour", "station").agg(F.min_by(F.struct("value", "k"), F.struct("ts", "event_id")).alias("_f"))
    distance = F.coalesce(*[F.when(F.col("station") == name, km) for name, km in DISTANCES.items()])
    rows = first.where(distance.isNotNull()).withColumn("modes", solve.path_modes(distance))
    came = F.get("modes", (F.col("_f.k") % F.size("modes")).cast("int"))
    return rows.select("hour", "station", (5.0 + 0.002 * F.col("_f.value") + came["delay"]).alias("timing"), "modes")


_GLOBAL = f"""{_ARRIVALS}, z AS (SELECT h, max(i) AS n FROM o GROUP BY h HAVING max(i) > 1),
e(h, i, cs, es, p, err) AS (SELECT h, 1, [c], [t - delay], p, [mode] FROM o WHERE i = 1 AND h IN (SELECT h FROM z)
  UNION ALL SELECT e.h, o.i, list_append(e.cs, o.c), list_append(e.es, o.t - o.delay), e.p * o.p, list_append(e.err, o.mode) FROM e JOIN o ON o.h = e.h AND o.i = e.i + 1),
f AS (SELECT e.*, z.n, sqrt(list_sum(flatten([[(es[x] - es[v]) ** 2 FOR v IN range(x + 1, z.n + 1)] FOR x IN range(1, z.n)])) / (z.n * (z.n - 1) / 2)) AS rms FROM e JOIN z ON z.h = e.h AND z.n = e.i),
g AS (SELECT *, 0.9 * CASE WHEN rms < 0.05 THEN 1.0 WHEN rms < 0.2 THEN 0.9 - rms WHEN rms < 0.5 THEN 0.5 - rms * 0.5 ELSE 0.1 / (1 + rms * 2) END + 0.1 * p AS score FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY round(score, 12) DESC, cs) AS place FROM g),
u AS (SELECT *, list_avg(es) AS clock_error, rms / sqrt(n * (n - 1) / 2) AS uncertainty, CASE WHEN rms < 0.5 THEN 1.0 WHEN rms < 1 THEN 0.8 WHEN rms < 2 THEN 0.5 ELSE 0.2 END AS cs_, CAST(epoch(h) / 3600 AS BIGINT) AS hour FROM q WHERE place = 1),
x AS (SELECT *, least(1.0, score * cs_ * least(2.0, 1 + 0.1 * n) / 2) AS confidence, CASE WHEN uncertainty < 0.5 AND cs_ > 0.8 AND n >= 3 THEN 'A' WHEN uncertainty < 1 AND cs_ > 0.5 THEN 'B' WHEN uncertainty < 2 THEN 'C' ELSE 'D' END AS grade FROM u)"""


@query(f"""RECURSIVE_ {_GLOBAL} SELECT hour, n, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs, round(clock_error, 6) AS clock_error, round(rms, 6) AS rms, round(score, 6) AS score, round(confidence, 6) AS confidence,
  cs_ > 0.5 AS verified, grade, list_aggregate(err, 'string_agg', ' ') AS modes FROM x""")
def global_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock's error of each hour from all stations at once; the SQL tries every assignment of paths."""
    out = solve.global_solution(_arrivals(spark, sf_dir), ["hour"], "station", "timing", "modes").where("n > 1")
    names = F.array_join(F.transform("assignments", lambda a: a["mode"]), " ")
    return out.select("hour", "n", "pairs", *[r(F.col(c)).alias(c) for c in ("clock_error", "rms", "score", "confidence")], "verified", "grade", names.alias("modes"))


@query(f"""{_ARRIVALS},
j AS (SELECT CAST(epoch(x.h) / 3600 AS BIGINT) AS hour, x.station AS a, y.station AS b, x.mode AS mode_a, y.mode AS mode_b, x.t - y.t AS observed, x.delay - y.delay AS expected, x.t - x.delay AS ea, y.t - y.delay AS eb,
  x.p * y.p * CASE abs(x.hops - y.hops) WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.7 END AS p, x.c AS ca, y.c AS cb FROM o AS x JOIN o AS y ON x.h = y.h AND x.station < y.station),
k AS (SELECT *, p * CASE WHEN abs(observed - expected) > 2 THEN 0.1 WHEN abs(observed - expected) > 1 THEN 0.4 WHEN abs(observed - expected) > 0.5 THEN 0.7 ELSE 1.0 END AS score FROM j),
l AS (SELECT *, row_number() OVER v AS place, lead(expected) OVER v AS next FROM k WINDOW v AS (PARTITION BY hour, a, b ORDER BY score DESC, ca, cb)),
n AS (SELECT *, abs(ea - eb) AS agreement, score * least(1.0, coalesce(abs(expected - next), 10.0) / 0.5) AS sure FROM l WHERE place = 1)
SELECT hour, a, b, mode_a, mode_b, round(observed, 6) AS observed, round(CASE WHEN agreement < 1 THEN (ea + eb) / 2 ELSE ea END, 6) AS clock_error, agreement < 1 AS verified,
  round(CASE WHEN agreement < 1 THEN least(1.0, sure * 1.3) WHEN agreement < 2 THEN sure * 0.7 ELSE sure * 0.3 END, 6) AS confidence FROM n""")
def station_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock's error from each two stations of an hour."""
    out = solve.pair_solutions(_arrivals(spark, sf_dir), ["hour"], "station", "timing", "modes")
    return out.select("hour", "a", "b", "mode_a", "mode_b", r(F.col("observed")).alias("observed"), r(F.col("clock_error")).alias("clock_error"), "verified", r(F.col("confidence")).alias("confidence"))


_FUSE = f"""{_GLOBAL},
w0 AS (SELECT CAST(floor(s / 3600) AS BIGINT) AS hour, station, mhz, 5.0 + 0.02 * value AS v, CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.9 WHEN 'C' THEN 0.7 ELSE 0.5 END
    * CASE mode WHEN '1E' THEN 1.0 WHEN '1F' THEN 0.95 WHEN '2F' THEN 0.85 ELSE 0.7 END / greatest(0.1, 10 ** (-(snr - 10) / 20)) ** 2 AS w FROM m WHERE value IS NOT NULL AND NOT isnan(value) AND k % 5 = 0
  UNION ALL SELECT hour, 'GLOBAL', NULL, clock_error, greatest(10.0, 100 * confidence) FROM x WHERE cs_ > 0.5),
w1 AS (SELECT hour, station, mhz, v, greatest(w, 0.01) AS w FROM w0),
md AS (SELECT hour, median(v) AS med, count(*) AS n FROM w1 GROUP BY 1), w2 AS (SELECT w1.*, med, n, abs(v - med) AS off FROM w1 JOIN md USING (hour)),
bd AS (SELECT hour, least(100.0, 3.5 * least(greatest(1.4826 * median(off), 0.5), 5.0)) AS bound, min(off) AS least_off FROM w2 GROUP BY 1),
ga AS (SELECT w2.* FROM w2 JOIN bd USING (hour) WHERE n <= 2 OR off < bound OR least_off >= bound),
mu AS (SELECT hour, sum(w * v) / sum(w) AS raw FROM ga GROUP BY 1),
pe AS (SELECT hour, max(x) - min(x) AS agreement FROM (SELECT hour, station, sum(w * v) / sum(w) AS x FROM ga WHERE station <> 'GLOBAL' GROUP BY 1, 2) AS t GROUP BY 1),
fu AS (SELECT hour, any_value(n) AS n, count(*) AS used, count(DISTINCT station) FILTER (station <> 'GLOBAL') AS sources, count(DISTINCT (station, mhz)) FILTER (station <> 'GLOBAL') AS broadcasts, any_value(raw) AS raw,
  greatest(sqrt(1 / sum(w)), sqrt(sum(w * (v - raw) ** 2) / sum(w))) AS u FROM ga JOIN mu USING (hour) GROUP BY hour),
lo AS (SELECT fu.*, agreement, sources >= 2 AND broadcasts >= 2 AS locked FROM fu LEFT JOIN pe USING (hour)),
la AS (SELECT *, max(CASE WHEN locked THEN hour END) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS lh FROM lo),
ho AS (SELECT a.*, NOT a.locked AND a.lh IS NOT NULL AS coasting, coalesce(b.raw, a.raw) AS held, CASE WHEN a.locked THEN a.u ELSE least(coalesce(sqrt(b.u ** 2 + (0.001 * 60 * (a.hour - a.lh)) ** 2), 1.0), 2 * a.u, 10.0) END AS uncertainty
  FROM la AS a LEFT JOIN lo AS b ON b.hour = a.lh),
ju AS (SELECT *, lag(held) OVER (ORDER BY hour) AS before FROM ho)
SELECT hour, n, used, sources, broadcasts, round(agreement, 7) AS agreement, round(raw, 7) AS raw, round(uncertainty, 7) AS uncertainty, locked, coasting, coalesce(abs(held - before) > 5, false) AS jumped,
  round(CASE WHEN abs(held - before) > 5 THEN before ELSE held END, 7) AS fused, CASE WHEN NOT locked THEN 'D' WHEN uncertainty <= 1 THEN 'A' WHEN uncertainty <= 2 THEN 'B' WHEN uncertainty <= 5 THEN 'C' ELSE 'D' END AS grade FROM ju"""


@query(f"RECURSIVE_ {_FUSE}")
def fusion_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fused clock error for each hour, with the hour's verified joint solution as an anchor of its own."""
    m = measurements(spark, sf_dir).where("k % 5 = 0")
    sigma = F.greatest(F.lit(0.1), F.pow(F.lit(10.0), -(F.col("snr") - 10) / 20))
    rows = m.select(F.floor(F.col("s") / 3600).alias("hour"), "station", F.struct("station", "mhz").alias("broadcast"), (5.0 + 0.02 * F.col("value")).alias("v"), reports.variance_weight(sigma, F.col("grade"), F.col("mode")).alias("w"))
    solutions = solve.global_solution(_arrivals(spark, sf_dir), ["hour"], "station", "timing", "modes")
    out = reports.fusion_cycle(solve.anchored(rows, solutions, "hour", "station", "broadcast", "v", "w"), "hour", "station", "broadcast", "v", "w", minutes=60.0, anchor="GLOBAL")
    return out.withColumns({c: r(F.col(c), 7) for c in ("agreement", "raw", "uncertainty", "fused")})


@query("""p AS (SELECT station, event_id AS id, event_id // 4000 AS part, (event_id // 8) * 64 + (k + event_id) % 8 * 8 + event_id % 8 AS came FROM m),
f AS (SELECT station, part, arg_min(id, came) AS first FROM p GROUP BY 1, 2), q AS (SELECT p.* FROM p JOIN f USING (station, part) WHERE id >= first),
g AS (SELECT *, lag(id) OVER (PARTITION BY station, part ORDER BY id) AS before, min(id) OVER (PARTITION BY station, part) AS zero, dense_rank() OVER (PARTITION BY station ORDER BY part) - 1 AS session FROM q)
SELECT station, session, id - zero AS place, id AS event_id, coalesce(id - before - 1, 0) AS gap_packets, coalesce((id - before - 1) * 400, 0) AS gap_samples FROM g""")
def packets_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as packets of their station's stream that came shuffled, with wrapping counters and a restart every 4,000: in order, with the gaps."""
    m = measurements(spark, sf_dir).select("station", "event_id", "k")
    came = F.floor(F.col("event_id") / 8) * 64 + (F.col("k") + F.col("event_id")) % 8 * 8 + F.col("event_id") % 8
    at = F.pmod(F.col("event_id") * 400 + F.floor(F.col("event_id") / 4000) * 10_000_000 + 4_294_000_000, F.lit(1 << 32))
    rows = m.select("station", "event_id", came.alias("came"), F.pmod(F.col("event_id") + 60_000, F.lit(65_536)).alias("sequence"), at.alias("timestamp"))
    out = resequence.resequenced(rows, ["station"], ["came"], F.floor(F.col("came") / 80_000), "sequence", "timestamp")
    return out.select("station", "session", "place", "event_id", "gap_packets", "gap_samples")


_LEVELS = """r AS (SELECT CAST(floor(s / 3600) AS BIGINT) AS hour, station, avg(value) AS x, coalesce(stddev_samp(value), 0) AS u, count(*) AS n FROM m WHERE station IN ('click', 'view', 'purchase', 'signup') AND value IS NOT NULL GROUP BY 1, 2),
lv(station, level, rank, trust) AS (VALUES ('click', 'T6', 1, 1.0), ('view', 'T5', 2, 1.0), ('purchase', 'T3', 4, 1.0), ('signup', 'T2', 5, 20.0)),
t AS (SELECT DISTINCT hour FROM r), b AS (SELECT hour, row_number() OVER (ORDER BY hour) AS tick FROM t),
p AS (SELECT hour, tick, level, rank, trust, coalesce(n >= 3, false) AS up, CASE WHEN n >= 3 THEN x END AS x, u / 4 AS u, level IN ('T6', 'T5', 'T3') AS rtp FROM b CROSS JOIN lv LEFT JOIN r USING (hour, station)),
i AS (SELECT *, tick - max(CASE WHEN up THEN 0 ELSE tick END) OVER (PARTITION BY level ORDER BY tick ROWS UNBOUNDED PRECEDING) AS streak FROM p),
a AS (SELECT hour, tick, arg_min(level, rank) FILTER (up AND streak >= 3) AS active FROM i GROUP BY 1, 2),
w AS (SELECT a.hour, x.level AS la, y.level AS lw, y.rank, y.x AS wx, y.u AS wu, abs(x.x - y.x) AS d, abs(x.x - y.x) > greatest(3 * sqrt(x.u * x.u + y.u * y.u), CASE WHEN x.level || y.level IN ('T6T5', 'T5T6', 'T3T2', 'T2T3') THEN 5.0 ELSE 0 END) AS off,
  x.level IN ('T6', 'T5') AND NOT y.rtp AS advice FROM a JOIN i AS x ON x.hour = a.hour AND x.level = a.active JOIN i AS y ON y.hour = a.hour AND y.level <> a.active AND y.up),
h AS (SELECT * FROM w WHERE off AND NOT advice),
q AS (SELECT hour, count(*) AS n, arg_min(lw, rank) AS heir, max(d) AS worst FROM h GROUP BY 1),
z AS (SELECT DISTINCT x.hour FROM h AS x JOIN h AS y ON x.hour = y.hour AND x.lw < y.lw WHERE abs(x.wx - y.wx) > greatest(3 * sqrt(x.wu * x.wu + y.wu * y.wu), CASE WHEN x.lw || y.lw IN ('T6T5', 'T5T6', 'T3T2', 'T2T3') THEN 5.0 ELSE 0 END)),
c AS (SELECT a.hour, a.active AS was, coalesce(q.n >= 2 AND z.hour IS NULL, false) AS outvoted, q.heir, q.worst FROM a LEFT JOIN q USING (hour) LEFT JOIN z USING (hour)),
o AS (SELECT hour, was, outvoted, CASE WHEN outvoted THEN heir ELSE was END AS active, CASE WHEN NOT outvoted THEN worst END AS worst FROM c),
s AS (SELECT o.*, i.x, i.u, CASE WHEN active IN ('T6', 'T3') THEN CAST(round(i.x * 1e6) AS BIGINT) WHEN active IS NOT NULL THEN 0 END AS offset_ns,
  CASE WHEN active IN ('T6', 'T3') THEN CAST(round(i.u * 1e6) AS BIGINT) WHEN active IS NOT NULL THEN CAST(i.trust * 1e6 AS BIGINT) END AS own FROM o LEFT JOIN i ON i.hour = o.hour AND i.level = o.active)"""


@query(f"""{_LEVELS} SELECT hour, active, outvoted, offset_ns, CASE WHEN ceil(worst * 1e6) > own THEN CAST(ceil(worst * 1e6) AS BIGINT) ELSE own END AS sigma_ns FROM s""")
def authority_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of four levels is in charge each hour: there with three rows or more, for three hours."""
    level = F.coalesce(*[F.when(F.col("station") == name, of) for name, of in (("click", "T6"), ("view", "T5"), ("purchase", "T3"), ("signup", "T2"))])
    m = measurements(spark, sf_dir).where(F.col("station").isin("click", "view", "purchase", "signup") & F.col("value").isNotNull())
    hours = m.groupBy(F.floor(F.col("s") / 3600).alias("at"), level.alias("level")).agg(F.avg("value").alias("offset"), (F.coalesce(F.stddev_samp("value"), F.lit(0.0)) / 4).alias("sigma"), F.count("*").alias("n"))
    probes = hours.select(F.lit("unit").alias("unit"), "at", "level", (F.col("n") >= 3).alias("available"), "offset", "sigma", F.when(F.col("level") == "T2", "sysclock").otherwise("rtp").alias("frame"))
    picked = authority.picked(authority.ticks(probes, ["unit"], "at"), ["unit"], "at", F.floor(F.col("at") / 24))
    out = authority.decided(picked)
    return out.select(F.col("at").alias("hour"), "active", F.exists("flags", lambda f: f.startswith("majority")).alias("outvoted"), "offset_ns", "sigma_ns")


_HULLS = """p AS (SELECT DISTINCT CAST(floor(s / 3600) AS BIGINT) AS h, k % 40 AS x, k % 11 AS y FROM m),
c AS (SELECT a.h, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, (b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x) AS side, (o.x - a.x) * (o.x - b.x) + (o.y - a.y) * (o.y - b.y) AS beyond
  FROM p AS a JOIN p AS b ON a.h = b.h AND (a.x <> b.x OR a.y <> b.y) JOIN p AS o ON o.h = a.h),
e AS (SELECT h, ax, ay, bx, by_ FROM c GROUP BY ALL HAVING min(side) >= 0 AND max(side) > 0 AND max(CASE WHEN side = 0 THEN beyond ELSE 0 END) <= 0)"""


@query(f"""{_HULLS}, g AS (SELECT i * 5 AS gx, j * 2 AS gy FROM range(0, 8) AS t(i), range(0, 6) AS u(j)),
i AS (SELECT h, gx, gy, min((bx - ax) * (gy - ay) - (by_ - ay) * (gx - ax)) >= 0 AS inside FROM e CROSS JOIN g GROUP BY 1, 2, 3),
n AS (SELECT h, count(*) AS corners, sum(ax * by_ - bx * ay) / 2 AS area FROM e GROUP BY 1)
SELECT h AS hour, corners, round(CAST(area AS DOUBLE), 4) AS area, CAST(sum(CASE WHEN inside THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM n JOIN i USING (h) GROUP BY ALL""")
def hull_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and area of each hour's hull over signal and confidence, and how many cells of a grid it holds."""
    m = measurements(spark, sf_dir).select(F.floor(F.col("s") / 3600).alias("hour"), (F.col("k") % 40).alias("x"), (F.col("k") % 11).alias("y"))
    hulls = maps.convex_hulls(m, ["hour"], "x", "y").where("hull is not null")
    ends = F.concat(F.slice("hull", 2, 1_000_000), F.slice("hull", 1, 1))
    area = F.aggregate(F.zip_with("hull", ends, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda t, v: t + v) / 2
    grid = F.array(*[F.struct(F.lit(5.0 * i).alias("x"), F.lit(2.0 * j).alias("y")) for i in range(8) for j in range(6)])
    cells = F.size(F.filter(grid, lambda g: maps.in_hull(g["x"], g["y"], F.col("hull"))))
    return hulls.select("hour", F.size("hull").cast("long").alias("corners"), r(area, 4).alias("area"), cells.cast("long").alias("cells"))


@query("""p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, (k % 40) / 4.0 AS x, (k % 11) / 2.0 AS y, value AS v FROM m WHERE value IS NOT NULL),
c AS (SELECT day, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), q AS (SELECT p.day, n, cx, cy, x - cx AS a, y - cy AS o, v, 100.0::DOUBLE AS w FROM p JOIN c USING (day)),
s AS (SELECT day, any_value(n) AS n, any_value(cx) AS cx, any_value(cy) AS cy, sum(w) AS s0, sum(w * a) AS sa, sum(w * o) AS so, 1.01 * sum(w * a * a) AS aa, sum(w * a * o) AS ao, 1.01 * sum(w * o * o) AS oo, sum(w * v) AS v0, sum(w * a * v) AS va, sum(w * o * v) AS vo FROM q GROUP BY 1),
d AS (SELECT *, s0 * (aa * oo - ao * ao) - sa * (sa * oo - ao * so) + so * (sa * ao - aa * so) AS det FROM s),
k AS (SELECT day, n, cx, cy, (v0 * (aa * oo - ao * ao) - sa * (va * oo - ao * vo) + so * (va * ao - aa * vo)) / det AS c0, (s0 * (va * oo - ao * vo) - v0 * (sa * oo - ao * so) + so * (sa * vo - va * so)) / det AS ca,
  (s0 * (aa * vo - va * ao) - sa * (sa * vo - va * so) + v0 * (sa * ao - aa * so)) / det AS co FROM d)
SELECT k.day, any_value(k.n) AS n, round(any_value(c0), 5) AS level, round(any_value(ca), 5) AS by_x, round(any_value(co), 5) AS by_y, round(sqrt(avg((v - c0 - ca * a - co * o) ** 2)), 5) AS rms FROM q JOIN k USING (day) GROUP BY 1""")
def daily_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn-in plane through each day's values over signal and confidence; the SQL solves it by determinants."""
    rows = measurements(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("k") % 40 / 4.0).alias("x"), (F.col("k") % 11 / 2.0).alias("y"), "value", F.lit(0.0).alias("sigma"))
    c = F.col("coefficients")
    return maps.content_maps(rows, ["day"], "x", "y", "value", "sigma", degree=1).select("day", "n", r(c[0], 5).alias("level"), r(c[2], 5).alias("by_x"), r(c[1], 5).alias("by_y"), r(F.col("rms"), 5).alias("rms"))


@query("""SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, CASE WHEN event_id % 47 BETWEEN 13 AND 46 AND event_id % 47 NOT IN (19, 29, 39) THEN 1 ELSE 0 END AS parity_errors,
  CASE WHEN event_id % 47 < 13 THEN 1 ELSE 0 END AS sync_errors, k % 4 AS saving, k % 64 AS next_code, event_id % 47 = 19 AS lsb_differs FROM m""")
def time_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's minute as a time frame with one of its first 47 bits flipped, and what is read from it."""
    flip = (F.col("event_id") % 47).cast("int")
    frame = timecode.encoded_frame(F.floor("s"), F.col("k") % 4, F.lit(0), F.col("k") % 64)
    bit = F.when(F.substring(F.col("f"), flip + 1, F.lit(1)) == "0", "1").otherwise("0")
    broken = F.concat(F.substring(F.col("f"), F.lit(1), flip), bit, F.substring(F.col("f"), flip + 2, F.lit(60)))
    rows = measurements(spark, sf_dir).select("event_id", "s", "k").withColumn("f", frame).select("event_id", timecode.time_frame(broken).alias("t"))
    return rows.select("event_id", F.date_format("t.minute", "yyyy-MM-dd HH:mm").alias("minute"), "t.parity_errors", "t.sync_errors", "t.saving", "t.next_code", "t.lsb_differs")


@query("""z AS (SELECT station, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CASE WHEN max(value) > min(value) AND max(snr) > min(snr) THEN corr(value, snr) END AS r FROM m WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CAST(n - 2 AS BIGINT) AS f, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) AS a FROM z WHERE n > 3 AND r IS NOT NULL),
s AS (SELECT station, day, n, r, f, a, CASE WHEN f % 2 = 0 THEN sin(a) * (1 + coalesce(list_sum([exp(list_sum([ln((2 * i - 1) / (2e0 * i)) FOR i IN range(1, j + 1)])) * cos(a) ** (2 * j) FOR j IN range(1, f // 2)]), 0))
  ELSE 2 / pi() * (a + sin(a) * coalesce(list_sum([cos(a) ** (2 * j + 1) * CASE WHEN j = 0 THEN 1e0 ELSE exp(list_sum([ln(2e0 * i / (2 * i + 1)) FOR i IN range(1, j + 1)])) END FOR j IN range(0, (f - 1) // 2)]), 0)) END AS inside FROM t)
SELECT station, day, n, round(r, 6) AS r, round(least(1.0, 5 * (1 - inside)), 6) AS p, 5 * (1 - inside) < 0.05 AS sure FROM s""")
def signal_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each station's values go with its signal on each day, and how likely that is by chance, given that five stations are looked at; the SQL has the finite sums of whole degrees of freedom."""
    found = measurements(spark, sf_dir).where("value is not null").groupBy("station", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.covar_pop("value", "snr").alias("_c"), F.stddev_pop("value").alias("_a"), F.stddev_pop("snr").alias("_b"))
    found = found.where("n > 3").withColumn("r", F.try_divide("_c", F.nullif(F.col("_a") * F.col("_b"), F.lit(0.0)))).where("r is not null")
    told = found.withColumn("_p", student.correlation_p(F.col("r"), F.col("n").cast("double"), 5))
    return told.select("station", "day", "n", r(F.col("r")).alias("r"), r(F.col("_p")).alias("p"), (F.col("_p") < 0.05).alias("sure"))


@query("""v AS (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, station, arg_min(s, (ts, event_id)) AS t FROM m GROUP BY 1, 2),
w(station, x, y) AS (VALUES ('click', 0.0, 0.0), ('signup', 300.0, 40.0), ('view', -120.0, 410.0), ('purchase', 10.0, 5.0), ('error', 500.0, -350.0)),
q AS (SELECT a.hour, wa.x - wb.x AS x, wa.y - wb.y AS y, a.t - b.t AS t FROM v AS a JOIN v AS b ON a.hour = b.hour AND a.station < b.station JOIN w AS wa ON wa.station = a.station JOIN w AS wb ON wb.station = b.station WHERE (wa.x - wb.x) ** 2 + (wa.y - wb.y) ** 2 >= 2500),
c AS (SELECT hour, count(*) AS n, avg(x * x) AS xx, avg(x * y) AS xy, avg(y * y) AS yy, avg(x * t) AS xt, avg(y * t) AS yt FROM q GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS sx, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS sy FROM c WHERE xx * yy - xy * xy > 1e-9 * (xx + yy) ** 2)
SELECT hour, n AS baselines, round(1000 / sqrt(sx * sx + sy * sy), 4) AS speed, round((degrees(atan2(sx, sy)) + 360) % 360, 4) AS bearing FROM d""")
def wave_velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane wave that fits an hour's first arrivals at five places best, from all baselines between them."""
    spots = {"click": (0.0, 0.0), "signup": (300.0, 40.0), "view": (-120.0, 410.0), "purchase": (10.0, 5.0), "error": (500.0, -350.0)}
    place = F.coalesce(*[F.when(F.col("station") == n, F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))) for n, (x, y) in spots.items()])
    first = measurements(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "station").agg(F.min_by("s", F.struct("ts", "event_id")).alias("t")).withColumn("at", place)
    a, b = (first.select("hour", *[F.col(c).alias(c + side) for c in ("station", "t", "at")]) for side in "ab")
    pairs = a.join(b, "hour").where("stationa < stationb").select("hour", (F.col("ata.x") - F.col("atb.x")).alias("dx"), (F.col("ata.y") - F.col("atb.y")).alias("dy"), (F.col("ta") - F.col("tb")).alias("lag"))
    out = waves.wave_velocity(pairs, ["hour"], "dx", "dy", "lag").where("speed is not null")
    return out.select("hour", "baselines", r(F.col("speed"), 4).alias("speed"), r(F.col("bearing"), 4).alias("bearing"))


@query("""p AS (SELECT station, s, min(k / 100.0::DOUBLE * 2 * pi() - pi()) AS p FROM m GROUP BY 1, 2), q AS (SELECT *, s - lag(s) OVER w AS dt, p - lag(p) OVER w AS turn FROM p WINDOW w AS (PARTITION BY station ORDER BY s)),
r AS (SELECT *, turn - 2 * pi() * floor(turn / (2 * pi()) + 0.5) AS step FROM q), h AS (SELECT *, step / (2 * pi() * dt) AS hz FROM r),
t AS (SELECT *, CASE WHEN dt > 7200 THEN 'gap' WHEN NOT coalesce(lag(dt) OVER w > 7200, false) AND abs(hz - lag(hz) OVER w) / dt > 1e-6 THEN 'slip' WHEN abs(step) > pi() / 2 THEN 'jump' END AS event FROM h WINDOW w AS (PARTITION BY station ORDER BY s)),
u AS (SELECT *, CASE WHEN event IN ('gap', 'slip') THEN 0 ELSE coalesce(step, 0) END AS go, CASE WHEN event IN ('gap', 'slip') THEN 1 ELSE 0 END AS cut FROM t),
v AS (SELECT *, sum(go) OVER w AS total, CAST(sum(cut) OVER w AS BIGINT) AS segment FROM u WINDOW w AS (PARTITION BY station ORDER BY s))
SELECT station, round(s, 3) AS at, event, segment, round(-(299792458.0 * 10e6) / (2 * pi() * 40.3e16) * total, 9) + 0e0 AS content FROM v""")
def carrier_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content from each station's phases, with its slips, gaps and jumps."""
    rows = measurements(spark, sf_dir).select("station", "s", (F.col("k") / 100.0 * 2 * F.pi() - F.pi()).alias("phase"), F.lit(10.0).alias("mhz"))
    out = carrier.relative_content(rows, ["station"], "s", "phase", "mhz", F.floor(F.col("s") / DAY), slip_hz_s=1e-6, longest_gap=7200.0)
    return out.select("station", r(F.col("s"), 3).alias("at"), "event", "segment", r(F.col("content"), 9).alias("content"))


QUERIES = {f.__name__: f for f in (global_solutions, station_pairs, fusion_cycle, packets_in_order, authority_hours, hull_cells, daily_planes, time_frames, signal_significance, wave_velocities, carrier_content)}
