"""Joins by time and order: last-wins, nearest and backward as-of, intervals, pairs, spines and anti joins.

Time joins meet on buckets of the time that are as long as the reach, each row
in its own bucket and the neighbours', so that they stay equi-joins of bounded
fan-out whatever the length of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; one aggregation, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, *rest)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one that comes last by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[f"_b.{c}" for c in rest])


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[f"_b.{c}" for c in rest])


def nearest(left: DataFrame, right: DataFrame, left_id: str, left_s: str, right_s: str, reach: float, ties: list[str], keys: list[str] = [], keep: Column | None = None) -> DataFrame:  # noqa: B006
    """``left`` with the columns of the ``right`` row nearest in time within ``reach`` seconds, of equal ``keys``; nulls where there is none.

    Of equally near ones the first by ``ties``. ``keep`` is tested after the choice, so
    a nearest row that fails gives nulls, not the next one.

    No pairs are formed: each bucket's rows of both sides are put in order once each way,
    and ``right`` sends the ends of its buckets, two rows a bucket, to the neighbours.
    """
    cols = [c for c in right.columns if c not in keys]
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).isNotNull()
    bucket = lambda c: F.floor(F.col(c) / reach).alias("_bucket")
    told = right.where(met & finite(right_s)).select(*keys, bucket(right_s), F.col(right_s).alias("_at"), F.struct(*ties).alias("_ties"), F.struct(*cols).alias("_told"))
    one = F.struct("_at", "_ties", "_told")
    ends = told.groupBy(*keys, "_bucket").agg(F.min_by(one, F.struct("_at", "_ties")).alias("_first"), F.min_by(one, F.struct(-F.col("_at"), "_ties")).alias("_last"))
    sent = F.inline(F.array(F.struct((F.col("_bucket") - 1).alias("_bucket"), "_first"), F.struct((F.col("_bucket") + 1).alias("_bucket"), F.col("_last").alias("_first"))))
    given = told.unionByName(ends.select(*keys, sent).select(*keys, "_bucket", "_first.*"))
    asks = left.where(met & finite(left_s) & F.col(left_id).isNotNull()).select(*keys, bucket(left_s), F.col(left_s).alias("_at"), F.col(left_id).alias("_id"))
    both = asks.unionByName(given, allowMissingColumns=True).withColumn("_asks", F.col("_told").isNull())
    # The last one seen of a run of equal times is the first by the ties.
    seen = lambda at: F.last(F.when(~F.col("_asks"), one), ignorenulls=True).over(Window.partitionBy(*keys, "_bucket").orderBy(at, "_asks", F.desc("_ties")).rowsBetween(Window.unboundedPreceding, 0))
    sides = both.withColumns({"_before": seen(F.asc("_at")), "_after": seen(F.desc("_at"))}).where("_asks")
    near = F.explode(F.array("_before", "_after")).alias("_n")
    far = F.abs(F.col("_n._at") - F.col("_at"))
    best = F.min_by("_n._told", F.struct(far, "_n._ties"))
    chosen = sides.select("_id", "_at", near).where(far <= reach).groupBy(F.col("_id").alias(left_id)).agg(best.alias("_b"))
    out = left.join(chosen, left_id, "left")
    good = F.lit(True) if keep is None else keep
    return out.select(*left.columns, *[F.col(f"_b.{c}").alias(c) for c in cols]).withColumns({c: F.when(good, F.col(c)) for c in cols} if keep is not None else {})


def backward(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """``left`` with the latest ``right`` values at or before its time, of equal ``keys``; one sort of both together, no pairs."""
    struct = F.struct(F.col(right_at).alias("_right_at"), *values)
    a = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(struct).schema[0].dataType).alias("_value"))
    b = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), struct.alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values], F.col("_last._right_at").alias("matched_at"))


def within(events: DataFrame, samples: DataFrame, event_s: str, sample_s: str, reach: float) -> DataFrame:
    """Pairs of an event and a sample at most ``reach`` seconds apart."""
    spread = events.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(event_s) / reach) - 1, F.floor(F.col(event_s) / reach) + 1)))
    held = samples.withColumn("_bucket", F.floor(F.col(sample_s) / reach))
    return spread.join(held, "_bucket").where(F.abs(F.col(sample_s) - F.col(event_s)) <= reach).drop("_bucket")


def in_bins(rows: DataFrame, value: str, bins: list[tuple[float, float, str]], out: str = "bin") -> DataFrame:
    """``rows`` with the label of the bin [low, high) that holds the value; a fixed number of bins is a CASE, not a join."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(bins):
        label = F.when((F.col(value) >= low) & (F.col(value) < high), name).otherwise(label)
    return rows.withColumn(out, label)


def key_pairs(rows: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Per key, all pairs of names in order with the difference of their values. Names per key are few by nature, as stations are."""
    a = rows.select(*keys, F.col(name).alias("a"), F.col(value).alias("_va"))
    b = rows.select(*keys, F.col(name).alias("b"), F.col(value).alias("_vb"))
    return a.join(b, keys).where("a < b").select(*keys, "a", "b", (F.col("_va") - F.col("_vb")).alias("difference"))


def spined(rows: DataFrame, keys: list[str], at: str, unit: str, start: str, end: str) -> DataFrame:
    """Counts per key and time bucket from ``start`` to ``end`` (exclusive), empty buckets included."""
    counts = rows.groupBy(*keys, F.date_trunc(unit, at).alias("bucket")).agg(F.count("*").alias("n"))
    step = F.expr(f"interval 1 {unit}")
    buckets = F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp") - step, step))
    names = rows.select(*keys).distinct().withColumn("bucket", buckets)
    return names.join(counts, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def merged_layers(fine: DataFrame, coarse: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``fine`` left-joined with the last coarse row of each key: the later product's values where it has them."""
    latest = last_wins(coarse.select(*keys, *order, *values), keys, order).drop(*order)
    return fine.join(latest.withColumnsRenamed({v: f"{v}_late" for v in values}), keys, "left")
