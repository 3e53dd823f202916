"""Toxicity severity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, free_name, stash

_WORD = re.compile(r"[^\W\d_]+")

#: Word beginnings of these lengths are features beside whole words: insults are inflected.
PREFIXES = (4, 5, 6)


def features(text: str | None) -> set[str]:
    """The distinct words of the whole text, lower-cased, as ``=word``, and their beginnings as ``4:begi``."""
    found = set(_WORD.findall(text.lower())) if text else set()
    return {"=" + w for w in found}.union(*({f"{n}:{w[:n]}" for w in found if len(w) >= n} for n in PREFIXES))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= j) = sigmoid(thresholds[j] - sum of the weights of the features present)."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """The probability of each grade, a row per score."""
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - np.array(self.thresholds)[None, :], -60, 60)))
        return np.diff(np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))]), axis=1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, k: int, n_grades: int, l2: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (shared by all thresholds) and rising thresholds that maximise the penalised likelihood, by Adam.

    ``rows`` and ``cols`` list the ones of a 0/1 matrix with ``k`` columns.
    """
    w, theta = np.zeros(k), np.zeros(n_grades - 1)
    share = np.array([np.mean(y <= j) for j in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta[0], theta[1:] = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    at = np.concatenate([w, theta])
    m, v = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, steps + 1):
        w, theta = at[:k], at[k:]
        gaps = np.exp(theta[1:])
        cut = theta[0] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(rows, weights=w[cols], minlength=len(y))
        ends = np.concatenate([[-np.inf], cut, [np.inf]])
        high, low = (1 / (1 + np.exp(-np.clip(ends[y + i] - s, -60, 60))) for i in (1, 0))
        high, low = np.where(y == n_grades - 1, 1.0, high), np.where(y == 0, 0.0, low)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        ds = (d_high - d_low) / len(y)  # of the negative log likelihood by s
        d_cut = np.array([-(d_high[y == j].sum() - d_low[y == j + 1].sum()) for j in range(n_grades - 1)]) / len(y)
        d_theta = np.concatenate([[d_cut.sum()], [d_cut[j + 1 :].sum() * gaps[j] for j in range(len(gaps))]])
        g = np.concatenate([np.bincount(cols, weights=ds[rows], minlength=k) + l2 * w, d_theta])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return at[:k], at[k] + np.concatenate([[0], np.cumsum(np.exp(at[k + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, most_features: int = 2_000, least_docs: int = 5, least_ratio: float = 24.0, flush_at: int = 100_000) -> OrdinalModel | None:
    """Fit on at most ``most_rows`` labelled rows: those whose id hashes lowest.

    The labels are 0 and 1. Clean rows get grade 0, toxic rows grade 1, 2 or 3
    by how many marker words they hold (thirds of the training rows); the marker
    words of a row are told from the other half of the rows alone, so that no row
    has a part in its own grade. Features are those that occur in at least
    ``least_docs`` rows and in toxic ones so often that the log-likelihood ratio
    is ``least_ratio`` or more: few of a million features get there by chance.
    Equal texts count once. None where no label or no feature is of use. A task
    hands on its counts when it holds ``flush_at`` features.
    """
    bounded_batches(docs.sparkSession)
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most_rows)
    )
    # most_rows ids and labels, 16 bytes each, are small by that bound.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_y").dropDuplicates(["_text"])
    texts = stash(texts.withColumn("_half", F.pmod(F.xxhash64("_text"), F.lit(2)).cast("int")))
    kinds = ["clean0", "toxic0", "clean1", "toxic1"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [Counter() for _ in kinds]

        def told() -> pd.DataFrame:
            names = list(set().union(*seen))
            return pd.DataFrame({"f": pd.Series(names, dtype=object)} | {k: np.array([c[x] for x in names], dtype=np.int64) for k, c in zip(kinds, seen)})

        for b in batches:
            for text, y, half in zip(b["_text"], b["_y"], b["_half"]):
                seen[2 * half + y].update(features(text))
            if sum(map(len, seen)) > flush_at:
                yield told()
                seen = [Counter() for _ in kinds]
        # Nothing to tell after a flush at the last batch, or without rows.
        if any(seen):
            yield told()

    counts = texts.mapInPandas(count, "f string, " + ", ".join(f"{k} long" for k in kinds)).groupBy("f").agg(*[F.sum(k).alias(k) for k in kinds])
    sizes = {(r["_half"], r["_y"]): r["count"] for r in texts.groupBy("_half", "_y").count().collect()}
    n = {y: sizes.get((0, y), 0) + sizes.get((1, y), 0) for y in (0, 1)}
    if not n[0] or not n[1]:
        return None
    all_toxic = n[1] / (n[0] + n[1])

    def ratio_of(clean: Column, toxic: Column) -> Column:
        """Log-likelihood ratio of the feature's rows being toxic more often than the others, against no difference; null for others."""
        share = lambda k, total: F.when(k > 0, k * F.log(k / total)).otherwise(0.0)
        both = clean + toxic
        ratio = 2 * (share(toxic, both * all_toxic) + share(clean, both * (1 - all_toxic)))
        return F.when((both >= least_docs) & (toxic / both > min(0.5 + all_toxic / 2, 3 * all_toxic)) & (ratio >= least_ratio), ratio)

    halves = [ratio_of(F.col(f"clean{h}"), F.col(f"toxic{h}")) for h in (0, 1)]
    counts = stash(counts.select("f", ratio_of(F.col("clean0") + F.col("clean1"), F.col("toxic0") + F.col("toxic1")).alias("ratio"), halves[0].alias("ratio0"), halves[1].alias("ratio1")).where("ratio is not null or ratio0 is not null or ratio1 is not null"))
    best = counts.where("ratio is not null").orderBy(F.desc("ratio"), "f").limit(most_features).collect()
    if not best:
        return None
    place = {r["f"]: i for i, r in enumerate(best)}
    # The words that the rows of each half are graded by come from the other half.
    marked = [{r["f"][1:] for r in counts.where(F.col(c).isNotNull() & F.col("f").startswith("=")).orderBy(F.desc(c), "f").limit(most_features).collect()} for c in ("ratio1", "ratio0")]

    def ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [sorted(place[x] for x in features(t) & place.keys()) for t in b["_text"]]
            marks = [sum(w in marked[half] for w in _WORD.findall((t or "").lower())) for t, half in zip(b["_text"], b["_half"])]
            yield pd.DataFrame({"y": b["_y"], "hits": pd.Series(hits, dtype=object), "marks": np.array(marks, dtype=np.int32)})

    got = texts.mapInPandas(ones, "y int, hits array<int>, marks int").toPandas()  # at most most_rows
    got = got.sort_values(["y", "marks"], kind="stable").reset_index(drop=True)
    toxic = got["y"].to_numpy() == 1
    cuts = np.quantile(got["marks"][toxic], [1 / 3, 2 / 3])
    y = np.where(toxic, 1 + np.searchsorted(cuts, got["marks"].to_numpy(), side="left"), 0)
    _, y = np.unique(y, return_inverse=True)  # grades without rows close up
    lengths = np.array([len(h) for h in got["hits"]])
    rows = np.repeat(np.arange(len(y)), lengths)
    cols = np.concatenate([np.asarray(h, dtype=np.int64) for h in got["hits"]]) if lengths.sum() else np.array([], dtype=np.int64)
    w, theta = fit_ordinal(rows, cols.astype(np.int64), y, len(place), int(y.max()) + 1)
    return OrdinalModel({f: float(w[i]) for f, i in place.items()}, tuple(float(x) for x in theta))


def judged(docs: DataFrame, model: OrdinalModel | None, out_col: str, text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """``docs`` with a struct ``out_col``: expected_severity (0 and up), grade (the likeliest) and toxic (at ``cutoff`` or above).

    Whole texts are read. Null and empty texts have no features. Without a model
    severity is 0. Repeated rows get the same result; an empty table gives an
    empty one.
    """
    if model is None:
        return docs.withColumn(out_col, F.struct(F.lit(0.0).alias("expected_severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic")))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_severity double, grade int, toxic boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        whole = {f[1:]: w for f, w in known.weights.items() if f[0] == "="}
        starts = {n: {f[2:]: w for f, w in known.weights.items() if f[:2] == f"{n}:"} for n in PREFIXES}
        scores = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if not text:
                continue
            found = set(_WORD.findall(text.lower()))
            s = sum(whole[w] for w in found & whole.keys())
            for n, table in starts.items():
                if table:
                    s += sum(table[p] for p in {w[:n] for w in found} & table.keys())
            scores[i] = s
        p = known.grades(scores)
        severity = p @ np.arange(p.shape[1])
        return pd.DataFrame({"expected_severity": severity, "grade": p.argmax(axis=1).astype(np.int32), "toxic": severity >= cutoff})

    return docs.withColumn(out_col, judge(F.col(text_col)))


def score(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """``docs`` with expected_severity, grade and toxic, as ``judged`` gives them; columns of these names that ``docs`` has are replaced."""
    name = free_name("_judged", docs.columns)
    rows = judged(docs, model, name, text_col, cutoff)
    return rows.withColumns({c: F.col(f"{name}.{c}") for c in ("expected_severity", "grade", "toxic")}).drop(name)


def clean_rows(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns, whatever those are called."""
    name = free_name("_judged", docs.columns)
    return judged(docs, model, name, text_col, cutoff).where(~F.col(f"{name}.toxic")).drop(name)
