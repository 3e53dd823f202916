"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stash, words

STATS = (
    "log_words", "mean_word", "upper", "digits", "marks", "bars", "bangs", "ends", "distinct", "repeats", "top_word",
    "log_line", "long_words", "non_ascii", "words_upper", "words_marked",
)

_UPPER, _DIGITS, _ENDS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?"
_MARKS = b"#$%&*@^~<>{}[]\\/=+_"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The statistics named in STATS over the whole text; all 0 for one without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = words(text)
    if not found:
        return [0.0] * len(STATS)
    n, size = len(found), len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(found)
    plain = raw.split()
    return [
        np.log1p(n), sum(map(len, found)) / n, share(_UPPER), share(_DIGITS), share(_MARKS), share(b"|"), share(b"!"), share(_ENDS),
        len(counts) / n, sum(map(operator.eq, found, found[1:])) / n, max(counts.values()) / n, np.log1p(n / (raw.count(b"\n") + 1)),
        sum(len(w) > 14 for w in counts) / len(counts), share(_HIGH), sum(map(bytes.isupper, plain)) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in (b".", b",") for w in plain) / n,
    ]


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, frequencies and phases of the features, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_at: np.ndarray
    steps: np.ndarray

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        phi = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([phi, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lifted(stats) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.steps_at, self.steps)


def pool_adjacent_violators(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def measure(docs: DataFrame, text_col: str = "text", out_col: str = "_stats") -> DataFrame:
    """``docs`` with the statistics of the text in place of the text: all that training and scoring read."""

    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return docs.withColumn(out_col, each(F.col(text_col))).drop(text_col)


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", n_features: int = 256, width: float = 1.0, ridge: float = 1e-3, bins: int = 512, seed: int = 7) -> QualityModel | None:
    """Fit on every labelled row of ``measured``. ``width`` scales the Gaussian kernel's width, the root of the number of statistics.

    Each partition sums its part of the normal equations; Spark adds the parts.
    For the calibration, the raw scores meet in ``bins`` equal-width bins, so
    what reaches the driver has a fixed size whatever the number of rows. Every
    distinct label of an id counts. None where no row is labelled 0 or 1.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).distinct()
    rows = measured.select(F.col(id_col).alias("_id"), F.col("_stats").alias("stats")).join(marks, "_id")
    known = stash(rows.select(F.col("_y").alias("y"), "stats"))
    if known.isEmpty():
        return None
    p = len(STATS)
    summary = known.agg(*[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, scale = (np.array([summary[f"{k}{i}"] for i in range(p)]) for k in "ms")
    draw = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), draw.normal(size=(p, n_features)) / (width * np.sqrt(p)), draw.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.zeros(1), np.zeros(1))

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = n_features + 1
        gram, right = np.zeros((size, size)), np.zeros(size)
        for b in batches:
            phi = model.lifted(np.stack(b["stats"].to_numpy()))
            gram += phi.T @ phi
            right += phi.T @ b["y"].to_numpy()
        yield pd.DataFrame({"i": np.arange(size), "part": [np.append(gram[i], right[i]) for i in range(size)]})

    def added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "part": [np.sum(np.stack(parts["part"].to_numpy()), axis=0)]})

    schema = "i int, part array<double>"
    summed = known.mapInPandas(equations, schema).groupBy("i").applyInPandas(added, schema).toPandas().sort_values("i")
    system = np.stack(summed["part"].to_numpy())
    n = system[-1, n_features]
    penalty = np.diag(np.append(np.full(n_features, ridge * n / n_features), 0.0))
    weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
    model = QualityModel(model.mean, model.scale, model.frequencies, model.phases, weights, model.steps_at, model.steps)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"raw": model.raw(np.stack(b["stats"].to_numpy())), "y": b["y"]})

    place = F.floor(F.col("raw") * (bins / 2.0))
    binned = known.mapInPandas(scored, "raw double, y double").withColumn("bin", F.least(F.greatest(place, F.lit(-bins)), F.lit(2 * bins)))
    table = binned.groupBy("bin").agg(F.avg("raw").alias("at"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")
    steps = pool_adjacent_violators(table["y"].to_numpy(), table["n"].to_numpy(dtype=float))
    return QualityModel(model.mean, model.scale, model.frequencies, model.phases, weights, table["at"].to_numpy(), steps.clip(0, 1))


def score(measured: DataFrame, model: QualityModel | None, cutoff: float = 0.3) -> DataFrame:
    """``measured`` with score (0 to 1) and predicted (1 where score >= ``cutoff``).

    Only the statistics are read. Null and empty texts are scored as texts without
    words. Without a model every score is 0.5. Repeated rows get the same
    result; columns of these names that there are already are replaced.
    """
    if model is None:
        return measured.withColumns({"score": F.lit(0.5), "predicted": F.lit(int(0.5 >= cutoff))}).drop("_stats")
    shared = measured.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(stats: pd.Series) -> pd.Series:
        if not len(stats):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.calibrated(shared.value.raw(np.stack(stats.to_numpy()))))

    return measured.withColumn("score", judge("_stats")).withColumn("predicted", (F.col("score") >= cutoff).cast("int")).drop("_stats")
