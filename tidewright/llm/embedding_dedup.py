"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import if_small, stash
from tidewright.llm.components import components, connected


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(axis=1)
        for j in range(k):
            mine = x[near == j]
            if len(mine):
                c[j] = mine.mean(axis=0)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all of ``c``."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the inverted lists, and for each of the subspaces the codewords of residuals."""

    coarse: np.ndarray
    words: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.coarse).argmin(axis=1)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the distance of each row to what its code stands for."""
        m, _, d = self.words.shape
        rest = x - self.coarse[at]
        codes = np.stack([_distances(rest[:, i * d : (i + 1) * d], self.words[i]).argmin(axis=1) for i in range(m)], axis=1)
        made = np.concatenate([self.words[i][codes[:, i]] for i in range(m)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(rest - made, axis=1)

    def probes(self, x: np.ndarray, at: np.ndarray, reach: float) -> list[np.ndarray]:
        """The lists that can hold a row within ``reach``: all whose border with the own list is that near."""
        d2 = _distances(x, self.coarse)
        between = np.sqrt(_distances(self.coarse, self.coarse))
        gap = d2 - d2[np.arange(len(x)), at][:, None]
        near = gap <= 2 * reach * between[at] + 1e-9
        near[np.arange(len(x)), at] = True
        return [np.flatnonzero(row) for row in near]

    def asks(self, x: np.ndarray, at: np.ndarray, reach: float) -> list[np.ndarray]:
        """The own list and about half of the probes: of two lists whose rows may be near, one asks the other.

        Being near is mutual, so the rows of either list would find all pairs.
        Which of two asks depends on whether their numbers add up to an odd one,
        so that all lists ask about as many.
        """
        out = []
        for own, found in zip(at, self.probes(x, at, reach)):
            out.append(found[(found == own) | ((own < found) ^ ((own + found) % 2 == 1))])
        return out

    def tables(self, q: np.ndarray, coarse: int) -> np.ndarray:
        """For each row of ``q`` and each subspace, the squared distances of its residual to the codewords."""
        m, _, d = self.words.shape
        rest = q - self.coarse[coarse]
        return np.stack([_distances(rest[:, i * d : (i + 1) * d], self.words[i]) for i in range(m)], axis=1)


def train(vectors: np.ndarray, lists: int = 32, subspaces: int = 8, codewords: int = 32, seed: int = 5) -> Quantiser:
    rng = np.random.default_rng(seed)
    coarse = k_means(vectors, lists, rng)
    rest = vectors - coarse[_distances(vectors, coarse).argmin(axis=1)]
    d = vectors.shape[1] // subspaces
    books = [k_means(rest[:, i * d : (i + 1) * d], codewords, rng) for i in range(subspaces)]
    return Quantiser(coarse, np.stack(books))


def near_links(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample_rows: int = 20_000, lists: int = 32, subspaces: int = 8, codewords: int = 32, block: int = 1024) -> DataFrame:
    """id, n_links, component_id and kept for each row: links join rows of equal, non-null labels with a cosine of ``cosine`` or more.

    Vectors that are null or zero, or hold null, NaN or infinite components, link
    with nothing; so do rows without an id, and vectors of different lengths with
    one another. Rows with the same id count as one, with the smallest vector in
    array order.

    The quantiser is fitted on at most ``sample_rows`` unit vectors of each
    length, those whose id hashes lowest; every row is indexed. Unit vectors
    link within a distance of sqrt(2 - 2 cosine). A row is compared with the
    lists whose border is that near, so the probes are sufficient; of two such
    lists only one asks the other, and a pair then counts for both rows. A list's
    codes give each distance by table lookup, up to the row's own, stored
    quantisation error; what may be near enough is compared by cosine in double
    precision. Equal vectors of a label are one entry that counts as many.
    Small lists of a label share a place of about ``block`` entries, to which a
    row goes once; places of more are split, and pairs of blocks meet in one
    task, which gives counts and who is connected, not all pairs.

    An empty table gives an empty result; other columns are not read, whatever
    their names.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.coalesce(F.forall("_v", finite) & F.exists("_v", lambda x: x != 0), F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"), numbers.alias("_v"))
    usable = base.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & sound)
    # One row for each id, and one entry for each different vector of a label.
    one = usable.groupBy("_id").agg(F.min(F.struct("_v", "_label")).alias("_one")).select("_id", "_one._v", "_one._label")
    entries = stash(one.groupBy("_label", "_v").agg(F.min("_id").alias("entry"), F.count("*").alias("copies")).withColumn("size", F.size("_v")))
    # An entry may be found again from any of its rows by label and vector.
    owners = one.join(entries, ["_label", "_v"]).select("_id", "entry")

    models: dict[int, Quantiser] = {}
    for size in [r["size"] for r in entries.select("size").distinct().collect()]:
        sample = entries.where(F.col("size") == size).orderBy(F.xxhash64("entry"), "entry").limit(sample_rows).select("_v").toPandas()
        x = np.stack(sample["_v"].to_numpy())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        parts = next(m for m in range(min(subspaces, size), 0, -1) if size % m == 0)
        models[size] = train(x / np.linalg.norm(x, axis=1, keepdims=True), lists, parts, codewords)
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, part in b.groupby("size"):
                q = shared.value[size]
                x = np.stack(part["_v"].to_numpy()).astype(float)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                at = q.lists(x)
                codes, error = q.encode(x, at)
                yield pd.DataFrame({
                    "entry": part["entry"].to_numpy(), "label": part["_label"].to_numpy(), "size": size, "copies": part["copies"].to_numpy(), "at": at,
                    "probes": q.asks(x, at, reach), "unit": [v.tobytes() for v in x], "code": [c.tobytes() for c in codes], "error": error,
                })

    kind = f"entry long, label {vectors.schema[label_col].dataType.simpleString()}, size int, copies long, at int, probes array<int>, unit binary, code binary, error double"
    indexed = entries.mapInPandas(index, kind)
    # One row for each label and length: the places that its lists share.
    shares = stash(entries.groupBy(F.col("_label").alias("label"), "size").agg(F.least(F.lit(lists).cast("long"), F.ceil(F.count("*") / block).cast("long")).alias("places")))
    indexed = stash(indexed.join(if_small(shares), ["label", "size"]))
    place = ["label", "size", "place"]
    asked = indexed.withColumn("place", F.explode(F.array_distinct(F.transform("probes", lambda x: x % F.col("places")))))
    held = indexed.withColumn("place", F.col("at") % F.col("places"))
    in_blocks = lambda rows, name: rows.groupBy(*place).agg(F.ceil(F.count("*") / block).cast("long").alias(name))
    # A block of askers and a block of the place's entries make a cell.
    cells = stash(in_blocks(asked, "xs").join(in_blocks(held, "ys"), place))
    own = lambda n: F.pmod(F.xxhash64("entry"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["entry", "copies", "unit", "at"]
    none = lambda name: F.lit(None).cast(indexed.schema[name].dataType).alias(name)
    left = asked.join(cells, place).withColumn("x", own("xs")).select(*place, "x", every("ys").alias("y"), F.lit(True).alias("asks"), *columns, "probes", none("code"), none("error"))
    right = held.join(cells, place).withColumn("y", own("ys")).select(*place, every("xs").alias("x"), "y", F.lit(False).alias("asks"), *columns, none("probes"), "code", "error")

    def compare(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        q = shared.value[key[1]]
        asks, holds = cell[cell["asks"]], cell[~cell["asks"]]
        if not len(asks) or not len(holds):
            return pd.DataFrame({"entry": [], "n": [], "other": []}, dtype="int64")
        x, y = (np.stack([np.frombuffer(v) for v in part["unit"]]) for part in (asks, holds))
        codes, error = np.stack([np.frombuffer(c, dtype=np.uint8) for c in holds["code"]]), holds["error"].to_numpy()
        ids, copies = np.concatenate([asks["entry"], holds["entry"]]), np.concatenate([asks["copies"], holds["copies"]])
        home, away = asks["at"].to_numpy(), holds["at"].to_numpy()
        wants = np.zeros((len(x), len(q.coarse)), dtype=bool)
        for row, probes in zip(wants, asks["probes"]):
            row[probes] = True
        n, pairs = np.zeros(len(ids), dtype=np.int64), []
        for where in np.unique(away):
            there, here = np.flatnonzero(away == where), np.flatnonzero(wants[:, where])
            for s in range(0, len(here), 256):
                some = here[s : s + 256]
                table = q.tables(x[some], where)
                guess = np.sqrt(sum(table[:, i, codes[there, i]] for i in range(codes.shape[1])))
                i, j = np.nonzero(guess <= reach + error[there][None, :] + 1e-7)
                i, j = some[i], there[j]
                apart = ids[i] != ids[len(x) + j]
                i, j = i[apart], j[apart]
                near = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
                i, j = i[near], j[near]
                pairs.append((i, len(x) + j))
                np.add.at(n, i, copies[len(x) + j])
                # Rows of one list ask each other; of two lists only one asks.
                once = home[i] != where
                np.add.at(n, len(x) + j[once], copies[i[once]])
        i, j = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.zeros(0, dtype=np.int64),) * 2
        label = connected(len(ids), i, j)
        tied, counted = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(n)
        return pd.DataFrame({
            "entry": np.concatenate([ids[counted], ids[tied]]),
            "n": np.concatenate([n[counted], np.zeros(len(tied), dtype=np.int64)]),
            "other": np.concatenate([ids[counted], ids[label[tied]]]),
        })

    found = stash(left.unionByName(right).groupBy(*place, "x", "y").applyInPandas(compare, "entry long, n long, other long"))
    fine = components(found.select(F.col("entry").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("entry").agg(F.sum("n").alias("n"))
    about = stash(entries.select("entry", "copies").join(counts, "entry", "left").join(fine.withColumnRenamed("node", "entry"), "entry", "left").select("entry", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "entry").alias("component")))
    named = stash(owners).join(about, "entry").select("_id", "n", "component")
    out = base.select("_id").join(named, "_id", "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
