"""Connected components of a graph of edges, as joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.llm.common import stash


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and a sum that tells sets of them apart; both come with the write."""
    seen = Observation()
    told = edges.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s"))
    out = stash(told)
    return out, (seen.get["n"], seen.get["s"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for the nodes of ``edges`` (a, b: long; nulls and loops are left out).

    Alternates the large-star and small-star steps: each node's greater neighbours,
    then its smaller ones, are linked to the smallest it knows of, until every
    component is a star. The number of edges never grows and the rounds grow as
    the logarithm of the size. The smallest neighbours are written before the
    join of a node with all its edges, so that AQE can split one with very many.
    """
    ordered = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held, now = _written(ordered(edges))
    before = None
    for _ in range(most_rounds):
        if now == before or not now[0]:
            break
        before = now
        both = held.union(held.select("b", "a"))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = stash(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        held, now = _written(ordered(small.union(large.groupBy("a").agg(F.min("b").alias("b")))))
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select("b", "b").distinct())


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of 0..n-1 the smallest number that the pairs (i, j) connect it with, within a task."""
    label = np.arange(n)
    while True:
        least, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new
