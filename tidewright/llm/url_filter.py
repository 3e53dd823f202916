"""URL filtering: ordered host and path rules over an exact blocklist held as a Bloom filter cascade."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, stash


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as bytes, in parts of so many bits, the number of hash functions and the seed."""

    bits: bytes
    part: int
    hashes: int
    seed: int


def _hash_columns(key: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed + i), key) for i in (0, 1)]


def _places(h1: np.ndarray, h2: np.ndarray, part: int, hashes: int) -> Iterator[np.ndarray]:
    """For each hash function the keys' bits within their parts: (h1 + i * h2) modulo a part's bits."""
    h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64) | np.uint64(1)
    for i in range(hashes):
        yield ((h1 + np.uint64(i) * h2) % np.uint64(part)).astype(np.int64)


def _hit(level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys the level holds; a key's part goes by the upper half of h2."""
    table = np.frombuffer(level.bits, dtype=np.uint8)
    start = (h2.astype(np.int64) >> 32) % (8 * len(table) // level.part) * level.part
    found = np.ones(len(h1), dtype=bool)
    for at in _places(h1, h2, level.part, level.hashes):
        found &= (table[(start + at) >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _build(keys: DataFrame, n: int, rate: float, seed: int, most_bytes: int, part_bytes: int = 64 << 10) -> Level:
    """The filter over ``n`` keys with false positives at ``rate``: one group of keys makes each part, and the parts come to the driver as bytes."""
    size = max(8, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 8))
    if size > most_bytes:
        raise MemoryError(f"a filter of {size} bytes is over the bound of {most_bytes}")
    parts = math.ceil(size / part_bytes)
    part = 8 * math.ceil(size / parts)
    hashes = max(1, round(parts * part / max(n, 1) * math.log(2)))

    def make(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(part, dtype=np.uint8)
        for at in _places(b["h1"].to_numpy(), b["h2"].to_numpy(), part, hashes):
            bits[at] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    h1, h2 = _hash_columns(F.col("key"), seed)
    hashed = keys.select(h1.alias("h1"), h2.alias("h2")).withColumn("part", F.pmod(F.shiftright("h2", 32), F.lit(parts)))
    # A part of 64 KB has some 400,000 keys at most, and all parts together have most_bytes.
    made = hashed.groupBy("part").applyInPandas(make, "part long, bits binary").toPandas()
    found = dict(zip(made["part"], made["bits"]))
    return Level(b"".join(bytes(found.get(i, bytes(part // 8))) for i in range(parts)), part, hashes, seed)


def _tested(keys: DataFrame, levels: list[Level], name: str = "_depth") -> DataFrame:
    """Adds ``name``: how many of ``levels`` in a row hold the row's ``key``."""
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("int")
    def depth(*cols: pd.Series) -> pd.Series:
        out, alive = np.zeros(len(cols[0]), dtype=np.int32), np.ones(len(cols[0]), dtype=bool)
        for i, level in enumerate(shared.value):
            alive &= _hit(level, cols[2 * i].to_numpy(), cols[2 * i + 1].to_numpy())
            out += alive
        return pd.Series(out)

    return keys.withColumn(name, depth(*[c for x in levels for c in _hash_columns(F.col("key"), x.seed)]))


def build_cascade(universe: DataFrame, rate: float = 0.5, most_bytes: int = 64 << 20, most_levels: int = 48, part_bytes: int = 64 << 10) -> list[Level]:
    """The cascade for ``universe`` (key string, listed boolean): each distinct non-null key once.

    Level 0 holds the listed keys; level 1 the unlisted ones that level 0 lets
    through; level 2 the listed ones that level 1 lets through, and so on until
    nothing is let through wrongly. A key of the universe is listed exactly if
    the number of levels it passes in a row is odd. ``most_bytes`` bounds each
    level, and thereby what is broadcast; beyond it MemoryError is raised and
    ``listed_mask`` uses a join instead. Levels are built in parts of ``part_bytes``.
    """
    levels: list[Level] = []
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    n_in, n_out = inside.count(), outside.count()
    while n_in:
        if len(levels) == most_levels:
            raise RuntimeError("the cascade does not end: are keys both listed and not?")
        first = min(0.5, max(1e-6, n_in / max(n_out, 1) * math.sqrt(0.5))) if not levels else rate
        levels.append(_build(inside, n_in, first, len(levels), most_bytes, part_bytes))
        # The other side's keys that this level lets through are what the next level has to hold.
        through = stash(_tested(outside, levels[-1:]).where("_depth = 1").select("key"))
        inside, outside, n_in, n_out = through, inside, through.count(), n_in
    return levels


def listed_mask(rows: DataFrame, key_col: str, listed: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` with a boolean column ``listed``: whether ``key_col`` is a key of ``listed`` (column key).

    The universe is every distinct key of ``rows``, so the answer is exact.
    Null keys are not listed. Listed keys that no row has do not matter.
    """
    keys = rows.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("key")).agg(F.count("*").alias("_n"))
    marks = listed.where(F.col("key").isNotNull()).select("key").distinct().withColumn("_listed", F.lit(True))
    universe = stash(keys.join(marks, "key", "left").select("key", F.coalesce("_listed", F.lit(False)).alias("listed")))
    try:
        levels = build_cascade(universe, most_bytes=most_bytes)
    except MemoryError:
        found = universe.where("listed").select(F.col("key").alias("_key"), F.lit(True).alias("listed"))
        return rows.join(found, F.col(key_col) == F.col("_key"), "left").drop("_key").withColumn("listed", F.coalesce("listed", F.lit(False)))
    if not levels:
        return rows.withColumn("listed", F.lit(False))
    tested = _tested(rows.withColumn("key", F.coalesce(F.col(key_col), F.lit(""))), levels)
    return tested.withColumn("listed", (F.col("_depth") % 2 == 1) & F.col(key_col).isNotNull()).drop("_depth", "key")


#: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Names of sites that are listed, on any domain and with any subdomain.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def url_filter(pages: DataFrame, listed: DataFrame | None = None, rules: tuple = RULES, url_col: str = "url", most_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    A rule fits its host and all subdomains where the path starts with the
    rule's path; of several the longest wins, of equally long ones the first.
    Where none fits, ``listed`` (column key: hosts) decides by the cascade; by
    default these are the hosts of ``LISTED_SITES``. Repeated rows are judged
    alike; columns of these names that ``pages`` has are replaced.
    """
    host, path = split_url(F.col(url_col))
    pages = pages.drop(*({"host", "path", "rule", "verdict", "listed", "key", "_depth"} & set(pages.columns) - {url_col}))
    rows = pages.withColumns({"host": host, "path": path})
    if listed is None:
        sites = "|".join(LISTED_SITES)
        listed = rows.where(F.col("host").rlike(rf"(^|\.)({sites})\.")).select(F.col("host").alias("key"))
    judged = listed_mask(rows, "host", listed, most_bytes)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for name, prefix, says in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return judged.withColumns({"rule": rule, "verdict": verdict})
