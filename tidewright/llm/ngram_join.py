"""Jaccard join of word n-gram sets: an exact partition of candidates, then signature trees within each group."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, free_name, if_small, stash, words
from tidewright.llm.components import components, connected

_U = np.uint64
_ODD = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(50_000)
def _word(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``n`` words; of all its words as one where it has fewer; none without words."""
    found = words(text)
    if not found:
        return np.zeros(0, dtype=_U)
    h = np.array([_word(w) for w in found], dtype=_U)
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, _U(k))
    for i in range(k):
        total = total * _ODD[-1] + mixed(h[i : len(h) - k + 1 + i] + _ODD[i % 7]) * _ODD[i % 7]
    return np.unique(mixed(total))


class Spaces:
    """Size classes and, for each, the number of parts that sets are split into.

    Two sets that link differ in at most d elements, where d follows from the sizes.
    Split into d + 1 parts by hash, they agree in one part at least; ``spare``
    more parts make it one part that is not empty, unless both have more empty
    parts than that. A set is split as its own size class asks and, where it
    can link with sets of the next class, as that one asks.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.starts = [1]
        self.parts: list[tuple[int, int]] = []

    def get(self, j: int) -> tuple[int, int, int]:
        """First size, number of parts and spare parts of class ``j``; one part where only equal sets link."""
        while len(self.starts) <= j + 1:
            self.starts.append(max(self.starts[-1] + 1, 3 * self.starts[-1] // 2))
        while len(self.parts) <= j:
            i = len(self.parts)
            low, high = self.starts[i], self.starts[i + 1] - 1
            d = (self.den - self.num) * 2 * high // (self.den + self.num)
            empty = (d + 1) * math.exp(-self.num * low / self.den / (d + 1))
            spare = math.ceil(empty + 3 * math.sqrt(empty)) if d else 0
            self.parts.append((d + 1 + spare, spare))
        return self.starts[j], *self.parts[j]

    def of(self, n: int) -> list[int]:
        """The classes that sets of ``n`` elements are split for."""
        j = 0
        while self.get(j + 1)[0] <= n:
            j += 1
        return [j, j + 1] if n * self.den >= self.num * self.get(j + 1)[0] else [j]

    def keys(self, s: np.ndarray) -> np.ndarray:
        """One key for each part that counts: equal parts of the same class have equal keys.

        Two sets that agree in empty parts only have more than ``spare`` of them
        both. So a set with that many is split by another hash as well, and by a
        third and a fourth if it has as many again. Only a set that has them under all four,
        which chance does not make, sends keys for its empty parts.
        """
        out = []
        for j in self.of(len(s)):
            _, k, spare = self.get(j)
            if k == 1:
                continue
            for t in range(4):
                x = s if t == 0 else np.sort(mixed(s + _ODD[t]))
                part = ((x >> _U(32)) * _U(k)) >> _U(32)
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                sums, names = np.add.reduceat(x, starts), part[starts]
                odd = k - len(starts) > spare
                if odd and t == 3:
                    full = np.zeros(k, dtype=_U)
                    full[names.astype(np.int64)] = sums
                    sums, names = full, np.arange(k, dtype=_U)
                out.append(mixed(sums ^ mixed(names + _U(j << 32) + _U(t << 60) + _ODD[0])))
                if not odd:
                    break
        return np.concatenate(out) if out else np.zeros(0, dtype=_U)


class Bands:
    """Keys for similarities under 0.9, where equal parts would hold too few elements to tell sets apart.

    A key is made of the least elements under ``rows`` hash functions, so two sets
    share it with their similarity to that power. There are so many keys that
    a pair at the threshold shares none with a probability of ``miss`` at most: no
    more than one in a billion, the order of a clash of hashes.
    """

    def __init__(self, num: int, den: int, rows: int = 6, miss: float = 1e-9, seed: int = 17) -> None:
        self.rows, self.bands = rows, math.ceil(math.log(miss) / math.log(1 - (num / den) ** rows))
        rng = np.random.default_rng(seed)
        self.flip, self.times = (rng.integers(0, 2**32, self.rows * self.bands, dtype=np.uint32) for _ in "ab")
        self.times |= np.uint32(1)
        self.name = mixed(np.arange(self.bands, dtype=_U) + _ODD[2])

    def keys(self, s: np.ndarray) -> np.ndarray:
        low = s.astype(np.uint32)
        least = np.full(len(self.flip), np.uint32(2**32 - 1))
        for i in range(0, len(low), 512):
            np.minimum(least, ((low[i : i + 512, None] ^ self.flip) * self.times).min(axis=0), out=least)
        key = self.name.copy()
        for column in least.reshape(self.bands, self.rows).T:
            key = mixed(key ^ column)
        return key


#: Bits of a signature.
BITS = 2048


class SignatureTree:
    """Sets under nodes of ``fan`` children: each has the OR of the token bitmaps below it, the range of sizes and the most tokens that share bits."""

    def __init__(self, sets: list[np.ndarray], fan: int = 8) -> None:
        self.sizes = np.array([len(s) for s in sets])
        maps = np.zeros((len(sets), BITS), dtype=bool)
        for i, s in enumerate(sets):
            maps[i, (s & _U(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(maps, axis=1).view(_U)
        shared = self.sizes - np.bitwise_count(packed).sum(axis=1)
        # Sets of like sizes and least elements, which near copies share, come under the same nodes.
        self.order = np.lexsort(([int(s[0]) for s in sets], np.log(np.maximum(self.sizes, 1)).round(1)))
        self.levels = [(packed[self.order], self.sizes[self.order], self.sizes[self.order], shared[self.order])]
        self.fan = fan
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes of a level, their children one level down, and which node each belongs to."""
        n = len(self.levels[level - 1][1])
        kids = nodes[:, None] * self.fan + np.arange(self.fan)
        inside = kids < n
        return kids[inside], np.repeat(np.arange(len(nodes)), inside.sum(axis=1))


def _expand(a: SignatureTree, b: SignatureTree, p: np.ndarray, q: np.ndarray, la: int, lb: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children; a tree that is at its leaves already stays."""
    if la:
        p, owner = a.children(la, p)
        q = q[owner]
    if lb:
        q, owner = b.children(lb, q)
        p = p[owner]
    return p, q


def candidates(a: SignatureTree, b: SignatureTree, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that the bounds leave, by dual traversal from the roots; with ``same`` each pair once."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    p, q = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while True:
        (bits_a, low_a, high_a, extra_a), (bits_b, low_b, high_b, extra_b) = a.levels[la], b.levels[lb]
        most = np.minimum(high_a[p], high_b[q])
        common = np.bitwise_count(bits_a[p] & bits_b[q]).sum(axis=1)
        most = np.minimum(most, common + np.minimum(extra_a[p], extra_b[q]))
        # Linked sets x, y share at least num / (num + den) of |x| + |y|.
        keep = most * (num + den) >= num * (low_a[p] + low_b[q])
        keep &= (high_a[p] * den >= low_b[q] * num) & (high_b[q] * den >= low_a[p] * num)
        if same and la == lb:
            keep &= p <= q
        p, q = p[keep], q[keep]
        if not la and not lb:
            if same:
                apart = p != q
                p, q = p[apart], q[apart]
            return a.order[p], b.order[q]
        p, q = _expand(a, b, p, q, la, lb)
        la, lb = max(la - 1, 0), max(lb - 1, 0)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (len(x) + len(y) - common)


def common_sizes(left: list[np.ndarray], right: list[np.ndarray], p: np.ndarray, q: np.ndarray, few: int = 64, width: int = 4096) -> np.ndarray:
    """How many elements left set p[i] and right set q[i] share, exactly.

    Few pairs are looked at one by one. Many come out of products of 0/1 matrices
    over the elements that both sides have, ``width`` of them at a time.
    """
    if len(p) <= few:
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(p, q)], dtype=np.int64)
    flat = [np.concatenate(sets) for sets in (left, right)]
    both = np.intersect1d(*(np.unique(x) for x in flat), assume_unique=True)
    out, columns = np.zeros((len(left), len(right)), dtype=np.float32), []
    for x, sets in zip(flat, (left, right)):
        at = np.searchsorted(both, x)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == x[hit]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(at[hit], kind="stable")
        columns.append((at[hit][order], owner[order], len(sets)))
    for first in range(0, len(both), width):
        parts = []
        for at, owner, n in columns:
            lo, hi = np.searchsorted(at, [first, first + width])
            m = np.zeros((n, min(width, len(both) - first)), dtype=np.float32)
            m[owner[lo:hi], at[lo:hi] - first] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out[p, q].astype(np.int64)


def links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions that link: of a left set with a right one, or with None of left sets among themselves, each pair once."""
    a = SignatureTree(left)
    b = a if right is None else SignatureTree(right)
    p, q = candidates(a, b, num, den, right is None)
    others = left if right is None else right
    common = common_sizes(left, others, p, q)
    sizes = [np.array([len(s) for s in sets], dtype=np.int64) for sets in (left, others)]
    near = den * common >= num * (sizes[0][p] + sizes[1][q] - common)
    return p[near], q[near]


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """id, n_shingles, component_id, n_links and _hash (xxhash64 of the text) for each row.

    Rows link where the Jaccard similarity of their sets of ``n``-word shingles is
    at least ``num / den``; component_id is the smallest id reachable by links, and
    n_links the number of other rows linked directly.
    From a similarity of 0.9 on no link is lost: every pair that links shares a key
    of ``Spaces``; below that, one of ``Bands`` but for a chance of one in a billion. Sets, not
    rows, are compared: equal ones are one set throughout, known by a 64-bit
    hash. Keys make coarse groups; only their members' texts are read again.
    A group of over ``block`` sets is dealt out as pairs of blocks, so the
    largest task holds two blocks of sets. Each task gives how many links its sets
    have and who is connected, not all pairs.

    Null and wordless texts have n_shingles 0 and link with nothing. Null ids
    take part; component_id is null where a component has no id. Repeated rows
    and texts have the same component_id. An empty table gives an empty result;
    other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, seen = Spaces(num, den) if 10 * num >= 9 * den else Bands(num, den), set()
        # Long texts have many keys: a thousand rows at a time bound what a task holds.
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            sets = [shingles(t.as_py(), n) for t in b.column(2)]
            sizes = np.array([len(s) for s in sets], dtype=np.int32)
            ids = np.array([int(s.sum(dtype=_U)) for s in sets], dtype=_U)
            ids = mixed(ids + sizes.astype(_U) * _ODD[1]).view(np.int64)
            # A set met before in this task has sent its keys.
            if len(seen) > 500_000:
                seen = set()
            fresh = [i for i in range(len(sets)) if sizes[i] and not (ids[i] in seen or seen.add(ids[i]))]
            keys = [spaces.keys(sets[i]) for i in fresh]
            owner = np.repeat(ids[fresh], [len(k) for k in keys]) if fresh else np.zeros(0, dtype=np.int64)
            key = np.concatenate(keys).view(np.int64) if fresh else np.zeros(0, dtype=np.int64)
            # Of the sets with a key one sends it; the others are tied to that one here.
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
            tie = np.flatnonzero(~first)
            ties = np.unique(np.stack([owner[tie], owner[tie - 1]], axis=1), axis=0) if len(tie) else np.zeros((0, 2), dtype=np.int64)
            ties = ties[ties[:, 0] != ties[:, 1]]
            d, k, t = len(sets), int(first.sum()), len(ties)
            spread = mixed(np.arange(d + t, dtype=_U) + mixed(np.array([len(seen)], dtype=_U))).view(np.int64)
            none = lambda size, kind: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(d), np.ones(k), np.full(t, 2)]).astype(np.int8)),
                    pa.array(np.concatenate([spread[:d], key[first], spread[d:]])),
                    pa.array(np.concatenate([ids, owner[first], ties[:, 0]])),
                    pa.array(np.concatenate([sizes, np.zeros(k + t, dtype=np.int32)])),
                    pa.concat_arrays([none(d + k, pa.int64()), pa.array(ties[:, 1])]),
                    pa.concat_arrays([b.column(0), none(k + t, b.column(0).type)]),
                    pa.concat_arrays([b.column(1), none(k + t, pa.int64())]),
                ],
                names=["kind", "key", "sid", "n", "other", "_id", "_hash"],
            )

    sent = rows.mapInArrow(split, f"kind byte, key long, sid long, n int, other long, _id {id_type}, _hash long")
    before = F.lag(F.struct("kind", "sid")).over(Window.partitionBy("key").orderBy("kind", "sid"))
    met = sent.withColumn("_before", before)
    tied = (F.col("kind") == 1) & (F.col("_before.kind") == 1) & (F.col("_before.sid") != F.col("sid"))
    met = met.withColumn("other", F.when(F.col("kind") == 1, F.when(tied, F.col("_before.sid"))).otherwise(F.col("other")))
    met = stash(met.where((F.col("kind") != 1) | F.col("other").isNotNull()).drop("key", "_before"))
    placed = met.where("kind = 0").select("_id", "_hash", "sid", "n")
    ties = met.where("kind <> 0").select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct()
    coarse = components(ties)

    by_set = placed.where("n > 0").groupBy("sid").agg(F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_hash")).alias("row"), F.count("*").alias("rows"))
    by_set = stash(by_set.join(coarse, by_set["sid"] == coarse["node"], "left").select("sid", "component", "rows", "row._id", "row._hash"))
    members = by_set.where("component is not null")
    blocks = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wanted = stash(members.join(blocks, "component").select("sid", "component", "blocks", "rows", F.pmod("sid", F.col("blocks").cast("long")).cast("int").alias("own"), F.col("_id").alias("_want"), F.col("_hash").alias("_want_hash")))
    texts = rows.join(if_small(wanted), F.col("_id").eqNullSafe(F.col("_want")) & (F.col("_hash") == F.col("_want_hash")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            made = pa.array([shingles(t.as_py(), n).tobytes() for t in b.column(5)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], made], names=["component", "sid", "own", "blocks", "rows", "set"])

    sets = texts.select("component", "sid", "own", "blocks", "rows", "_text").mapInArrow(sets_of, "component long, sid long, own int, blocks int, rows long, set binary")
    cells = sets.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("own", "_y").alias("i"), F.greatest("own", "_y").alias("j"), "sid", "own", "rows", "set")

    def link(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("sid")
        left, right = cell[cell["own"] == key[1]], cell[cell["own"] != key[1]]
        if not len(left) or not (len(right) or key[1] == key[2]):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        load = lambda part: [np.frombuffer(x, dtype=_U) for x in part["set"]]
        p, q = links(load(left), load(right) if len(right) else None, num, den)
        q = q + (len(left) if len(right) else 0)
        sids, rows = (np.concatenate([left[c], right[c]]).astype(np.int64) for c in ("sid", "rows"))
        counts = np.zeros(len(sids), dtype=np.int64)
        np.add.at(counts, p, rows[q])
        np.add.at(counts, q, rows[p])
        label = connected(len(sids), p, q)
        has, tied = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(sids)))
        return pd.DataFrame({"a": np.concatenate([sids[has], sids[tied]]), "b": np.concatenate([sids[has], sids[label[tied]]]), "n": np.concatenate([counts[has], np.zeros(len(tied), dtype=np.int64)])})

    found = stash(cells.groupBy("component", "i", "j").applyInPandas(link, "a long, b long, n long"))
    fine = components(found.select("a", "b"))
    partners = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))

    named = by_set.select("sid", "rows", "_id").join(fine, F.col("sid") == F.col("node"), "left").drop("node").join(partners, F.col("sid") == F.col("node"), "left")
    named = stash(named.where("rows > 1 or component is not null").select("sid", "_id", F.coalesce("component", "sid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links")))
    least = named.groupBy("root").agg(F.min("_id").alias("least"))
    ends = stash(named.join(least, "root").select(F.col("sid").alias("_sid"), "least", "n_links"))
    out = placed.join(ends, (F.col("sid") == F.col("_sid")) & (F.col("n") > 0), "left")
    component = F.when(F.col("_sid").isNull(), F.col("_id")).otherwise(F.col("least"))
    return out.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "_hash")


def near_dedup(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the smallest id, with all columns.

    Rows without an id stay unless one with an id is in their component. Rows
    that share the id and text of one that stays do so too.
    """
    found = jaccard_components(docs, n, num, den, id_col, text_col)
    lost_id, lost_hash = (free_name(c, docs.columns) for c in ("_lost", "_lost_hash"))
    lost = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(lost_id), F.col("_hash").alias(lost_hash)).distinct()
    lost = if_small(stash(lost))
    same = F.col(id_col).eqNullSafe(F.col(lost_id)) & (F.xxhash64(text_col) == F.col(lost_hash))
    return docs.join(lost, same, "left_anti")
