"""Source divergence audit: term counts by language and source in mergeable radix tries, and how far sources differ."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, stash
from tidewright.llm.lexical_search import terms

#: Bytes to bytes: A-Z to a-z, every other ASCII byte but a-z to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

#: Added to each term's count.
ADDED = 5
#: Groups (language, source) sent to the tasks at a time: some tens of bytes each.
MOST_GROUPS = 500_000


def _narrow(x: np.ndarray) -> bytes:
    """The array after a byte that tells how wide its numbers are."""
    kind = next((i for i, t in enumerate(("u1", "u2", "u4")) if not len(x) or int(x.max()) <= np.iinfo(t).max), 3)
    return bytes([kind]) + x.astype(("u1", "u2", "u4", "i8")[kind]).tobytes()


@dataclass
class RadixTrie:
    """A byte trie with compressed paths, as its leaves in UTF-8 order.

    Stored as the traversal: for each leaf the depth at which its path leaves that
    of the leaf before (``shared``) and the bytes of the edge from there. A leaf
    has the number of documents and, for ``fan`` sources, an index into ``names``
    and a count.
    """

    leaves: list[bytes]
    docs: np.ndarray
    fan: np.ndarray
    source: np.ndarray
    count: np.ndarray
    names: list[str]

    def cut(self, start: int, stop: int, ends: np.ndarray) -> RadixTrie:
        """The leaves from ``start`` to ``stop`` with the names they use; ``ends`` are the running sums of ``fan``."""
        a, z = (int(ends[start - 1]) if start else 0), int(ends[stop - 1])
        used, source = np.unique(self.source[a:z], return_inverse=True)
        return RadixTrie(self.leaves[start:stop], self.docs[start:stop], self.fan[start:stop], source, self.count[a:z], [self.names[i] for i in used])

    def to_bytes(self) -> bytes:
        shared, edges, before = [], [], b""
        for leaf in self.leaves:
            if leaf.startswith(before):
                n = len(before)
            else:
                n = next(i for i, (x, y) in enumerate(zip(leaf, before)) if x != y) if len(leaf) < 64 else _common(leaf, before)
            shared.append(n)
            edges.append(leaf[n:])
            before = leaf
        names = [n.encode("utf-8", "surrogatepass") for n in self.names]
        sizes = [np.array(x, np.int64) for x in (shared, [len(e) for e in edges], [len(n) for n in names])]
        head = np.array([len(self.leaves), len(self.source), len(names)], np.int64).tobytes()
        return b"".join([head, *map(_narrow, sizes), *map(_narrow, (self.docs, self.fan, self.source, self.count)), *names, *edges])

    @staticmethod
    def from_bytes(raw: bytes) -> RadixTrie:
        n, m, k = np.frombuffer(raw, np.int64, 3).tolist()
        place = 24

        def numbers(size: int) -> np.ndarray:
            nonlocal place
            kind = ("u1", "u2", "u4", "i8")[raw[place]]
            found = np.frombuffer(raw, kind, size, place + 1).astype(np.int64)
            place += 1 + size * np.dtype(kind).itemsize
            return found

        shared, edges, lengths = numbers(n).tolist(), numbers(n).tolist(), numbers(k).tolist()
        docs, fan, source, count = numbers(n), numbers(n), numbers(m), numbers(m)
        names, leaves, before = [], [], b""
        for size in lengths:
            names.append(raw[place : place + size].decode("utf-8", "surrogatepass"))
            place += size
        for depth, size in zip(shared, edges):
            before = before[:depth] + raw[place : place + size]
            leaves.append(before)
            place += size
        return RadixTrie(leaves, docs, fan, source, count, names)

    @staticmethod
    def merged(tries: list[RadixTrie]) -> RadixTrie:
        """One trie with the leaves of all, counters added."""
        if len(tries) == 1:
            return tries[0]
        # Runs that are sorted already: the sort only merges them.
        leaves = list(dict.fromkeys(sorted(leaf for t in tries for leaf in t.leaves)))
        place = {leaf: i for i, leaf in enumerate(leaves)}
        names = sorted({n for t in tries for n in t.names})
        number = {n: i for i, n in enumerate(names)}
        docs = np.zeros(len(leaves), np.int64)
        keys, counts = [], []
        for t in tries:
            at = np.fromiter(map(place.__getitem__, t.leaves), np.int64, len(t.leaves))
            docs[at] += t.docs
            sources = np.array([number[n] for n in t.names], np.int64)
            keys.append(np.repeat(at, t.fan) * len(names) + sources[t.source])
            counts.append(t.count)
        key, into = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, into, np.concatenate(counts))
        return RadixTrie(leaves, docs, np.bincount(key // len(names), minlength=len(leaves)), key % len(names), count, names)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix of long byte strings, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Counting:
    """What a task has counted since it last handed on its tries."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        self.docs: dict[str, Counter[bytes]] = defaultdict(Counter)

    def add(self, text: str | None, lang: str, source: str) -> None:
        found = Counter(terms(text, LETTERS))
        if found:
            self.counts[lang, source].update(found)
            self.docs[lang].update(found.keys())

    def entries(self) -> int:
        return sum(map(len, self.counts.values()))

    def tries(self) -> Iterator[tuple[str, RadixTrie]]:
        for lang, docs in self.docs.items():
            leaves = sorted(docs)
            place = {leaf: i for i, leaf in enumerate(leaves)}
            names = sorted(s for at, s in self.counts if at == lang)
            at, source, count = [], [], []
            for i, name in enumerate(names):
                counter = self.counts[lang, name]
                at.append(np.fromiter(map(place.__getitem__, counter), np.int64, len(counter)))
                source.append(np.full(len(counter), i))
                count.append(np.fromiter(counter.values(), np.int64, len(counter)))
            at = np.concatenate(at)
            order = np.argsort(at, kind="stable")
            yield lang, RadixTrie(leaves, np.fromiter((docs[x] for x in leaves), np.int64, len(leaves)), np.bincount(at, minlength=len(leaves)), np.concatenate(source)[order], np.concatenate(count)[order], names)


def counted(docs: DataFrame, prefix: int = 3, most_entries: int = 400_000) -> DataFrame:
    """lang, prefix, trie: the tries of each task over rows (text, lang, source), cut where the first ``prefix`` bytes change.

    A task hands on what it has after ``most_entries`` counters, so its memory is bounded.
    """
    schema = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("trie", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counting()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, trie in held.tries():
                ends = np.cumsum(trie.fan)
                heads = [leaf[:prefix] for leaf in trie.leaves]
                cuts = [i for i in range(len(heads)) if not i or heads[i] != heads[i - 1]] + [len(heads)]
                for some in range(0, len(cuts) - 1, 512):
                    spans = list(zip(cuts[some : some + 512], cuts[some + 1 : some + 513]))
                    rows = [trie.cut(a, z, ends).to_bytes() for a, z in spans]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array([heads[a] for a, _ in spans], pa.binary()), pa.array(rows, pa.binary())], schema=schema)

        for b in batches:
            for text, lang, source in zip(*(b.column(i).to_pylist() for i in range(3))):
                held.add(text, lang, source)
            if held.entries() >= most_entries:
                yield from out()
                held = _Counting()
        yield from out()

    return docs.mapInArrow(count, "lang string, prefix binary, trie binary")


def kept_terms(tries: DataFrame, least_docs: int = 30, most_bytes: int = 8_000_000) -> DataFrame:
    """lang, term, source, count: the leaves in ``least_docs`` documents of their language or more, in UTF-8 order within a prefix.

    The tries of a prefix meet in one task, which takes them one after the other and
    merges what it holds after ``most_bytes``; so it never holds more than that and
    the distinct terms of one prefix.
    """
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.list_(pa.string())), ("count", pa.list_(pa.int64()))])

    def leaves(lang: str, trie: RadixTrie) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(trie.fan)
        kept = np.flatnonzero(trie.docs >= least_docs)
        for some in range(0, len(kept), 2_000):
            rows = kept[some : some + 2_000]
            spans = [(int(ends[i] - trie.fan[i]), int(ends[i])) for i in rows]
            names = pa.array([[trie.names[s] for s in trie.source[a:z]] for a, z in spans], pa.list_(pa.string()))
            counts = pa.array([trie.count[a:z] for a, z in spans], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array([trie.leaves[i].decode("utf-8", "surrogatepass") for i in rows]), names, counts], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for b in batches:
            for lang, prefix, raw in zip(*(b.column(i).to_pylist() for i in range(3))):
                if key != (lang, prefix):
                    if held:
                        yield from leaves(key[0], RadixTrie.merged(held))
                    key, held, size = (lang, prefix), [], 0
                held.append(RadixTrie.from_bytes(raw))
                size += len(raw)
                if size >= most_bytes and len(held) > 1:
                    held, size = [RadixTrie.merged(held)], 0
        if held:
            yield from leaves(key[0], RadixTrie.merged(held))

    ordered = tries.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return ordered.mapInArrow(merge, "lang string, term string, source array<string>, count array<long>")


def shares(count: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + ADDED) / (total + ADDED n_terms)), exact: three decimal digits of the quotient at a time."""
    bottom = total + ADDED * n_terms
    rest = count + ADDED
    quotient = np.zeros(np.broadcast(rest, bottom).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // bottom
        rest = rest % bottom
    return quotient + 1


def _compared(kept: DataFrame, groups: list, n_terms: dict[str, int], top: int, cells: int) -> DataFrame:
    """Partial sums of pairs (part 'pair') and each group's ``top`` candidates in a task (part 'term'), streamed in order of the terms."""
    by_lang: dict[str, dict[str, int]] = defaultdict(dict)
    for r in groups:
        by_lang[r.lang][r.source] = r.total
    shared = kept.sparkSession.sparkContext.broadcast((dict(by_lang), n_terms))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n_terms = shared.value
        sources = {lang: list(found) for lang, found in totals.items()}
        numbers = {lang: {s: i for i, s in enumerate(found)} for lang, found in sources.items()}
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        sums: np.ndarray | None = None
        best: dict[int, list[tuple[int, bytes]]] = defaultdict(list)

        def rows(lang: str, of: list[str], part: str, items: list[str], values: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(items), pa.string()), pa.array(of, pa.string()), pa.array([part] * len(items), pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=schema)

        def add(lang: str, found: list[tuple[str, list[str], list[int]]]) -> None:
            nonlocal sums
            number, v = numbers[lang], n_terms[lang]
            total = np.array([totals[lang][s] for s in sources[lang]], np.int64)
            count = np.zeros((len(found), len(total)), np.int64)
            for i, (_, names, counts) in enumerate(found):
                count[i, [number[s] for s in names]] = counts
            p = shares(count, total[None, :], v)
            q = shares(count.sum(1), total.sum(), v)
            above = np.where(count > 0, p - q[:, None], 0)
            for s in range(len(total)):
                at = np.flatnonzero(above[:, s] > 0)
                if len(at) > top:
                    values = above[at, s]
                    at = at[values >= np.partition(values, len(at) - top)[len(at) - top]]
                mine = best[s]
                mine.extend((-int(above[i, s]), found[i][0].encode("utf-8", "surrogatepass")) for i in at)
                mine.sort()
                del mine[top:]
            columns = np.ascontiguousarray(p.T)
            if sums is None:
                sums = np.zeros((len(total), len(total)), np.int64)
            for i in range(1, len(total)):
                sums[i, :i] += np.abs(columns[:i] - columns[i]).sum(1)

        def done(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal sums
            for i, name in enumerate(sources[lang]):
                yield rows(lang, [name] * i, "pair", sources[lang][:i], sums[i, :i].tolist())
            for s, mine in best.items():
                yield rows(lang, [sources[lang][s]] * len(mine), "term", [t.decode("utf-8", "surrogatepass") for _, t in mine], [-v for v, _ in mine])
            sums = None
            best.clear()

        lang, found, size = None, [], 0
        for b in batches:
            for at, term, names, counts in zip(*(b.column(i).to_pylist() for i in range(4))):
                if found and (at != lang or size >= cells):
                    add(lang, found)
                    found, size = [], 0
                    if at != lang:
                        yield from done(lang)
                lang = at
                found.append((term, names, counts))
                size += len(sources[lang])
        if found:
            add(lang, found)
            yield from done(lang)

    return kept.mapInArrow(compare, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, cells: int = 1_000_000, task_terms: int = 10_000) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others, and the terms it has more of.

    Tasks count terms in radix tries with a counter per source, cut at prefixes; the
    tries of a prefix merge in one task. Of the merged tries only the terms that
    ``least_docs`` documents of the language hold are written. The tasks that read them
    again, ``task_terms`` each and in UTF-8 order, are sent the groups' totals (``MOST_GROUPS`` at a time,
    whole languages) and hand on, for each two sources, the sum of differences over
    their terms and, for each group, its ``top`` terms. Sums are added and candidates
    ranked by Spark. There is a row for each two sources of a language, as the result
    asks for.

    Null text, lang and source count as ''. A group without terms, or a language in
    which no term is kept, has pairs (of value 0 in the latter case) and no terms.
    Repeated rows count each time; equal values rank by their item's bytes. An empty
    table gives an empty result. Texts are read whole, whatever their length; other
    columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    plain = docs.select(blank(text_col).alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))
    kept = stash(kept_terms(counted(plain), least_docs))
    sums = kept.select("lang", F.explode(F.arrays_zip("source", "count")).alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.count").alias("total"))
    groups = stash(plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total"]))
    packs = max(1, math.ceil(groups.count() / MOST_GROUPS))
    found = []
    for pack in range(packs):
        mine = F.pmod(F.xxhash64("lang"), F.lit(packs)) == pack
        n_terms = {r.lang: r.n for r in kept.where(mine).groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if n_terms:
            # Each task hands on a row for each two sources and the candidates, so there are as few tasks as their terms allow.
            few = kept.where(mine).coalesce(math.ceil(sum(n_terms.values()) / task_terms)).sortWithinPartitions("lang", "term")
            found.append(_compared(few, groups.where(mine).collect(), n_terms, top, cells))
    a, b = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    pairs = a.join(b, "lang").where("source <> item")
    order = [F.desc("value"), F.asc("item")]
    if found:
        told = stash(reduce(DataFrame.unionByName, found))
        half = told.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        pairs = pairs.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"])
        candidates = told.where("part = 'term'").select("lang", "source", "item", "value")
    else:
        pairs, candidates = pairs.withColumn("value", F.lit(0).cast("long")), pairs.withColumn("value", F.lit(0).cast("long")).limit(0)
    by = Window.partitionBy("lang", "source").orderBy(*order)
    ranked = pairs.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    terms_ranked = candidates.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return ranked.unionByName(terms_ranked).select("lang", "source", "part", "item", "value", "rank")
