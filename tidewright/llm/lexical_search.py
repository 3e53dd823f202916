"""Ranked lexical search: a blocked sparse product of items with terms and terms with documents, in 64-bit integers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, stash

#: Bytes to bytes: A-Z to a-z, every other ASCII byte but a-z and 0-9 to a space.
LETTERS_AND_DIGITS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms(text: str | None, table: bytes = LETTERS_AND_DIGITS) -> list[bytes]:
    """The terms of a whole text as UTF-8: what ``table`` maps to spaces parts them; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


@dataclass(frozen=True)
class ItemBlock:
    """Rows of the item-term matrix: item ``i`` has ``times[ends[i-1]:ends[i]]`` of the terms ``at[...]``."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    ends: np.ndarray
    at: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list) -> ItemBlock:
        vocabulary: dict[bytes, int] = {}
        at, times, ends = [], [], []
        for _, text in rows:
            for term, n in Counter(terms(text)).items():
                at.append(vocabulary.setdefault(term, len(vocabulary)))
                times.append(n)
            ends.append(len(at))
        return ItemBlock([r[0] for r in rows], vocabulary, np.array(ends, np.int64), np.array(at, np.int64), np.array(times, np.int64))


_POSTED = "id long, n long, at array<int>, tf array<long>, totals boolean"


def _postings(docs: DataFrame, block: ItemBlock) -> DataFrame:
    """For each document its id, number of terms and the block's terms in it; for each task a row of totals.

    The totals' row has the number of documents with terms as id, of terms as n and
    of documents with a term as that term's tf.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        df = np.zeros(len(vocabulary), np.int64)
        with_terms = in_all = 0
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())), ("totals", pa.bool_())])
        for b in batches:
            lengths, at, tf, ends = [], [], [], [0]
            for text in b.column(1).to_pylist():
                found = terms(text)
                lengths.append(len(found))
                counts = Counter(found)
                for term in counts.keys() & vocabulary.keys():
                    at.append(vocabulary[term])
                    tf.append(counts[term])
                ends.append(len(at))
            of = np.array(at, np.int32)
            df += np.bincount(of, minlength=len(df))
            with_terms += sum(n > 0 for n in lengths)
            in_all += sum(lengths)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values) for values in (pa.array(of), pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), *lists, pa.array([False] * len(lengths))], schema=schema)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([with_terms]), pa.array([in_all]), pa.array([held.astype(np.int32)], pa.list_(pa.int32())), pa.array([df[held]], pa.list_(pa.int64())), pa.array([True])], schema=schema)

    return docs.mapInArrow(read, _POSTED)


def _best(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores, equal ones by ascending id, rows without an id last."""
    if len(scores) > k:
        enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids, absent = scores[enough], ids[enough], absent[enough]
    order = np.lexsort((ids, absent, -scores))[:k]
    return scores[order], ids[order], absent[order]


def _ranked(posted: DataFrame, block: ItemBlock, weights: np.ndarray, n_docs: int, n_terms: int, k: int, most_postings: int) -> DataFrame:
    """Each task's ``k`` best documents for each item of the block."""
    shared = posted.sparkSession.sparkContext.broadcast((block.ends, block.at, block.times * weights[block.at]))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, item_terms, values = shared.value
        starts = np.append(0, ends[:-1])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best = [none] * len(ends)

        def add(parts: list[pa.RecordBatch]) -> None:
            """One block of the documents' side: its rows by term, then each item's rows merged into one row of scores."""
            rows = pa.Table.from_batches(parts).combine_chunks()
            ids = rows.column("id")
            absent = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            m = np.array([75 + 25 * n * n_docs // n_terms for n in rows.column("n").to_pylist()], np.int64)
            lists = rows.column("at").combine_chunks()
            column = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
            at, tf = np.asarray(lists.flatten()), np.asarray(rows.column("tf").combine_chunks().flatten())
            impact = (1_000_000_000 * tf) // (1_000 * tf + 12 * m[column])
            order = np.argsort(at, kind="stable")
            column, impact = column[order], impact[order]
            bounds = np.searchsorted(at[order], np.arange(len(weights) + 1))
            for i, (a, z) in enumerate(zip(starts, ends)):
                total = np.zeros(len(ids), np.int64)
                for t, value in zip(item_terms[a:z], values[a:z]):
                    lo, hi = bounds[t], bounds[t + 1]
                    # A term holds a document once, so no index repeats.
                    total[column[lo:hi]] += value * impact[lo:hi]
                scores, had, lacked = best[i]
                least = scores[k - 1] if len(scores) == k else 1
                new = np.flatnonzero(total >= least)
                if len(new):
                    best[i] = _best(np.append(scores, total[new]), np.append(had, ids[new]), np.append(lacked, absent[new]), k)

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten()) + len(b)
            if size >= most_postings:
                add(held)
                held, size = [], 0
        if held:
            add(held)
        for i, (scores, ids, absent) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(scores), pa.int32()), pa.array(ids, mask=absent), pa.array(scores)], names=["_slot", "doc_id", "score"])

    return posted.mapInArrow(multiply, "_slot int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 4_000_000, most_postings: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score above 0.

    The items are dealt by hash into blocks of some ``block_bytes`` of text, so that
    what the tasks are sent of a block (its matrix and its terms) has that bound,
    give or take a text that is longer by itself. For each block every document is
    read once for its postings, which are written; their totals give the weights.
    The product then takes the documents' postings in blocks of ``most_postings``,
    adds up an item's terms row by row (exact in int64) and keeps the item's ``k``
    best; what tasks found meets in two windows, the first of them salted.

    A null or empty text has no terms: such items get no rows, such documents none
    and they count in no total. Equal scores go by ascending id, documents without an
    id last. Every row is a document or an item of its own, repeated ones too: a
    repeated item has its ranks for each of its rows. Without documents or items
    the result is empty. Texts are read whole, whatever their length; other columns
    are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = stash(items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text is not null"))
    size, n_items = asked.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n_blocks = max(1, min(n_items, math.ceil((size or 0) / block_bytes)))
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = []
    for b in range(n_blocks):
        block = ItemBlock.of(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id").collect())
        if not len(block.at):
            continue
        posted = stash(_postings(plain, block))
        totals = posted.where("totals")
        n_docs, n_terms = totals.agg(F.sum("id"), F.sum("n")).first()
        if not n_terms:
            break
        df = np.zeros(len(block.vocabulary), np.int64)
        per_term = totals.select(F.explode(F.arrays_zip("at", "tf")).alias("x")).groupBy("x.at").agg(F.sum("x.tf").alias("df"))
        for at, n in per_term.toLocalIterator():
            df[at] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        rows = _ranked(posted.where("not totals and n > 0").drop("totals"), block, weights, n_docs, n_terms, k, most_postings)
        names = spark.createDataFrame(list(enumerate(block.ids)), "_slot int, item_id long")
        found.append(_top(rows, k).join(F.broadcast(names), "_slot").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    part = rows.withColumn("rank", F.row_number().over(Window.partitionBy("_slot", salt).orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("_slot").orderBy(*order))).where(F.col("rank") <= k)
