"""Mixing sources to target weights: token blocks, multinomial shard counts, index permutations, one join by index."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewright.llm.common import bounded_batches, free_name, row_keys, stash

#: More sources than this are joined instead of broadcast; a row of the plan has under 100 bytes beside its name.
MOST_BROADCAST = 50_000

#: Names of the columns that a mix has beside those of the documents, where they give way.
RESERVED = {"_h1", "_h2", "_s", "_source", "_bucket", "_base", "_inner", "_start", "_blocks", "_at", "_taken", "size", "source_size", "target", "taken", "n_shards"}


@F.pandas_udf(LongType())
def n_words(texts: pd.Series) -> pd.Series:
    """Runs of characters other than space and \\x09-\\x0D; 0 for null."""
    return pd.Series([len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts], dtype="int64")


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Each source's part of the sum of ``sizes`` by weight, stopped at ``most`` times its size; the excess is shared anew until none is above."""
    out, active, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while active:
        unit = rest / sum(weights[i] for i in active)
        over = [i for i in active if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in active:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            rest -= out[i]
        active = [i for i in active if i not in set(over)]
    return out


def shard_draws(slots: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Multinomial counts of each source for each output shard (rows), whose columns add up to ``slots`` exactly.

    A shard draws with probabilities in proportion to what the sources still
    have to give; what a draw asks for beyond that is drawn again, so that the
    last shard takes the remainder.
    """
    rng, left = np.random.default_rng(seed), slots.astype(np.int64).copy()
    out = np.zeros((n_shards, len(slots)), dtype=np.int64)
    for i in range(n_shards):
        need = math.ceil(left.sum() / (n_shards - i))
        while need > 0:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[i] += got
            left -= got
            need -= int(got.sum())
    return out


def rounded(wanted: list[float], most: list[int]) -> np.ndarray:
    """Whole numbers within 1 of ``wanted``, none above ``most``: the steps of the rounded running sum, so that the whole is kept."""
    ends = np.floor(np.cumsum([0.0, *wanted]) + 0.5)
    return np.minimum(np.diff(ends), np.array(most, dtype=float)).astype(np.int64)


def keys(seed: int, source: np.ndarray, again: np.ndarray) -> np.ndarray:
    """What picks a source's permutation for each time that all its blocks are used up."""
    return np.uint64(seed * 1_000_003) + source.astype(np.uint64) * np.uint64(0x9E3779B1) + again.astype(np.uint64) * np.uint64(0xC2B2AE35)


def slots_for(words: np.ndarray, size: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source that hold ``words`` words, and how many words its last slot takes.

    All blocks of a source have ``block`` words but its last one, which has what
    remains of ``size``. Rounds through all blocks take the whole source, so only
    the round that stays unfinished has to be looked at, and in it only whether
    the short block is among those taken.
    """
    blocks = -(-size // block)
    some = np.maximum(size, 1)
    full, rest = words // some, words % some
    short = size - (blocks - 1) * block
    place = np.zeros(len(size), dtype=np.int64)
    has = np.flatnonzero(size > 0)
    place[has] = permuted(blocks[has] - 1, blocks[has], keys(seed, has, full[has]), back=True)
    # Slots of the round if the short block comes after them; if it does not, the missing words take up to one slot more.
    n = -(-rest // block)
    among = (n > 0) & (place < n)
    n = np.where(among, -(-(rest + block - short) // block), n)
    before = (n - 1) * block - np.where(among & (place < n - 1), block - short, 0)
    ended = rest - before
    # Without an unfinished round the last slot takes its whole block.
    return full * blocks + n, np.where(n > 0, ended, block)


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4, back: bool = False) -> np.ndarray:
    """Position ``at`` (0 <= at < n) under a pseudorandom permutation of range(n) that ``key`` picks, or ``back`` under its inverse.

    A Feistel network over the next even power of two; positions that land at n
    or above walk on along their cycle.
    """
    at, n, key = at.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = (np.log2(np.maximum(n.astype(np.float64) - 1, 1)).astype(np.uint64) >> np.uint64(1)) + np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = at.copy(), np.arange(len(at))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        if back:
            left, right = right, left
        for r in reversed(range(rounds)) if back else range(rounds):
            mixed = (right + key[todo] + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (mixed >> np.uint64(31))) & mask[todo]
        if back:
            left, right = right, left
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, block: int = 128, shard_slots: int = 1024, bucket_rows: int = 2_000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """What a mix of as many words as ``docs`` has takes from each row.

    Sources in code point order, null last, weigh ``weights``, repeating. A
    source's words lie end to end, in an order that its rows' hashes fix, and are
    cut into blocks of ``block`` words. The mix has slots; each output shard draws
    how many slots each source fills, and a source's i-th slot holds block
    permutation(i), a new permutation each time all blocks are used up. A source's
    last slot takes only the words that are missing to its target, so each source
    gives its target, rounded to a whole word. As that is not more than ``most``
    times its size, no block is taken more often than ``most``, rounded up.

    Gives (rows, parts). rows has a row for each of ``docs``: _h1, _h2, its
    columns but the text and ``RESERVED`` names, size, source_size, target, taken
    and n_shards, the number of output shards that take words of it. parts has
    _h1, _h2, _s, _start, _from, _to, _slots, _times: for each row, the ranges of its
    words that blocks, or what a last slot takes of one, cover, the slots (slot,
    shard) that take each, and how many they are.

    Null and wordless texts have size 0 and are never taken. Repeated rows count
    as rows of their own. An empty table gives empty results. Positions are
    found by two running sums, over buckets of ``bucket_rows`` rows and within
    them, so that no task holds a whole source.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in RESERVED]
    keyed = docs.select(*row_keys(docs), *others, n_words(F.col(text_col)).alias("size"))
    sized = stash(keyed)
    totals = sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    totals.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    n_buckets = max(1, sum(r["rows"] for r in totals) // bucket_rows)
    wanted = targets([r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    blocks = [math.ceil(r["size"] / block) for r in totals]
    sizes = [int(r["size"]) for r in totals]
    slots, ended = slots_for(rounded(wanted, [math.floor(most * n) for n in sizes]), np.array(sizes, dtype=np.int64), block, seed)
    plan_rows = [(r["_source"], i, int(r["size"]), float(t), int(b)) for i, (r, t, b) in enumerate(zip(totals, wanted, blocks))]
    plan = spark.createDataFrame(plan_rows, "_source string, _s int, source_size long, target double, _blocks long")
    plan = F.broadcast(plan) if len(plan_rows) <= MOST_BROADCAST else plan
    rows = sized.join(plan, F.col(source_col).eqNullSafe(F.col("_source")), "left").drop("_source")

    rows = rows.withColumn("_bucket", F.pmod(F.col("_h1"), F.lit(n_buckets)))
    sums = rows.groupBy("_s", "_bucket").agg(F.sum("size").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_s", "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    inner = F.sum("size").over(Window.partitionBy("_s", "_bucket").orderBy("_h1", "_h2").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(starts, ["_s", "_bucket"]).withColumn("_start", F.col("_base") + F.col("_inner"))
    placed = stash(placed.drop("_bucket", "_base", "_inner"))

    total = int(slots.sum())
    n_shards = max(1, min(math.ceil(total / shard_slots), 4096, 2_000_000 // max(1, len(plan_rows))))
    draws = shard_draws(slots, n_shards, seed) if total else np.zeros((1, len(plan_rows)), dtype=np.int64)
    firsts = np.cumsum(draws, axis=0) - draws
    shard, source = np.nonzero(draws)
    blocks_of = np.array(blocks, dtype=np.int64)
    drawn = pd.DataFrame({"shard": shard, "_s": source, "first": firsts[shard, source], "n": draws[shard, source], "_blocks": blocks_of[source], "_slots": slots[source], "_ended": ended[source]})
    drawn = spark.createDataFrame(drawn.astype("int64"), "shard long, _s long, first long, n long, _blocks long, _slots long, _ended long")

    @F.pandas_udf("long")
    def block_of(slot: pd.Series, n: pd.Series, s: pd.Series) -> pd.Series:
        slot, n, s = (x.to_numpy() for x in (slot, n, s))
        return pd.Series(permuted(slot % n, n, keys(seed, s, slot // n)))

    filled = drawn.repartition("shard").select("shard", "_s", "_blocks", "_slots", "_ended", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    # A source's last slot may take the first words of its block only.
    words = F.when(F.col("slot") == F.col("_slots") - 1, F.col("_ended")).otherwise(F.lit(block))
    filled = filled.select("shard", "slot", F.col("_s").cast("int").alias("_s"), block_of("slot", "_blocks", "_s").alias("_block"), words.alias("_words"))
    # A block is in at most ``most`` slots, rounded up; a source's last slot is the last of its block's.
    taking = F.sort_array(F.collect_list(F.struct("slot", "shard")))
    times = filled.groupBy("_s", "_block").agg(taking.alias("_all"), F.min("_words").alias("_words"))
    end, b = F.col("_start") + F.col("size"), F.lit(block)
    spread = placed.where("size > 0").select("_h1", "_h2", "_s", "_start", "size", F.explode(F.sequence(F.floor(F.col("_start") / b), F.floor((end - 1) / b))).alias("_block"))
    low, high, split = F.greatest(F.col("_start"), F.col("_block") * b), F.least(end, (F.col("_block") + 1) * b), F.col("_block") * b + F.col("_words")
    ranges = F.array(
        F.struct((low - F.col("_start")).alias("_from"), (F.least(high, split) - F.col("_start")).alias("_to"), F.col("_all").alias("_slots")),
        F.struct((F.greatest(low, split) - F.col("_start")).alias("_from"), (high - F.col("_start")).alias("_to"), F.slice("_all", 1, F.size("_all") - 1).alias("_slots")),
    )
    parts = spread.join(times, ["_s", "_block"]).select("_h1", "_h2", "_s", "_start", F.inline(F.filter(ranges, lambda r: (r["_from"] < r["_to"]) & (F.size(r["_slots"]) > 0))))
    parts = stash(parts.withColumn("_times", F.size("_slots").cast("long")))
    shards = F.size(F.array_distinct(F.flatten(F.collect_list("_slots.shard"))))
    got = parts.groupBy("_s", "_start").agg(F.sum((F.col("_to") - F.col("_from")) * F.col("_times")).alias("_taken"), shards.cast("long").alias("_n"))
    # Rows without words share the place of the row after them, so they are kept out of the join's key.
    at = F.when(F.col("size") > 0, F.col("_start"))
    out = placed.withColumn("_at", at).join(got.withColumnRenamed("_start", "_at"), ["_s", "_at"], "left")
    out = out.withColumns({"taken": F.coalesce("_taken", F.lit(0)), "n_shards": F.coalesce("_n", F.lit(0))})
    return out.drop("_at", "_taken", "_n", "_start", "_s", "_blocks"), parts


_RUN = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, size: int, ranges: list[tuple[int, int]]) -> str:
    """The words of ``ranges`` (rising, apart) with what stands between them; the whole text where they are all its words."""
    if ranges == [(0, size)]:
        return text
    spans = [m.span() for m in _RUN.finditer(text)]
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in ranges)


def ranges_taken(parts: list[tuple[int, int, int]], times: int) -> list[tuple[int, int]]:
    """The ranges taken at least so many times, neighbours joined."""
    out: list[tuple[int, int]] = []
    for a, b, n in sorted(parts):
        if n >= times:
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def mixed(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **params) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each holds the words that one taking has of a row.

    A row whose words are taken up to n times gives n rows; the first has all
    its taken words, the next those taken twice, and so on. ``length_col``, if it
    is a column, gets the new text's length. Rows of which nothing is taken go, and so
    do null and wordless texts. Columns keep their names, whatever they are called.
    """
    _, parts = mix(docs, text_col, **params)
    lists = parts.groupBy("_h1", "_h2", "_start").agg(F.collect_list(F.struct("_from", "_to", "_times")).alias("_parts"))
    lists = lists.groupBy("_h1", "_h2").agg(F.collect_list("_parts").alias("_lists"))

    @F.pandas_udf("array<string>")
    def taken(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, lists):
            size, got = len(text.encode("utf-8", "surrogatepass").split()), []
            for one in found:
                bounds = [(p["_from"], p["_to"], p["_times"]) for p in one]
                got += [cut(text, size, ranges_taken(bounds, t)) for t in range(1, max(p[2] for p in bounds) + 1)]
            out.append(got)
        return pd.Series(out, dtype=object)

    whole, name = _with_lists(docs, lists)
    rows = whole.withColumn(name, F.explode(taken(F.col(text_col), F.col(f"{name}._lists"))))
    new = {text_col: F.col(name)} | ({length_col: F.length(name).cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return rows.withColumns(new).select(*docs.columns)


def _with_lists(docs: DataFrame, lists: DataFrame) -> tuple[DataFrame, str]:
    """Each different row of ``docs`` that has a row in ``lists`` (by _h1, _h2), that row as a struct column, and the column's name."""
    name, mine = free_name("_held", docs.columns), [free_name(c, docs.columns) for c in ("_own1", "_own2")]
    keyed = docs.withColumns(dict(zip(mine, row_keys(docs)))).dropDuplicates(mine)
    held = lists.select(F.struct(*lists.columns).alias(name))
    on = (F.col(mine[0]) == F.col(f"{name}._h1")) & (F.col(mine[1]) == F.col(f"{name}._h2"))
    return keyed.join(held, on).drop(*mine), name


def packed(docs: DataFrame, text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix as its output shards: shard, slot, source, n_words and text of each slot, a block of words of one source.

    A shard holds as many slots of each source as its multinomial draw says; write
    with ``partitionBy("shard")``. Words within a block stand in their order,
    parts of different rows on lines of their own. Repeated rows lie at places of
    their own; an empty table gives an empty result.
    """
    rows, parts = mix(docs, text_col, **params)
    slots = parts.select("_h1", "_h2", "_s", F.struct((F.col("_start") + F.col("_from")).alias("at"), "_from", "_to", "_slots").alias("_part"))
    lists = slots.groupBy("_h1", "_h2").agg(F.first("_s").alias("_s"), F.collect_list("_part").alias("_parts"))

    @F.pandas_udf("array<string>")
    def cuts(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, lists):
            spans = [m.span() for m in _RUN.finditer(text)]
            out.append([text[spans[p["_from"]][0] : spans[p["_to"] - 1][1]] for p in found])
        return pd.Series(out, dtype=object)

    whole, name = _with_lists(docs, lists)
    made = whole.select(F.col(source_col).alias("source"), F.col(f"{name}._s").alias("s"), F.col(f"{name}._parts").alias("parts"), cuts(F.col(text_col), F.col(f"{name}._parts")).alias("texts"))
    each = made.select("source", "s", F.explode(F.arrays_zip("parts", "texts")).alias("p"))
    each = each.select("source", "s", F.col("p.parts.at").alias("at"), (F.col("p.parts._to") - F.col("p.parts._from")).alias("n"), F.col("p.texts").alias("text"), F.explode("p.parts._slots").alias("to"))
    # A block has at most as many parts as words, so the lists are short.
    blocks = each.groupBy(F.col("to.shard").alias("shard"), "s", F.col("to.slot").alias("slot")).agg(F.first("source").alias("source"), F.sum("n").alias("n_words"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return blocks.select("shard", "slot", "source", "n_words", F.array_join("parts.text", "\n").alias("text"))
