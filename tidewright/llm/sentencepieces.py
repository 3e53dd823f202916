"""SentencePiece encoding and decoding of BPE models, with giant texts cut into chunks that are encoded in parallel.

A BPE segmentation is the only one whose neighbouring pieces are all stable: merging
the two of them from their characters gives them back. That makes encoding a path
problem with score 0 for a stable pair and minus infinity for any other, so the
max-plus parallel scan applies: a chunk's transfer matrix says which piece over its
left edge can lead to which piece over its right edge, matrices multiply
associatively, and once the piece over each edge is known, every chunk is traced
back by itself. The result is the library's own, also where chunks end inside words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidewright.llm.common import bounded_batches, row_keys, stash

#: Where the public tokenizers' files lie, by default.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"

SPACE = "▁"
_FRAGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")

#: Memoised fragments; the memo starts anew when it is full.
MOST_KEPT = 50_000

State = tuple[int, int]  # a piece's first character and the end after its last, from the edge that it lies over


class Pieces:
    """One model: the library's processor and what the scan needs to know of its pieces."""

    def __init__(self, proto: bytes) -> None:
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.longest = max(map(len, self.ids))
        #: Whether every piece keeps to one side of a place where a space follows another character.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        if sp.encode("a  b") != sp.encode("a", out_type=int) + sp.encode(" b", out_type=int):
            raise ValueError("only BPE models that keep white space and put one space before the text are supported")
        self.bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]
        self.kept: dict[str, bytes] = {}
        self.stable = lru_cache(50_000)(self._stable)

    def fragment(self, f: str) -> list[int]:
        """Ids of spaces and the characters after them."""
        if f == SPACE:
            return [self.ids[SPACE]] if SPACE in self.ids else self.spell(SPACE)
        return self.sp.encode(f[1:])

    def spell(self, char: str) -> list[int]:
        """A character's id, or those of its bytes."""
        return [self.ids[char]] if char in self.ids else self.sp.encode(char)[-len(char.encode()) :]

    def run(self, text: str) -> np.ndarray:
        """Ids of a text, its spaces escaped, that begins with a space and ends where another would begin, or the whole text does."""
        kept = self.kept
        if len(kept) > MOST_KEPT:
            kept.clear()
        out: list[bytes] = []
        for f in _FRAGMENT.findall(text) if SPACE * 2 in text else [SPACE + w for w in text.split(SPACE)[1:]]:
            ids = kept.get(f)
            if ids is None:
                ids = np.array(self.fragment(f), dtype=np.int32).tobytes()
                if len(f) <= 64:
                    kept[f] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def encode(self, text: str | None) -> np.ndarray:
        """What the library gives for the whole text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        return self.run(SPACE + text.replace(" ", SPACE)) if self.apart else np.array(self.sp.encode(text), dtype=np.int32)

    def decode(self, ids, first: bool = True) -> str:
        """The text of the ids; without the space that encoding puts before it, where they are a text's ``first``."""
        table = self.bytes
        raw = b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        return (raw[1:] if first and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best pair is merged, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stable(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def starting(self, text: str, at: int) -> list[int]:
        """Where the pieces that begin at ``at`` can end."""
        return [at + n for n in range(1, min(self.longest, len(text) - at) + 1) if n == 1 or text[at : at + n] in self.ids and self.merged(text[at : at + n]) == [text[at : at + n]]]

    def over(self, text: str, edge: int) -> list[State]:
        """The pieces that hold the character before ``edge``."""
        return [(s, e) for s in range(max(0, edge - self.longest), edge) for e in self.starting(text, s) if e >= edge]

    def walk(self, text: str, begin: dict[State | None, int], until: int, clean: int = -1) -> tuple[dict[State, int], dict[State, list[State]]]:
        """From pieces, each with the set (bits) of origins that reach it, to those over the edge ``until``.

        Gives their sets of origins, and for each piece on the way those that may
        stand before it. ``begin`` None is a start at ``clean`` with nothing before.
        """
        ending: dict[int, dict[State, int]] = {}
        before: dict[State, list[State]] = {}
        last: dict[State, int] = {}
        for state, origins in begin.items():
            place = ending.setdefault(clean if state is None else state[1], {})
            place[(clean, clean) if state is None else state] = origins
        for at in range(min(ending, default=until), until):
            for e in self.starting(text, at) if at in ending else ():
                origins = 0
                for s, _ in ending[at]:
                    if s == at or self.stable(text[s:at], text[at:e]):
                        origins |= ending[at][s, at]
                        before.setdefault((at, e), []).append((s, at))
                if origins:
                    (last if e >= until else ending.setdefault(e, {}))[at, e] = origins
        for state, origins in ending.get(until, {}).items():
            if state[1] == until and state[0] < until:
                last[state] = last.get(state, 0) | origins
        return last, before

    def cuts(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """The first and the last place in [low, high] where a space follows another character."""
        if not self.apart:
            return None
        first = re.compile(f"(?<=[^{SPACE}]){SPACE}").search(text, low, high)
        if not first:
            return None
        at = text.rfind(SPACE, first.start(), high)
        while text[at - 1] == SPACE:
            at -= 1
        return first.start(), max(at, first.start())


@lru_cache(2)
def pieces(proto: bytes) -> Pieces:
    return Pieces(proto)


def load(spark: SparkSession, model_file: str = MODEL_FILE) -> bytes:
    """The model's bytes, read by Spark from any path that its file systems know."""
    path = model_file if "://" in model_file else f"file://{model_file}"
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


# A chunk is a row: text (with self.longest characters more on either side), low and high (its edges within it), first, last.


def transfer(p: Pieces, text: str, low: int, high: int, first: bool) -> tuple[list[State], list[State], list[int]]:
    """Left states, right states (both from their edges) and, for each right one, the bits of the left ones that lead to it."""
    left: list[State | None] = [None] if first else list(p.over(text, low))
    begin = {s: 1 << i for i, s in enumerate(left)}
    found = p.cuts(text, max(low, 1), high)
    if found is None:
        right, _ = p.walk(text, begin, high, low)
    else:
        # Beyond a cut nothing depends on what stands before it: the matrix is a column times a row.
        head, _ = p.walk(text, begin, found[0], low)
        reached = 0
        for (_, e), origins in head.items():
            reached |= origins if e == found[0] else 0
        right, _ = p.walk(text, {None: reached}, high, found[1]) if found[1] < high else ({s: reached for s in p.over(text, high) if s[1] == high}, {})
    return [(0, 0) if s is None else (s[0] - low, s[1] - low) for s in left], [(s - high, e - high) for s, e in right], list(right.values())


def traced(p: Pieces, text: str, low: int, high: int, left: State | None, right: State) -> list[int]:
    """Ids of the pieces after ``left`` up to and with ``right``."""

    def back(begin: State | None, clean: int, end: State, until: int) -> list[int]:
        _, before = p.walk(text, {begin: 1}, until, clean)
        path, at = [], end
        stop = (clean, clean) if begin is None else begin
        while at != stop:
            path.append(at)
            at = before[at][0] if len(before[at]) == 1 else next(x for x in before[at] if x == stop or x in before)
        return [i for s, e in reversed(path) for i in ([p.ids[text[s:e]]] if text[s:e] in p.ids else p.spell(text[s:e]))]

    start = None if left is None else (left[0] + low, left[1] + low)
    end = (right[0] + high, right[1] + high)
    found = p.cuts(text, max(low, 1), high)
    if found is None:
        return back(start, low, end, high)
    first, last = found
    out: list[int] = []
    if start is None or start[1] < first:
        states, _ = p.walk(text, {start: 1}, first, low)
        out += back(start, low, next(s for s in states if s[1] == first), first)
    out += p.run(text[first:last]).tolist()
    return out + (back(None, last, end, high) if last < high else [])


def compose(a: dict[State, set[State]], b: dict[State, set[State]]) -> dict[State, set[State]]:
    """The max-plus product of two matrices of 0 and minus infinity: for each state, those that lead to it."""
    return {right: set().union(*(a.get(mid, ()) for mid in mids)) for right, mids in b.items()}


def solve_edges(chunks: list[tuple[list[State], list[State], list[int]]]) -> list[tuple[State, State]]:
    """The states over the left and right edge of each chunk on the only whole path."""
    maps = [{r: {left[i] for i in range(len(left)) if bits >> i & 1} for r, bits in zip(right, origins)} for left, right, origins in chunks]
    prefix = [maps[0]]
    for m in maps[1:]:
        prefix.append(compose(prefix[-1], m))
    at = next(s for s, mids in prefix[-1].items() if s[1] == 0 and mids)
    out = []
    for i in range(len(maps) - 1, -1, -1):
        left = next(s for s in maps[i][at] if i == 0 or prefix[i - 1].get(s))
        out.append((left, at))
        at = left
    return out[::-1]


def encode(docs: DataFrame, model_file: str = MODEL_FILE, text_col: str = "text", out_col: str = "pieces", decoded_col: str | None = None, chunk: int = 16_384) -> DataFrame:
    """``docs`` with ``out_col``: the ids (array of int) of the whole text; and with ``decoded_col``, if named, what they decode to, in the same pass.

    Texts over twice ``chunk`` characters are cut into chunks of that size, spread
    over tasks; the others are encoded as they are. Null and empty texts give an
    empty array. Repeated rows get the same result; columns of the new names are
    replaced.
    """
    made = [c for c in (out_col, decoded_col) if c]
    docs = docs.drop(*made)
    bounded_batches(docs.sparkSession)
    proto = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, model_file))
    kinds = [StructField(out_col, ArrayType(IntegerType(), False)), StructField(decoded_col or "", StringType())][: len(made)]
    schema = StructType([*docs.schema.fields, *kinds])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(proto.value)
        # Long texts have many ids: some hundred rows at a time bound what a task holds.
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            ids = [p.encode(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            columns = [*b.columns, pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, dtype=np.int32), *ids]))]
            if decoded_col:
                columns.append(pa.array([p.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *made])

    size = F.coalesce(F.length(text_col), F.lit(0))
    short = docs.where(size <= 2 * chunk).mapInArrow(whole, schema)

    keys = row_keys(docs)
    giant = docs.where(size > 2 * chunk).withColumns({"_h1": keys[0], "_h2": keys[1]})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        longest = pieces(proto.value).longest
        for b in batches:
            for h1, h2, text in zip(b["_h1"], b["_h2"], b["_text"]):
                text = SPACE + text.replace(" ", SPACE)
                n = -(-len(text) // chunk)
                for i in range(n):
                    low, high = i * chunk, min(len(text), (i + 1) * chunk)
                    base = max(0, low - longest)
                    yield pd.DataFrame({"_h1": [h1], "_h2": [h2], "i": [i], "text": [text[base : high + longest]], "low": [low - base], "high": [high - base]})

    texts = giant.select("_h1", "_h2", F.col(text_col).alias("_text")).dropDuplicates(["_h1", "_h2"])
    cut = texts.mapInPandas(chunks, "_h1 long, _h2 long, i int, text string, low int, high int")
    cut = stash(cut.repartition("_h1", "_h2", "i"))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(proto.value)
        for b in batches:
            got = [transfer(p, t, low, high, i == 0) for t, low, high, i in zip(b["text"], b["low"], b["high"], b["i"])]
            flat = lambda states: [x for s in states for x in s]
            bits = [[",".join(str(k) for k in range(len(left)) if o >> k & 1) for o in origins] for left, _, origins in got]
            yield b[["_h1", "_h2", "i"]].assign(left=[flat(x[0]) for x in got], right=[flat(x[1]) for x in got], origins=bits)

    def solve(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("i")
        pairs = lambda flat: [(int(x), int(y)) for x, y in zip(flat[::2], flat[1::2])]
        origins = [[sum(1 << int(k) for k in o.split(",") if k) for o in row] for row in b["origins"]]
        edges = solve_edges([(pairs(x), pairs(y), o) for x, y, o in zip(b["left"], b["right"], origins)])
        return b[["_h1", "_h2", "i"]].assign(edges=[[*x, *y] for x, y in edges])

    edges = cut.mapInPandas(matrices, "_h1 long, _h2 long, i int, left array<int>, right array<int>, origins array<string>").groupBy("_h1", "_h2").applyInPandas(solve, "_h1 long, _h2 long, i int, edges array<int>")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(proto.value)
        for b in batches:
            ids = [traced(p, t, low, high, None if i == 0 else (e[0], e[1]), (e[2], e[3])) for t, low, high, i, e in zip(b["text"], b["low"], b["high"], b["i"], b["edges"])]
            said = [p.decode(x, i == 0) if decoded_col else "" for x, i in zip(ids, b["i"])]
            yield b[["_h1", "_h2", "i"]].assign(ids=ids, said=said)

    parts = cut.join(edges, ["_h1", "_h2", "i"]).mapInPandas(trace, "_h1 long, _h2 long, i int, ids array<int>, said string")
    # A text's ids are about as large as the text, which is one row already.
    joined = parts.groupBy("_h1", "_h2").agg(F.array_sort(F.collect_list(F.struct("i", "ids", "said"))).alias("_parts"))
    whole_ids = F.flatten(F.transform("_parts", lambda x: x["ids"])).alias(out_col)
    whole_text = [F.array_join(F.transform("_parts", lambda x: x["said"]), "").alias(decoded_col)] if decoded_col else []
    long = giant.join(joined, ["_h1", "_h2"]).select(*docs.columns, whole_ids, *whole_text)
    return short.unionByName(long)


def decode(rows: DataFrame, model_file: str = MODEL_FILE, ids_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    """``rows`` with ``out_col``: the text of the ids; empty for null. It is the encoded text, but for U+2581, which gives a space."""
    proto = rows.sparkSession.sparkContext.broadcast(load(rows.sparkSession, model_file))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        p = pieces(proto.value)
        return pd.Series([p.decode(x) if x is not None else "" for x in ids], dtype=object)

    return rows.withColumn(out_col, text(F.col(ids_col)))
