"""A log-bilinear language model in two levels, trained with noise-contrastive estimation, and a smoothed unigram beside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, stash

#: The end of a text, a token of its own. No word can be it.
END = b"\n"

#: Shape classes of words that are too rare for a class of their own: by last byte, script and length.
SHAPES = 24

#: Up to so many classes are each a group of their own; more are put into groups of at most ``WIDEST``.
FLAT, WIDEST = 512, 4096

#: So many groups there are for a root of the number of classes.
GROUPS = 0.8

#: Contexts of two of the so many most frequent tokens have their groups' normaliser in a table.
FREQUENT = 480

#: After two of so many classes the groups' normaliser is a sum of products, without exponentials; those whose logits are as large as this may leave the range of floats.
PRODUCTS, LARGE = 12_288, 40.0

#: So many tokens are scored at a time, and tokens of so many bytes are counted at a time.
SCORED, COUNTED = 262_144, 1 << 26

#: Parameters of so many classes are averaged in a task's group of rows.
STRIPE = 256


def shape(word: bytes) -> int:
    last = word[-1:]
    ending = 0 if last.isalnum() or last >= b"\x80" else 1 if last == b"." else 2 if last == b"," else 3 if last in b"!?;:" else 4 if last in b"#$%&*|" else 5
    return ending * 4 + 2 * (not word.isascii()) + (len(word) > 7)


@dataclass(frozen=True)
class Vocabulary:
    """Counts over the training tokens: their number, the number of distinct ones, the most frequent ones, and sums by shape class.

    ``rank`` has the ``len(counts)`` most frequent tokens. The first ``own`` of
    them are classes of the model; all others belong to the class of their shape.
    """

    n: int
    v: int
    rank: dict[bytes, int]
    counts: np.ndarray
    own: int
    shape_n: np.ndarray
    shape_v: np.ndarray

    @property
    def classes(self) -> int:
        return self.own + SHAPES

    def class_of_rank(self) -> np.ndarray:
        return np.array([i if i < self.own else self.own + shape(w) for w, i in self.rank.items()], dtype=np.int64)

    def class_counts(self) -> np.ndarray:
        """Training tokens of each class, and 1 more."""
        return np.concatenate([self.counts[: self.own], self.shape_n]).astype(float) + 1

    def log_within(self) -> np.ndarray:
        """log10 of what each shape class's token counts, plus 1 each, add up to, with 1 for words never seen."""
        return np.log10(self.shape_n + self.shape_v + 1.0)


def batch_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of a batch of texts one after another, as ``common.words`` has them, and each text's number of them; without the ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, to = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(found), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return found.filter(full), np.diff(before[to])


def count_tokens(docs: DataFrame, text_col: str = "text", most_held: int = COUNTED) -> DataFrame:
    """token (binary) and n over all rows of ``docs``; each task adds up ``most_held`` bytes of tokens at a time before the shuffle."""

    def told(held: list[pa.Array]) -> pa.RecordBatch:
        counts = pa.concat_arrays(held).value_counts()
        return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["token", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for b in batches:
            if not len(b):
                continue
            held.append(batch_words(b.column(0))[0])
            size, ends = size + held[-1].nbytes, ends + len(b)
            if size >= most_held:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["token", "n"])
        # The worker goes on to other tasks, which need this memory.
        held = []
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(each, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")


def vocabulary(counts: DataFrame, head: int = 200_000, own: int = 200_000) -> Vocabulary:
    """``counts`` in sum, and its ``head`` most frequent tokens, equal counts by token: a bounded number reaches the driver.

    A histogram over sixteenths of powers of two, of at most a thousand bins, says
    which bins fit whole. Of the bin at the border the first tokens fill what is left.
    """
    place = F.floor(F.log2("n") * 16)
    bins = counts.groupBy(place.alias("bin")).agg(F.count("*").alias("v"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    held, least, border = 0, 2**62, None
    for one in bins:
        if held + one["v"] > head:
            border = one["bin"]
            break
        held, least = held + one["v"], one["least"]
    chosen = counts.where(F.col("n") >= least)
    if border is not None and held < head:
        chosen = chosen.unionByName(counts.where(place == border).orderBy(F.desc("n"), "token").limit(head - held))
    top = chosen.toPandas()
    top = top.assign(token=[bytes(t) for t in top["token"]]).sort_values(["n", "token"], ascending=[False, True])

    def by_shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"shape": [shape(bytes(t)) for t in b["token"]], "n": b["n"]})

    tokens = list(top["token"])
    own = min(own, len(tokens))
    sums = counts.mapInPandas(by_shape, "shape int, n long").groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    shape_n, shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
    shape_n[sums["shape"]], shape_v[sums["shape"]] = sums["n"], sums["v"]
    n, v = int(shape_n.sum()), int(shape_v.sum())
    for t, c in zip(tokens[:own], top["n"][:own]):
        shape_n[shape(t)] -= c
        shape_v[shape(t)] -= 1
    return Vocabulary(n, v, {t: i for i, t in enumerate(tokens)}, top["n"].to_numpy(dtype=np.int64), own, shape_n, shape_v)


def group_starts(class_counts: np.ndarray) -> np.ndarray:
    """Where each group of classes starts, and the number of classes.

    Neighbours in rank share a group. Words with more than a mean group's tokens
    are groups of one, and so are the shape classes. Of the others a group takes
    the next ones until the roots of their counts add up to its share: for a
    given number of groups, a mean over tokens of the classes of the token's
    group is least if groups are as large as one over the root of a word's count.
    """
    k = len(class_counts)
    if k <= FLAT:
        return np.arange(k + 1)
    body = class_counts[: k - SHAPES]
    share, most = body / body.sum(), int(np.ceil(np.sqrt(k) * GROUPS))
    alone = int(np.argmin(np.append(share * np.sqrt(k) >= 1, False)))
    roots = np.sqrt(share[alone:])
    group = np.floor((np.cumsum(roots) - roots) / roots.sum() * max(1, most - alone))
    starts = np.concatenate([np.arange(alone), alone + np.flatnonzero(np.diff(group, prepend=-1)), [len(body)]])
    split = [np.arange(x, y, WIDEST) for x, y in zip(starts[:-1], starts[1:])]
    return np.concatenate([*split, np.arange(len(body), k + 1)])


@dataclass
class LogBilinear:
    """A class given the two before it: its group, then the class within the group, each normalised.

    Both scores are x . output + bias, where x = sum over the two of input *
    position. ``inputs``, ``outputs`` and ``bias`` have a row for each class,
    ``tops`` and ``top_bias`` one for each group.
    """

    inputs: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    tops: np.ndarray
    top_bias: np.ndarray
    positions: np.ndarray
    starts: np.ndarray
    _products: tuple[np.ndarray, np.ndarray, np.ndarray] | None = field(default=None, init=False, repr=False, compare=False)

    @classmethod
    def start(cls, class_counts: np.ndarray, dim: int = 16, seed: int = 3) -> LogBilinear:
        rng, k = np.random.default_rng(seed), len(class_counts)
        starts = group_starts(class_counts)
        sums = np.add.reduceat(class_counts, starts[:-1])
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        bias = np.log(class_counts / np.repeat(sums, np.diff(starts)))
        return cls(small(k, dim), small(k, dim), bias.astype(np.float32), small(len(sums), dim), np.log(sums / sums.sum()).astype(np.float32), np.ones((2, dim), dtype=np.float32), starts)

    def group_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def context(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        x = self.inputs.take(p1, axis=0) * self.positions[0]
        x += self.inputs.take(p2, axis=0) * self.positions[1]
        return x

    def rows(self) -> np.ndarray:
        """The parameters of the classes as a matrix with a row for each."""
        return np.hstack([self.inputs, self.outputs, self.bias[:, None]])

    def shared(self) -> np.ndarray:
        """All other parameters in a row: those of the groups and the positions."""
        return np.concatenate([self.tops.ravel(), self.top_bias, self.positions.ravel()])

    def with_rows(self, rows: np.ndarray, shared: np.ndarray) -> LogBilinear:
        d, n = self.tops.shape[1], len(self.top_bias)
        rows, shared = rows.astype(np.float32), shared.astype(np.float32)
        parts = np.ascontiguousarray(rows[:, :d]), np.ascontiguousarray(rows[:, d : 2 * d]), rows[:, -1].copy()
        return LogBilinear(*parts, shared[: n * d].reshape(n, d), shared[n * d : n * d + n], shared[n * d + n :].reshape(2, d), self.starts)

    def tables(self, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probabilities of the groups after two of the first ``most`` classes, as three parts: by (previous, group), by (one before it, group) and the normaliser of the two.

        The normaliser of all pairs takes one matrix product for each first class.
        """
        first, second = ((self.inputs[:most] * self.positions[i]) @ self.tops.T for i in (0, 1))
        second = second + self.top_bias
        norm = np.empty((len(first), len(first)), dtype=np.float32)
        x = np.hstack([self.inputs[:most] * self.positions[1], np.ones((len(norm), 1), dtype=np.float32)])
        for i in range(len(norm)):
            norm[i] = _log_sum(x, np.vstack([self.tops.T, self.top_bias + first[i]]))
        return np.stack([first, second]).astype(np.float32), norm

    def log_p(self, p1: np.ndarray, p2: np.ndarray, c: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Natural log-probabilities of classes ``c``, normalised over all groups and then over the group's classes."""
        norm = tables[1]
        groups = self.group_of().astype(np.uint16 if len(self.starts) <= 1 << 16 else np.int64).take(c)
        x = self.context(p1, p2)
        out = np.einsum("ij,ij->i", x, self.tops.take(groups, axis=0)).astype(np.float64) + self.top_bias[groups]
        held = (p1 < len(norm)) & (p2 < len(norm))
        out[held] -= norm[p1[held], p2[held]]
        rest = np.flatnonzero(~held)
        if len(rest):
            # Each two classes that stand before a token are normalised once.
            k = len(self.bias)
            two, which = np.unique(p1[rest] * k + p2[rest], return_inverse=True)
            out[rest] -= self._log_norm(two // k, two % k)[which]
        wide = np.flatnonzero(np.diff(self.starts)[groups] > 1)
        # Small whole numbers are sorted by digits.
        wide = wide[np.argsort(groups[wide], kind="stable")]
        if not len(wide):
            return out
        # A last column of ones takes the biases into the matrix products.
        x, c = np.hstack([x.take(wide, axis=0), np.ones((len(wide), 1), dtype=np.float32)]), c[wide]
        inside = np.einsum("ij,ij->i", x[:, :-1], self.outputs.take(c, axis=0)) + self.bias[c]
        ends = [*_runs(groups[wide]).tolist(), len(wide)]
        for a, b in zip(ends[:-1], ends[1:]):
            lo, hi = self.starts[groups[wide[a]]], self.starts[groups[wide[a]] + 1]
            inner = np.vstack([self.outputs[lo:hi].T, self.bias[lo:hi]])
            # Blocks of about so many numbers stay in a core's cache.
            step = max(1, 262_144 // int(hi - lo))
            for i in range(a, b, step):
                j = min(i + step, b)
                inside[i:j] -= _log_sum(x[i:j], inner)
        out[wide] += inside
        return out

    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials of what each of the first classes adds to the groups' logits as the previous and as the one before it, and whether both are far within the range of floats."""
        if self._products is None:
            first, second = ((self.inputs[:PRODUCTS] * self.positions[i]) @ self.tops.T for i in (0, 1))
            second += self.top_bias
            small = (np.abs(first).max(axis=1) < LARGE) & (np.abs(second).max(axis=1) < LARGE)
            with np.errstate(over="ignore"):
                self._products = np.exp(first, out=first), np.exp(second, out=second), small
        return self._products

    def _log_norm(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """The groups' normaliser after each two classes."""
        first, second, small = self.products()
        out = np.empty(len(p1), dtype=np.float32)
        m = len(small)
        known = (p1 < m) & (p2 < m)
        known[known] = small[p1[known]] & small[p2[known]]
        at = np.flatnonzero(known)
        for i in range(0, len(at), 128):
            some = at[i : i + 128]
            out[some] = np.einsum("ij,ij->i", first.take(p1[some], axis=0), second.take(p2[some], axis=0))
        out[at] = np.log(out[at])
        at = np.flatnonzero(~known)
        tops = np.vstack([self.tops.T, self.top_bias])
        x = np.hstack([self.context(p1[at], p2[at]), np.ones((len(at), 1), dtype=np.float32)])
        for i in range(0, len(at), 512):
            out[at[i : i + 512]] = _log_sum(x[i : i + 512], tops)
        return out


def _log_sum(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of the exponentials of each row of ``x @ by``; rows that leave the range of floats are shifted first."""
    ones = np.ones(by.shape[1], dtype=by.dtype)
    logits = x @ by
    with np.errstate(over="ignore"):
        sums = np.exp(logits, out=logits) @ ones
    if not (sums.min() > 1e-30 and sums.max() < 1e30):
        logits = x @ by
        top = logits.max(axis=1)
        return top + np.log(np.exp(logits - top[:, None]) @ ones)
    return np.log(sums)


def _sigma(z: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.exp(np.negative(z, out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _order(index: np.ndarray) -> np.ndarray:
    """``np.argsort`` of whole numbers below 2**31, equal ones in their order. Numbers with their places in the low bits are sorted faster than places."""
    keys = index << 32
    keys |= np.arange(len(index))
    keys.sort()
    keys &= 0xFFFFFFFF
    return keys


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _sums(rows: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``rows`` in ``order``. Most runs are of one row, which is taken as it is."""
    sizes = np.diff(np.append(starts, len(order)))
    out, more = rows.take(order[starts], axis=0), sizes > 1
    if more.any():
        out[more] = np.add.reduceat(rows.take(order[np.repeat(more, sizes)], axis=0), np.cumsum(sizes[more]) - sizes[more], axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation by Adagrad in both levels; a minibatch shares its noise groups, and in each group its noise classes.

    Only the rows of classes that a minibatch has change. ``touched`` counts how often each one did.
    """

    def __init__(self, model: LogBilinear, class_counts: np.ndarray, rng: np.random.Generator, noise: int = 24, within: int = 8, rate: float = 0.05, rate_rows: float = 0.05, squares_rows: float = 1e-2) -> None:
        self.m, self.rng, self.noise, self.within, self.rate, self.rate_rows, self.seen = model, rng, noise, within, rate, rate_rows, 0
        self.group_of, self.wide = model.group_of(), np.flatnonzero(np.diff(model.starts) > 1)
        self.wide_of = np.full(len(model.starts) - 1, -1)
        self.wide_of[self.wide] = np.arange(len(self.wide))
        sums = np.add.reduceat(class_counts, model.starts[:-1])
        p = sums / sums.sum()
        self.cumulative, self.log_kq = np.cumsum(p), np.log(noise * p).astype(np.float32)
        self.below = np.concatenate([[0.0], np.cumsum(class_counts)])
        self.log_kw = np.log(within * class_counts / sums[self.group_of]).astype(np.float32)
        self.squares = [np.full_like(x, 1e-3) for x in (model.tops, model.top_bias, model.positions)]
        self.squares_rows = [np.full_like(x, squares_rows) for x in (model.inputs, model.outputs, model.bias)]
        self.touched = np.zeros(len(model.bias), dtype=np.int64)

    def _change(self, index: np.ndarray, times: np.ndarray, *grads: tuple[int, np.ndarray, np.ndarray]) -> None:
        """Adagrad on the rows ``index`` (repeating) of class parameters: each with its number, values and gradients."""
        order = _order(index)
        ordered = index[order]
        starts = _runs(ordered)
        rows = ordered[starts]
        for i, value, grad in grads:
            sums = _sums(grad, order, starts)
            squares = self.squares_rows[i].take(rows, axis=0)
            squares += sums * sums
            self.squares_rows[i][rows] = squares
            sums *= self.rate_rows
            sums /= np.sqrt(squares, out=squares)
            value[rows] = value.take(rows, axis=0) - sums
        self.touched[rows] += len(grads) * np.add.reduceat(times[order], starts)

    def step(self, p1: np.ndarray, p2: np.ndarray, c: np.ndarray) -> None:
        # In the order of classes, the tokens of a class and of a group lie together.
        order = _order(c)
        p1, p2, c = p1[order], p2[order], c[order]
        m, n, groups = self.m, len(c), self.group_of[c]
        r1, r2 = m.inputs.take(p1, axis=0), m.inputs.take(p2, axis=0)
        x = r1 * m.positions[0] + r2 * m.positions[1]
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise)), len(m.top_bias) - 1)
        starts = _runs(groups)
        here, sizes = groups[starts], np.diff(np.append(starts, n))
        good, bad = m.tops.take(groups, axis=0), m.tops[drawn]
        g = (_sigma(np.einsum("ij,ij->i", x, good) + m.top_bias[groups] - self.log_kq[groups]) - 1).astype(np.float32)
        h = _sigma(x @ bad.T + (m.top_bias[drawn] - self.log_kq[drawn]))
        dx = g[:, None] * good + h @ bad
        d_tops, d_bias = np.zeros_like(m.tops), np.zeros_like(m.top_bias)
        d_tops[here], d_bias[here] = np.add.reduceat(g[:, None] * x, starts, axis=0), np.add.reduceat(g, starts)
        np.add.at(d_tops, drawn, h.T @ x)
        np.add.at(d_bias, drawn, h.sum(axis=0))
        wide = self.wide_of[here] >= 0
        if wide.any():
            self._within(x, c, dx, here[wide], starts[wide], sizes[wide])
        d_pos = np.stack([np.einsum("ij,ij->j", dx, r1), np.einsum("ij,ij->j", dx, r2)])
        for value, grad, squares in zip((m.tops, m.top_bias, m.positions), (d_tops, d_bias, d_pos), self.squares):
            grad = grad / n
            squares += grad * grad
            value -= self.rate * grad / np.sqrt(squares)
        self._change(np.concatenate([p1, p2]), np.ones(2 * n, dtype=np.int64), (0, m.inputs, np.concatenate([dx * m.positions[0], dx * m.positions[1]])))
        self.seen += n

    def _within(self, x: np.ndarray, c: np.ndarray, dx: np.ndarray, here: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """The second level for the groups ``here``, whose tokens lie together: changes the classes' outputs and adds to the gradient by ``x``."""
        m, k = self.m, self.within
        lo, hi = m.starts[here], m.starts[here + 1]
        u = self.below[lo][:, None] + self.rng.random((len(here), k)) * (self.below[hi] - self.below[lo])[:, None]
        drawn = np.clip(np.searchsorted(self.below, u, side="right") - 1, lo[:, None], hi[:, None] - 1)
        first = np.cumsum(sizes) - sizes
        at = np.repeat(starts - first, sizes) + np.arange(sizes.sum())
        x, c = x.take(at, axis=0), c[at]
        good, bad = m.outputs.take(c, axis=0), m.outputs.take(drawn, axis=0)
        g = (_sigma(np.einsum("ij,ij->i", x, good) + m.bias[c] - self.log_kw[c]) - 1).astype(np.float32)
        # A last column of ones takes the biases into the products; a last row counts as nothing.
        n, d = x.shape
        x1, bad1 = np.zeros((n + 1, d + 1), dtype=np.float32), np.empty((*drawn.shape, d + 1), dtype=np.float32)
        x1[:-1, :-1], x1[:-1, -1] = x, 1
        bad1[:, :, :-1], bad1[:, :, -1] = bad, m.bias[drawn] - self.log_kw[drawn]
        more, d_bad1 = np.empty_like(x1[:, :-1]), np.empty_like(bad1)
        # Groups whose sizes have as many binary digits are done together, filled up to the largest with that last row.
        digits = np.frexp(sizes - 0.5)[1]
        for some in [np.flatnonzero(digits == x) for x in np.unique(digits)]:
            place = np.arange(sizes[some].max())
            place = np.where(place < sizes[some][:, None], first[some][:, None] + place, n)
            held = x1.take(place, axis=0)
            h = _sigma(held @ bad1[some].transpose(0, 2, 1))
            more[place] = h @ bad[some]
            d_bad1[some] = h.transpose(0, 2, 1) @ held
        more = more[:-1] + g[:, None] * good
        dx[at] = dx.take(at, axis=0) + more
        runs = _runs(c)
        index = np.concatenate([c[runs], drawn.ravel()])
        times = np.concatenate([np.diff(np.append(runs, len(c))), np.ones(drawn.size, dtype=np.int64)])
        d_out = np.concatenate([_sums(g[:, None] * x, np.arange(n), runs), d_bad1[:, :, :-1].reshape(-1, d)])
        d_bias = np.concatenate([np.add.reduceat(g, runs), d_bad1[:, :, -1].ravel()])
        self._change(index, times, (1, m.outputs, d_out), (2, m.bias, d_bias))


class Coder:
    """Tokens of texts as ranks and classes, the end after each text's words."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.head, self.values = len(vocab.rank), pa.array(list(vocab.rank), pa.binary())
        self.class_of = np.concatenate([vocab.class_of_rank(), vocab.own + np.arange(SHAPES)])
        self.end_code = vocab.rank.get(END, self.head + shape(END))
        self.end = int(self.class_of[self.end_code])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Each text's number of tokens, the tokens' ranks (-1 beyond the head) and classes, and the words beyond the head, all in order."""
        found, n = batch_words(texts)
        ranks = pc.index_in(found, value_set=self.values)
        rare = found.filter(ranks.is_null())
        codes = ranks.fill_null(-1).to_numpy().astype(np.int64)
        distinct = rare.dictionary_encode()
        shapes = np.array([shape(w) for w in distinct.dictionary.to_pylist()], dtype=np.int64)
        codes[codes < 0] = self.head + shapes[distinct.indices.to_numpy()]
        n = n + 1
        ends = np.cumsum(n) - 1
        word = np.ones(len(codes) + len(n), dtype=bool)
        word[ends] = False
        every = np.full(len(word), self.end_code, dtype=np.int64)
        every[word] = codes
        return n, np.where(every < self.head, every, -1), self.class_of[every], rare

    def contexts(self, n: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes one and two places before each; before a text stand ends, as one does after the text before it."""
        before = np.concatenate([[self.end, self.end], classes])
        p1, p2 = before[1:-1], before[:-2].copy()
        p2[np.cumsum(n) - n] = self.end
        return p1, p2


def train(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", batch: int = 8192, **params) -> LogBilinear:
    """One pass over every row: each task trains on its rows from the same start, and the tasks' parameters are averaged.

    A class's parameters are averaged over the tasks that changed them, by how
    often each did, and those that all classes share by tokens. Tasks send
    only what they changed.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    sent = pa.schema([("stripe", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("weight", pa.binary()), ("values", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = Coder(shared.value), shared.value.class_counts()
        rng = np.random.default_rng(TaskContext.get().partitionId())
        trainer = Trainer(LogBilinear.start(sizes), sizes, rng, **params)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def run() -> None:
            p1, p2, c = (np.concatenate(x) for x in zip(*held))
            order = rng.permutation(len(c))
            for i in range(0, len(c), batch):
                at = order[i : i + batch]
                trainer.step(p1[at], p2[at], c[at])

        for b in batches:
            if not len(b):
                continue
            n, _, classes, _ = coder(b.column(0))
            tokens, ends = (*coder.contexts(n, classes), classes), np.cumsum(n)
            done = 0
            while done < len(classes):
                # Whole texts, until there are enough.
                last = min(np.searchsorted(ends, done + 64 * batch - size), len(ends) - 1)
                held.append(tuple(x[done : ends[last]] for x in tokens))
                size, done = size + len(held[-1][0]), ends[last]
                if size >= 64 * batch:
                    run()
                    held, size = [], 0
        if held:
            run()
        for some in _sent(trainer):
            yield pa.RecordBatch.from_pandas(some, schema=sent, preserve_index=False)

    def mean(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        base, size = (key[0] * STRIPE, STRIPE) if key[0] >= 0 else (0, 1)
        n, sums = np.zeros(size, dtype=np.int64), None
        for p in parts.sort_values("part").itertuples():
            at, weight = np.frombuffer(p.at, np.int32) - base, np.frombuffer(p.weight, np.int64)
            values = np.frombuffer(p.values, np.float32).reshape(len(at), -1).astype(float)
            sums = np.zeros((size, values.shape[1])) if sums is None else sums
            n[at] += weight
            sums[at] += weight[:, None] * values
        at = np.flatnonzero(n)
        values = (sums[at] / n[at][:, None]).astype(np.float32).tobytes() if len(at) else b""
        return pd.DataFrame({"stripe": [key[0]], "part": [0], "at": [(at + base).astype(np.int32).tobytes()], "weight": [b""], "values": [values]})

    kind = "stripe int, part int, at binary, weight binary, values binary"
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(each, kind).groupBy("stripe").applyInPandas(mean, kind).toPandas()
    model = LogBilinear.start(vocab.class_counts())
    rows, rest = model.rows(), model.shared()
    for one in found.itertuples():
        at = np.frombuffer(one.at, np.int32)
        values = np.frombuffer(one.values, np.float32).reshape(len(at), -1) if len(at) else None
        if len(at) and one.stripe < 0:
            rest = values[0]
        elif len(at):
            rows[at] = values
    return model.with_rows(rows, rest)


def _sent(trainer: Trainer, together: int = 64) -> Iterator[pd.DataFrame]:
    """What a task learnt: in stripe -1 the parameters that all share, and the classes it changed, in stripes, so many at a time."""
    m, at, part = trainer.m, np.flatnonzero(trainer.touched), TaskContext.get().partitionId()
    columns = ["stripe", "part", "at", "weight", "values"]
    yield pd.DataFrame([(-1, part, np.zeros(1, np.int32).tobytes(), np.array([trainer.seen], np.int64).tobytes(), m.shared().astype(np.float32).tobytes())], columns=columns)
    stripes = np.split(at, np.flatnonzero(np.diff(at // STRIPE)) + 1) if len(at) else []
    for i in range(0, len(stripes), together):
        out = []
        for some in stripes[i : i + together]:
            rows = np.hstack([m.inputs[some], m.outputs[some], m.bias[some, None]])
            out.append((int(some[0]) // STRIPE, part, some.astype(np.int32).tobytes(), trainer.touched[some].tobytes(), rows.tobytes()))
        yield pd.DataFrame(out, columns=columns)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head: int = 200_000, own: int = 200_000, **params) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row; the model learns from those not held out.

    Whole texts are scored; null counts as empty and has the end token only.
    base_score is the add-one unigram's log10 probability. score is the
    log-bilinear model's: the class of each token given the two before it,
    normalised over all classes. The ``own`` most frequent tokens are classes of
    their own; any other has its shape class's probability times its add-one share
    within that.

    Counts of the ``head`` most frequent tokens, a bounded number, go to every
    task. Of other tokens a text sends each distinct one once, to be joined with
    the counts; none of these is frequent, so no key is hot. Repeated rows get
    a result each. Without training rows every count is 0. An empty table gives
    an empty result; other columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession, 500)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    counts = stash(count_tokens(base.where("not held")))
    vocab = vocabulary(counts, head, own)
    model = train(base.where("not held"), vocab, **params)
    shared = base.sparkSession.sparkContext.broadcast((vocab, model, model.tables(FREQUENT)))
    id_type = docs.schema[id_col].dataType

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model, tables = shared.value
        coder, within = Coder(vocab), np.log10(vocab.counts + 1.0) if len(vocab.counts) else np.zeros(1)
        share = np.concatenate([np.zeros(vocab.own), vocab.log_within()])
        for b in batches:
            if not len(b):
                continue
            n, ranks, c, rare = coder(b.column(2))
            p1, p2 = coder.contexts(n, c)
            logs = np.concatenate([model.log_p(p1[i : i + SCORED], p2[i : i + SCORED], c[i : i + SCORED], tables) for i in range(0, len(c), SCORED)])
            known, starts = ranks >= 0, np.cumsum(n) - n
            counted = np.where(known, within[ranks], 0.0)
            inside = np.where(c >= vocab.own, counted - share[c], 0.0)
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), counted, logs / np.log(10) + inside)]
            ids, hashes = b.column(0), b.column(1)
            own = pa.array([b" " + str(h).encode() + b" " + str(i).encode() for h, i in zip(hashes, ids)], pa.binary())
            # Each distinct token of a text beyond the head goes out once; an end is one where the head is small.
            text, word = np.repeat(np.arange(len(n)), n), np.ones(len(c), dtype=bool)
            word[starts + n - 1] = False
            rare = rare.dictionary_encode()
            size = max(1, len(rare.dictionary))
            pairs, times = np.unique(text[word & ~known] * size + rare.indices.to_numpy(), return_counts=True)
            ends = np.flatnonzero(~known[starts + n - 1])
            pick = pa.array(np.concatenate([np.arange(len(n)), pairs // size, ends]))
            tokens = pa.concat_arrays([own, rare.dictionary.take(pa.array(pairs % size)), pa.array([END] * len(ends), pa.binary())])
            times = pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(np.concatenate([times, np.ones(len(ends), dtype=np.int64)]))])
            columns = [ids.take(pick), hashes.take(pick), b.column(3).take(pick), tokens, times]
            columns += [pa.concat_arrays([pa.array(x), pa.nulls(len(pick) - len(n), t)]) for x, t in zip((n, *sums), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "h", "held", "token", "times", "n", "known", "base", "score"])

    keyed = base.select("_id", F.xxhash64(F.col("text").isNull(), "text").alias("h"), "text", "held")
    schema = f"_id {id_type.simpleString()}, h long, held boolean, token binary, times long, n long, known long, base double, score double"
    rows = keyed.mapInArrow(each, schema)
    rare = counts
    if vocab.rank:
        # The head ends within the tokens of one count, at this token.
        least, last = int(vocab.counts[-1]), F.lit(bytearray(next(reversed(vocab.rank))))
        rare = counts.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("token") > last)))
    joined = rows.join(rare.withColumnRenamed("n", "c"), "token", "left")
    log_c = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))
    total = joined.groupBy("_id", "h", "held").agg(
        F.count("n").alias("copies"),
        F.max("n").alias("n_tokens"),
        (F.sum("known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("times"))), F.lit(0))).alias("known"),
        (F.sum("base") + F.coalesce(F.sum(log_c), F.lit(0.0))).alias("base"),
        (F.sum("score") + F.coalesce(F.sum(log_c), F.lit(0.0))).alias("score"),
    )
    # The classes' shares of rare tokens were taken off in the tasks; here their counts come back.
    each_row = total.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    space = float(np.log10(vocab.n + vocab.v + 1.0))
    return each_row.select(
        F.col("_id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") - F.col("n_tokens") * space).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"),
    )
