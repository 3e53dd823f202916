"""Secrets in texts: fixed patterns, and a linear-chain conditional random field over tokens for those that they miss."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stash

#: Fixed values, in the order in which kinds are listed. Letters of the names match in either case, ASCII only.
KINDS = ("assign", "access", "hex", "field")
_ANY = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
_ASSIGN = re.compile("(" + "|".join([_ANY("password"), _ANY("passwd"), _ANY("secret"), _ANY("token"), _ANY("api") + "_?" + _ANY("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A text without any of these has no assigned value.
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Start, end and kind of the patterns' matches, leftmost and apart within a kind, by start and then kind.

    A hex run of 24 characters or more is found as such: a shorter run, which the
    plain pattern would find and drop, holds none.
    """
    low = text.lower()
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if any(name in low for name in _NAMES) else []
    out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def value_spans(text: str) -> list[Span]:
    """The patterns' matches without the names and marks before assigned values."""
    out = [(*m.span(2), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return out + [s for s in base_spans(text) if s[2] != "assign"]


#: Tags: a token begins a secret, is inside one, or outside.
B, I, O = range(3)  # noqa: E741
#: Features are hashed into so many columns.
COLUMNS = 4096

#: A token is a run of ASCII letters and digits, a run of other letters, or one mark; the white space before it comes with it.
_TOKEN = re.compile(r"[\x20\x09-\x0D]*(?:[A-Za-z0-9]+|[^\x00-\x7F]+|[^A-Za-z0-9\x20\x09-\x0D])")
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: What stands before and after a text's tokens.
_START, _END = ["<start>"] * 3, ["<end>"]


def tokens_of(text: str) -> list[str]:
    """The tokens, end to end from the start of ``text``; only white space follows the last."""
    return _TOKEN.findall(text.rstrip(_WHITE))


def shape(token: str) -> str:
    """Runs of capitals, small letters, digits and other characters as A, a, 0 and the character itself, run lengths left out."""
    if token.isascii() and token.isalpha() and (token.islower() or token.isupper()):
        return "a" if token.islower() else "A"
    kinds = re.sub("[0-9]+", "0", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", token)))
    return re.sub(r"[^\x00-\x7F]+", "u", kinds)[:24]


@lru_cache(100_000)
def _entropy(counts: tuple[int, ...]) -> float:
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts)


def _bits(token: str) -> float:
    """Entropy of the characters, in bits."""
    return _entropy(tuple(sorted(map(token.count, set(token)))))


@lru_cache(100_000)
def _column(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % COLUMNS


@lru_cache(100_000)
def _own_names(kind: str, gap: str, length: int, bits: int, hexed: bool, digits: int, upper: bool) -> list[str]:
    # Keys change between letters and digits at random; what counts is which kinds they have.
    kind = kind if len(kind) <= 4 else "mixed " + "".join(sorted(set(kind)))
    return ["bias", f"shape {kind}", f"length {length}", f"bits {bits}", f"hex {hexed} {length}", f"digits {digits} {length}", f"gap {gap}", f"gap {gap} {kind}", f"upper {upper} {length}"]


def _own_of(token: str) -> tuple:
    """All that the own features of a token depend on."""
    t = token.lstrip(_WHITE)
    gap = "glued" if len(t) == len(token) else "line" if "\n" in token else "space"
    digits = 0 if t.isalpha() else sum(map(str.isdigit, t))
    return shape(t), gap, min(8, len(t) // 4), int(_bits(t) * 2), not t.strip("0123456789abcdef"), digits * 4 // len(t), t.isupper()


def own_names(token: str) -> list[str]:
    """Features of a token by itself: its shape, length, entropy and alphabet, and the white space before it."""
    return _own_names(*_own_of(token))


def near_names(token: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """Features that a token gives to the one after it, the second, the third, and the one before it."""
    t = token.strip(_WHITE).lower()[:16]
    return [f"before {t}", f"before shape {shape(t)}"], [f"second {t}"], [f"third {t}"], [f"after {t}"]


@lru_cache(100_000)
def _own_columns(*of: object) -> list[int]:
    return [_column(x) for x in _own_names(*of)]


#: Checksums go on from where a name's beginning ends.
_BEGUN = [zlib.crc32(x) for x in (b"before ", b"second ", b"third ", b"after ")]


def columns_of(token: str) -> list[int]:
    """Columns of a token's own names and of those it gives to its neighbours, end to end; the same as by their names."""
    t = token.strip(_WHITE).lower()[:16]
    raw = t.encode("utf-8", "replace")
    before, second, third, after = (zlib.crc32(raw, x) % COLUMNS for x in _BEGUN)
    return [*_own_columns(*_own_of(token)), before, _column(f"before shape {shape(t)}"), second, third, after]


def mark_of(token: str) -> int:
    t = token.strip(_WHITE)
    return 1 if t in "=:" else 2 if t in "\"'" else 3 if t in "+/_.-" else 0


def look_of(token: str) -> int:
    t = token.strip(_WHITE)
    return min(7, len(t) // 4) * 4 + 2 * (not t.isalpha() and any(map(str.isdigit, t))) + (t != t.lower())


def token_features(padded: list[str], at: int, file: list[str]) -> list[int]:
    """Columns of a token of a text with ``_START`` and ``_END`` about it: its own, those by its neighbours, and what holds for its whole text."""
    near = near_names(padded[at - 1])[0] + near_names(padded[at - 2])[1] + near_names(padded[at - 3])[2] + near_names(padded[at + 1])[3]
    pair = f"pair {mark_of(padded[at - 1])} {look_of(padded[at])}"
    return [_column(x) for x in [*own_names(padded[at]), *near, pair, *file]]


def file_features(text: str) -> list[str]:
    lines = text.count("\n") + 1
    return [f"file assigns {min(3, text.count('='))}", f"file quotes {min(3, text.count(chr(34)) // 2)}", f"file digits {sum(map(text.count, '0123456789')) * 50 // len(text) if text else 0}", f"file line {min(8, len(text) // lines // 40)}"]


@dataclass(frozen=True)
class Field:
    """Weights of features by tag, and of a tag by the one before it; a sequence starts after outside."""

    emit: np.ndarray
    move: np.ndarray


#: Words of ASCII letters up to so long are learned together.
_WORD = 16
#: What tells the counts of a word's letters apart: so many letters can be there c times, in mixed radix.
_RADIX = np.concatenate([[0, 1], np.cumprod([_WORD // c + 1 for c in range(1, _WORD)])])


def word_case(word: str) -> int:
    """0 for small letters, 1 for capitals, 2 for a capital and small letters, all ASCII; -1 for whatever else or longer than ``_WORD``."""
    if len(word) > _WORD or not (word.isascii() and word.isalpha()):
        return -1
    return 0 if word.islower() else 1 if word.isupper() else 2 if word.istitle() else -1


def word_columns(tokens: list[str], words: list[str], cases: list[int]) -> np.ndarray:
    """``columns_of`` each token, for tokens that are white space and a word with a ``word_case``.

    Own columns depend on the case, the gap, the alphabet and the counts of the
    letters only, so they are worked out once for each that occurs.
    """
    letters = np.array([w.encode() for w in words], dtype=f"S{_WORD}").view(np.uint8).reshape(len(words), _WORD)
    same = letters[:, :, None] == letters[:, None, :]
    first = (same.argmax(axis=2) == np.arange(_WORD)) & (letters > 0)
    counts = (_RADIX[same.sum(axis=2) * first]).sum(axis=1)
    hexed = ((letters == 0) | ((letters >= 97) & (letters <= 102))).all(axis=1)
    gaps = [0 if len(w) == len(t) else 1 if "\n" in t else 2 for t, w in zip(tokens, words)]
    kinds = ((counts * 3 + np.array(cases)) * 3 + np.array(gaps)) * 2 + hexed
    _, some, kind = np.unique(kinds, return_index=True, return_inverse=True)
    own = np.array([_own_columns(*_own_of(tokens[i])) for i in some])[kind]
    low = [w.lower().encode() for w in words]
    before, second, third, after = (np.array([zlib.crc32(w, x) for w in low]) % COLUMNS for x in _BEGUN)
    return np.column_stack([own, before, np.full(len(low), _column("before shape a")), second, third, after])


class Scorer(dict):
    """Places of distinct tokens in a table of what each adds to its own score and to those of its neighbours."""

    def __init__(self, model: Field, most: int = 200_000) -> None:
        super().__init__()
        self.model, self.most = model, most
        self.pair = np.array([[model.emit[_column(f"pair {k} {c}")] for c in range(32)] for k in range(4)])
        self.table, self.kinds = np.empty((1024, 5, 3)), np.empty((1024, 2), dtype=np.int64)

    def learn(self, tokens: list[str]) -> None:
        """Gives places to tokens that have none, all at once."""
        first, end = len(self), len(self) + len(tokens)
        while end > len(self.table):
            self.table, self.kinds = (np.concatenate([x, np.empty_like(x)]) for x in (self.table, self.kinds))
        words = [t.lstrip(_WHITE) for t in tokens]
        cases = [word_case(w) for w in words]
        plain = [i for i, c in enumerate(cases) if c >= 0]
        columns, kinds = np.empty((len(tokens), 14), dtype=np.int64), np.empty((len(tokens), 2), dtype=np.int64)
        if plain:
            columns[plain] = word_columns([tokens[i] for i in plain], [words[i] for i in plain], [cases[i] for i in plain])
            kinds[plain] = [(0, min(7, len(words[i]) // 4) * 4 + (cases[i] > 0)) for i in plain]
        for i, case in enumerate(cases):
            if case < 0:
                columns[i], kinds[i] = columns_of(tokens[i]), (mark_of(tokens[i]), look_of(tokens[i]))
        each = self.model.emit[columns]
        # Nine columns of their own, two for the next token and one for each other neighbour.
        parts = (each[:, :9], each[:, 9:11], each[:, 11:12], each[:, 12:13], each[:, 13:])
        self.table[first:end] = np.stack([x.sum(axis=1) for x in parts], axis=1)
        self.kinds[first:end] = kinds
        self.update(zip(tokens, range(first, end)))

    def meet(self, tokens: set[str]) -> None:
        """Sees to it that all ``tokens`` have places; over ``most`` it starts anew."""
        if len(self) > self.most and not tokens <= self.keys():
            self.clear()
        fresh = sorted(tokens - self.keys())
        for k in range(0, len(fresh), 4096):
            self.learn(fresh[k : k + 4096])

    def __call__(self, tokens: list[str], file: list[str]) -> np.ndarray:
        """Scores of all tokens of a text by tag."""
        padded = [*_START, *tokens, *_END]
        try:
            at = np.fromiter(map(self.__getitem__, padded), np.int64, len(padded))
        except KeyError:
            self.meet(set(padded))
            at = np.fromiter(map(self.__getitem__, padded), np.int64, len(padded))
        own, table, kinds = at[3:-1], self.table, self.kinds
        out = table[own, 0] + table[at[2:-2], 1] + table[at[1:-3], 2] + table[at[:-4], 3] + table[at[4:], 4]
        out += self.pair[kinds[at[2:-2], 0], kinds[own, 1]]
        return out + self.model.emit[[_column(x) for x in file]].sum(axis=0)


#: The worker's scorer and the model that it is for: tasks that one Python worker runs in turn share what it has learned.
_SCORERS: dict[bytes, Scorer] = {}


def worker_scorer(key: bytes, model: Field) -> Scorer:
    """The scorer for ``model``, whose digest is ``key``; one for another model is let go."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model)
    return _SCORERS[key]


#: Moves that cannot be: inside follows begin or inside only.
_FORBIDDEN = np.array([[0, 0, 0], [0, 0, 0], [0, -np.inf, 0]])


def viterbi(emitted: np.ndarray, move: np.ndarray) -> list[int]:
    """The likeliest tags of a sequence that follows an outside token and is followed by one."""
    best, back = emitted[0] + (move + _FORBIDDEN)[O], []
    for e in emitted[1:]:
        each = best[:, None] + move + _FORBIDDEN
        back.append(each.argmax(axis=0))
        best = each.max(axis=0) + e
    tags = [int((best + move[:, O]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_field(sequences: list[tuple[list[list[int]], list[int]]], steps: int = 60, rate: float = 0.2, l2: float = 1e-5) -> Field:
    """Weights that maximise the penalised conditional likelihood of the tags, by Adam; gradients by forward and backward sums."""
    emit, move = np.zeros((COLUMNS, 3)), np.zeros((3, 3))
    emit[:, O] = 0.0
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    soft = np.where(np.isinf(_FORBIDDEN), -1e9, 0.0)
    by_length: dict[int, list[int]] = {}
    for i, (rows, _) in enumerate(sequences):
        by_length.setdefault(len(rows), []).append(i)
    total = max(1, sum(len(r) for r, _ in sequences))
    packed = []
    for n, group in by_length.items():
        columns = np.array([sequences[i][0] for i in group])
        packed.append((n, columns, np.array([sequences[i][1] for i in group])))
    for t in range(1, steps + 1):
        g_emit, g_move = l2 * emit, l2 * move
        trans = move + soft
        for n, columns, tags in packed:
            e = emit[columns].sum(axis=2)
            alpha, beta = np.empty_like(e), np.empty_like(e)
            alpha[:, 0] = e[:, 0] + trans[O]
            for k in range(1, n):
                alpha[:, k] = e[:, k] + _log_sum(alpha[:, k - 1][:, :, None] + trans[None], 1)
            beta[:, -1] = trans[:, O]
            for k in range(n - 2, -1, -1):
                beta[:, k] = _log_sum(trans[None] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            z = _log_sum(alpha[:, -1] + trans[:, O], 1)
            p = np.exp(alpha + beta - z[:, None, None])
            d = p - np.eye(3)[tags]
            for j in range(3):
                g_emit[:, j] += np.bincount(columns.ravel(), weights=np.repeat(d[:, :, j].ravel(), columns.shape[2]), minlength=COLUMNS) / total
            g_move[O] += d[:, 0].sum(axis=0) / total
            g_move[:, O] += d[:, -1].sum(axis=0) / total
            for k in range(1, n):
                q = np.exp(alpha[:, k - 1][:, :, None] + trans[None] + (e[:, k] + beta[:, k])[:, None, :] - z[:, None, None])
                true = np.zeros((3, 3))
                np.add.at(true, (tags[:, k - 1], tags[:, k]), 1)
                g_move += (q.sum(axis=0) - true) / total
        for value, g, (m, v) in ((emit, g_emit, state[:2]), (move, g_move, state[2:])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Field(emit, move)


def stretches(emitted: np.ndarray, move: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of tokens outside of which the likeliest tags of the whole chain are surely outside.

    A secret can be in the best chain only if its tokens gain over outside ones in
    sum. Each token's gain is at most its best tag's score with the best move to
    it, so one that is in no span with a positive sum of these is outside.
    """
    gain = (move + _FORBIDDEN - move[O, O]).ravel()[:-1].max()
    sums = np.concatenate([[0.0], np.cumsum(emitted[:, :O].max(axis=1) - emitted[:, O] + gain)])
    best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], best + max(0.0, gain) >= -1e-6, [0]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def places_of(tokens: list[str]) -> list[tuple[int, int]]:
    """Start, without the white space, and end of each token."""
    out, at = [], 0
    for t in tokens:
        end = at + len(t)
        out.append((end - len(t.lstrip(_WHITE)), end))
        at = end
    return out


def tags_of(places: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    tags, last = [], None
    for a, b in places:
        hit = next((s for s in spans if s[0] < b and a < s[1]), None)
        tags.append(O if hit is None else I if hit is last else B)
        last = hit
    return tags


def examples(text: str, spans: list[Span], about: int = 8, plain: int = 4, width: int = 24) -> list[tuple[list[list[int]], list[int]]]:
    """Feature columns and tags of a text whose secrets are ``spans``: of windows about each and of ``plain`` others without, all of it where it is short."""
    tokens = tokens_of(text)
    tags = tags_of(places_of(tokens), sorted(spans))
    n, file, padded = len(tokens), file_features(text), [*_START, *tokens, *_END]
    windows: list[tuple[int, int]] = [(0, n)] if 0 < n <= 2 * width else []
    if n > 2 * width:
        inside = [i for i, t in enumerate(tags) if t != O]
        for i in inside:
            if windows and i - about <= windows[-1][1]:
                windows[-1] = (windows[-1][0], min(n, i + 1 + about))
            else:
                windows.append((max(0, i - about), min(n, i + 1 + about)))
        for k in range(plain):
            a = k * (n - width) // plain
            if all(t == O for t in tags[a : a + width]):
                windows.append((a, a + width))
    return [([token_features(padded, i + 3, file) for i in range(a, b)], tags[a:b]) for a, b in windows]


_CUES = ("pwd: ", "pwd = ", "passphrase is ", "passphrase: ", "Bearer ", "my password is ", "login with ", "credential: ", "Authorization: Basic ", "private key:\n", "pin code ", "auth ")


def planted(text: str, seed: int, length: int = 160) -> tuple[str, list[Span]]:
    """The beginning of a text with a secret after a cue, of one token or several, or in one case of four an ordinary word after a cue."""
    rng, words = random.Random(seed), [w for w in text[: 4 * length].split() if w.isalpha() and w.isascii()] or ["word"]
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    small, mixed = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    joined = lambda: "".join(rng.choice(words).lower() for _ in range(4))[: rng.randint(12, 22)]
    kinds = (
        joined, joined, lambda: some(small, rng.randint(12, 24)), lambda: some(mixed, rng.randint(14, 30)), lambda: some(mixed + "0123456789", rng.randint(12, 40)),
        lambda: "\n".join(some(mixed + "0123456789+/", 32) for _ in range(rng.randint(2, 4))), lambda: rng.choice(" -").join(some("0123456789abcdef", 8) for _ in range(rng.randint(2, 5))),
        lambda: rng.choice("._/+-").join(some(mixed + "0123456789", rng.randint(6, 14)) for _ in range(rng.randint(2, 4))),
    )
    value, plain = rng.choice(kinds)(), rng.random() < 0.25
    value = rng.choice(words)[:10] if plain else value
    at = text.rfind(" ", 0, rng.randint(1, length)) + 1
    head = text[:at] + rng.choice(_CUES)
    tail = text[at : at + length]
    return f"{head}{value} {tail}", [] if plain else [(len(head), len(head) + len(value), "planted")]


def sliced(texts: pd.Series, most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in order, null ones as empty, as lists of up to ``most`` characters, or of one text that is longer."""
    out, size = [], 0
    for text in texts:
        text = text or ""
        if out and size + len(text) > most:
            yield out
            out, size = [], 0
        out.append(text)
        size += len(text)
    if out:
        yield out


def field_spans(text: str, model: Field | Scorer, known: list[Span], tokens: list[str] | None = None) -> list[Span]:
    """Secrets that the field finds apart from ``known``, by the likeliest tags of all tokens of the text; ``tokens`` are its ``tokens_of``."""
    scorer = model if isinstance(model, Scorer) else Scorer(model)
    tokens, found = tokens_of(text) if tokens is None else tokens, []
    if not tokens:
        return found
    emitted, move = scorer(tokens, file_features(text)), scorer.model.move
    ends = None
    for first, end in stretches(emitted, move):
        tags = viterbi(emitted[first:end], move)
        k = 0
        while k < len(tags):
            if tags[k] == O:
                k += 1
                continue
            last = k
            while last + 1 < len(tags) and tags[last + 1] == I:
                last += 1
            ends = ends if ends is not None else np.cumsum([len(t) for t in tokens]).tolist()
            a, b = ends[first + k] - len(tokens[first + k].lstrip(_WHITE)), ends[first + last]
            if not any(s[0] < b and a < s[1] for s in known):
                found.append((a, b, "field"))
            k = last + 1
    return found


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_texts: int = 2_000, longest: int = 120) -> Field | None:
    """Fit on the patterns' matches in at most ``most_texts`` texts that have some and as many others, those whose hash is lowest.

    Each text also gives one example with a planted secret, of one token or more.
    From the texts only windows of up to ``longest`` tokens reach the driver.
    None where there is no text, as in an empty table; planted secrets need no match.
    """
    likely = F.col("_text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    texts = docs.select(F.col(text_col).alias("_text")).where("_text is not null").withColumn("_likely", likely).withColumn("_h", F.xxhash64("_text"))
    # Twice sorted, once read: the patterns run over each text a single time.
    keys = stash(texts.select("_h", "_likely"))
    picked = [keys.where(c).distinct().orderBy("_h").limit(most_texts) for c in (F.col("_likely"), ~F.col("_likely"))]
    # At most 2 * most_texts hashes.
    sample = texts.join(F.broadcast(picked[0].union(picked[1]).select("_h")), "_h").select("_h", "_text")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, [x for r in rs for x in r], tags) for h, text in zip(b["_h"], b["_text"]) for rs, tags in [*examples(text, value_spans(text)), *examples(*planted(text, h))] if len(tags) <= longest]
            yield pd.DataFrame(rows, columns=["h", "columns", "tags"])

    got = sample.mapInPandas(each, "h long, columns array<int>, tags array<int>").withColumn("k", F.xxhash64("columns", "tags")).dropDuplicates(["k"]).orderBy(F.col("k")).limit(3 * most_texts).toPandas()
    if not len(got) or not any((np.asarray(t) != O).any() for t in got["tags"]):
        return None
    return fit_field([(np.asarray(c, dtype=np.int16).reshape(len(t), -1), list(t)) for c, t in zip(got["columns"], got["tags"])])


def scan(docs: DataFrame, model: Field | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, end, kind) by start and kind, over the whole text.

    Places are code points, ends exclusive. Kinds are those of the patterns and
    ``field``. Null and empty texts have none. Repeated rows get the same result.
    An empty table gives an empty result. A column ``secrets`` that ``docs`` has
    is replaced; all others stay. Long texts are tagged whole. Of equally likely
    tags begin goes before inside, and that before outside.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = b"" if model is None else hashlib.sha256(model.emit.tobytes() + model.move.tobytes()).digest()

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        scorer = None if shared.value is None else worker_scorer(key, shared.value)
        for part in sliced(texts):
            tokens = [tokens_of(t) if scorer is not None else [] for t in part]
            if scorer is not None:
                scorer.meet({*_START, *_END}.union(*tokens))
            for text, each in zip(part, tokens):
                known = base_spans(text)
                more = field_spans(text, scorer, known, each) if scorer is not None else []
                out.append([{"start": s, "end": e, "kind": k} for s, e, k in sorted([*known, *more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))])
        return pd.Series(out, dtype=object)

    return docs.withColumn("secrets", find(F.col(text_col)))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the patterns' spans and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "field")
    return scanned.select(id_col, *map(count, KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))
