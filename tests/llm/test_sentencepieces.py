import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewright.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_FILE)


@pytest.fixture(scope="module")
def model():
    with open(sp.MODEL_FILE, "rb") as f:
        return sp.Pieces(f.read())


def chunked(p, text, size):
    text = sp.SPACE + text.replace(" ", sp.SPACE)
    rows = []
    for i in range(-(-len(text) // size)):
        low, high = i * size, min(len(text), (i + 1) * size)
        base = max(0, low - p.longest)
        rows.append((text[base : high + p.longest], low - base, high - base, i))
    edges = sp.solve_edges([sp.transfer(p, t, low, high, i == 0) for t, low, high, i in rows])
    return [x for (t, low, high, i), (left, right) in zip(rows, edges) for x in sp.traced(p, t, low, high, None if i == 0 else left, right)]


def texts(n):
    rng = random.Random(5)
    for _ in range(n):
        alphabet = rng.choice(["ab", "the ", "  a", "aei ou\n", "0123 .", "日本のé a", " \n", "aaaa", "==--", "international"])
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 150)))
        yield "".join(rng.choice(["inter", "nation", "al", " ", "iz", "THE", "    ", "\t", "é", "日", "\x00"]) for _ in range(40))


def test_ids_are_the_library_s(library, model):
    for text in texts(150):
        want = library.encode(text)
        assert model.encode(text).tolist() == want
        assert chunked(model, text, 17 + len(text) % 20) == want
        assert model.decode(want) == text


def test_matrix_product_is_associative(model):
    rng = random.Random(1)
    states = [(-i, j) for i in range(1, 4) for j in range(3)]
    m = [{s: {t for t in states if rng.random() < 0.3} for s in states} for _ in range(3)]
    assert sp.compose(sp.compose(m[0], m[1]), m[2]) == sp.compose(m[0], sp.compose(m[1], m[2]))


def test_encode_and_decode(spark, library):
    rows = [(0, None), (1, ""), (2, " "), (3, "plain text, twice"), (3, "plain text, twice"), (None, "x"), (4, "word " * 5000), (5, "nospaces" * 4000), (6, "日本" * 3000), (6, "日本" * 3000), (7, "▁a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pieces": F.lit("clash"), "i": F.lit(1)})
    rows_of = sp.encode(docs, decoded_col="same", chunk=997)
    got = sp.decode(rows_of).collect()
    assert all(r.same == r.decoded for r in got)
    assert sorted([(r.doc_id, r.pieces, r.decoded) for r in got], key=str) == sorted([(i, library.encode(t or ""), (t or "").replace("▁", " ")) for i, t in rows], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sp.decode(sp.encode(docs)).count() == 0
