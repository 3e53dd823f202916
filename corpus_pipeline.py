"""The corpus pipeline: documents without toxic ones, exact and near copies, mixed by source and tokenized.

Each stage takes (spark, docs, sf_dir) and reads all that the stage before it
kept. All but the last give rows with the columns of ``documents``, whatever those
are called; the last adds the SentencePiece ids and the text that they decode to.
Null and empty texts are not toxic, are exact copies of one another, link with
nothing and are left out of the mix, as they have no words. An empty table gives an
empty one; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import exact_dedup, mixing, ngram_join, sentencepieces, toxicity
from tidewright.llm.common import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the severity model, trained on the labelled rows of these documents, does not call toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_rows(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, A-Z lower-cased, the one with the smallest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the smallest id."""
    return ngram_join.near_dedup(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as there are, from the sources by weight; a row for each time that words of a document are taken."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids (pieces) and what they decode to (decoded)."""
    return sentencepieces.encode(docs, decoded_col="decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: SQL can express neither the models nor the permutations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
