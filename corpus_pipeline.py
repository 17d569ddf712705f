"""Corpus preparation: toxicity, language, near copies, mixing to target weights, tokens.

Each stage works on all rows that the one before kept. The first four return the columns of documents;
the last returns the digests of tokens and of the text they decode to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, langid, mixing, near, toxicity
from lodestone.llm.common import materialise, table
from lodestone.llm.queries import RANKS, public_tokenizers

#: Share of the tokens that the mixture takes.
SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under 0.5 for toxicity. Null and empty texts are scored like others, repeated rows alike; without labels
    of both classes all have the mean label as their score. Other columns stay as they are."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which one language has half of the letters at least. Those without a text or a letter go, and all go if no row
    has a language to learn from. Repeated rows are treated alike; other columns stay as they are."""
    return langid.with_a_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): that of the smallest doc_id. Rows that repeat a doc_id with different
    texts are documents of their own; texts without a word stay. Other columns stay as they are."""
    return near.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes. Null sources and languages are categories; rows that repeat a doc_id share its chance. Targets
    that the documents can't meet warn. Other columns stay as they are."""
    return mixing.sample(docs, SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each document; null and empty texts have no tokens."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: Models and iterated fits aren't SQL; tests/llm/test_contracts.py compares each stage and the whole with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and reread as the next stage's input. No rows give no rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
