"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import align, attribution, bpe, langid, lm, mixing, near, pieces, quality, shards, topk, toxicity, trie
from lodestone.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_copies(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_counts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op9_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assignment(table(spark, sf_dir, "documents"), 16)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), PIECES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.reported(table(spark, sf_dir, "documents"), BYTE_LEVEL, public_tokenizers.PATTERN, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_host_quality": op6_host_quality,
    "op7_exact_topk": op7_exact_topk,
    "op8_lm_scores": op8_lm_scores,
    "op9_interleaved_shards": op9_interleaved_shards,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_pieces": op11_pieces,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": near.ORACLE_SQL,
    "op6_host_quality": quality.oracle_sql(),
    "op9_interleaved_shards": shards.ORACLE_SQL,
    "op12_prefix_trie": trie.ORACLE_SQL,
    "op7_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
}
