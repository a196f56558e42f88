"""From raw documents to token ids: five stages, each one operator, each writing Parquet for the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracepairs.llm.bpe_tree import bpe_round_trip
from tracepairs.llm.common import materialize, stage_tables
from tracepairs.llm.exact_dedup import drop_copies
from tracepairs.llm.langid import keep_identified
from tracepairs.llm.mixing import take_mix
from tracepairs.llm.ngram_join import drop_near_copies

TOKEN_IDS, DECODED = "token_ids", "decoded"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their text; those without letters or with a score near chance go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest doc_id."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, 0.8), that with the smallest doc_id."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each repeat; sources weigh 1, 2, 3 in turn, three epochs at most."""
    return take_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``documents`` with token ids and the bytes decoded from them."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(docs, ranks, public_tokenizers.PATTERN, ids_col=TOKEN_IDS, out_col=DECODED)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Token ids cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The tables that a stage writes for itself go when its result is written; those of the
    last stage and its input stay for the caller (:func:`tracepairs.llm.common.remove_tables`)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with stage_tables(spark, keep=1):
            docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
