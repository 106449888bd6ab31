"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing and BPE encoding of ``documents``.

Each stage takes the documents that its predecessor kept, with all their columns, and returns those it keeps (the last:
a row of digests for each). ``run`` chains them; written one by one, each stage's Parquet output is the next one's
input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuadre.llm import bpe, exact_dedup, langid, mixing, ngram_join
from cuadre.llm.common import documents, stage
from cuadre.llm.queries import VOCABULARY

#: A document goes when no language has this share of its letters.
MIN_LANGUAGE_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told."""
    return langid.keep_identified(docs, langid.fit(docs), min_score=MIN_LANGUAGE_SHARE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of equal texts."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every component of near copies."""
    return ngram_join.keep_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.digests(bpe.encode_documents(docs, VOCABULARY))


STAGES = [("language_id", language_id), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Language ID and BPE have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
