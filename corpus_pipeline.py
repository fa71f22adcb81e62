"""The corpus pipeline: language ID, near-duplicates, repeated passages, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import common, langid, packing, poisson_mix, simhash, substring_dedup


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or no language of 0.3 or more."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller document holds are cut; a document that has nothing else goes."""
    return substring_dedup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn for its source's weight, in a global shuffle."""
    return poisson_mix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", identify), ("simhash_near_dedup", deduplicate), ("substring_dedup", cut_repeats), ("poisson_mix", mix), ("bm25_packing", pack)]

#: Trained language models, word windows and tokens have no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.settled(name, stage, spark, docs, sf_dir)
    return docs
