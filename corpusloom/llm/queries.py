"""The queries opN_<name> of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gif_media, hmm_lm, html_main, langid, license_scan, packing, poisson_mix, simhash, substring_dedup, syncmers, token_alignment, token_files, turn_repair
from .common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(documents(spark, sf_dir))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.replicate(documents(spark, sf_dir)).drop("rate")


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.store_texts(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labelled(documents(spark, sf_dir))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_pairs(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(documents(spark, sf_dir))


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_context_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored_digests(documents(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html_main": op2_html_main,
    "op3_hmm_lm": op3_hmm_lm,
    "op4_poisson_mix": op4_poisson_mix,
    "op5_gif_media": op5_gif_media,
    "op6_license_scan": op6_license_scan,
    "op7_syncmers": op7_syncmers,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_bm25_packing": op10_bm25_packing,
    "op11_context_coder": op11_context_coder,
    "op12_turn_repair": op12_turn_repair,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {"op4_poisson_mix": poisson_mix.ORACLE, "op12_turn_repair": turn_repair.ORACLE}
