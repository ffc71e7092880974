"""The registered corpus queries, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontaminate, html_extract, langid_ecoc, line_spread, quality_nbsvm, repetition, secret_ledger, simhash_gph, temperature_mix, token_counts
from docloom.llm.common import table


def op1_consensus_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op1(table(spark, sf_dir, "pages"))


def op2_digest_cache_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.op2(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.op5(table(spark, sf_dir, "documents"))


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.op6(table(spark, sf_dir, "documents"))


def op7_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_ecoc.op7(table(spark, sf_dir, "documents"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix.op8(table(spark, sf_dir, "documents"))


def op9_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.op9(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gph.op10(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_consensus_host_paths, op2_digest_cache_tokens, op3_nbsvm_quality, op4_template_decontamination, op5_blob_ledger_secrets, op6_suffix_repetition, op7_ecoc_language, op8_temperature_mixing, op9_line_site_spread, op10_simhash_near_dedup)}
ORACLES: dict[str, str] = {"op5_blob_ledger_secrets": secret_ledger.SQL, "op9_line_site_spread": line_spread.SQL}
