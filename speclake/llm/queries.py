"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import hnsw, html_extract, langid, merkle, minhash, mixing, packing, quality, secret_scan, suffix_dedup, token_align, tokens, windows
from ._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(tokens.MODEL))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return windows.packed_windows(table(spark, sf_dir, "documents"), public_tokenizers.path(windows.MODEL))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(m) for m in (token_align.MODEL_A, token_align.MODEL_B)]
    return token_align.token_alignment(table(spark, sf_dir, "documents"), *paths)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_html_extract, op3_hnsw, op4_secret_scan, op5_language_id, op6_token_counts, op7_suffix_dedup, op8_minhash_dedup, op9_best_fit_packing, op10_mixing, op11_merkle_manifest, op12_window_packing, op13_token_alignment)}
ORACLES = {"op1_quality_rules": quality.oracle(), "op4_secret_scan": secret_scan.oracle(), "op8_minhash_dedup": minhash.oracle(), "op10_mixing": mixing.oracle(), "op11_merkle_manifest": merkle.oracle()}
