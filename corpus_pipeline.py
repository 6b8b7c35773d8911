"""The corpus pipeline: quality rules, near-duplicates, secrets, mixture and packing, each stage on what the one before kept.

Defined results, of every stage: null texts are empty (the quality rules drop them as short); rows without id are documents of
their own that no stage links; repeated rows are judged alike, kept or dropped together, and packed each; an empty table gives
an empty result; other columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speclake.llm import minhash, mixing, packing, quality, secret_scan
from speclake.llm._common import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    return quality.drop_rejected(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, 0.8)."""
    return minhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the raked probabilities stays."""
    return mixing.sample_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents that are left."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Packing, the last stage, isn't expressible in SQL; tests hold run() and each stage against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
