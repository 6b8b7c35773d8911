"""Staged tables: written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one (local runs) or under the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        local = spark.sparkContext.master.startswith("local")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/stage"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str, buckets: int | None = None) -> DataFrame:
    """df as a table of `buckets` buckets (by default, the shuffle's partitions), written once: joins and groups on the keys don't deal it again."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, name)
    called = f"{name}_{path[-32:]}".replace("-", "_")
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(called)
    return spark.read.table(called)
