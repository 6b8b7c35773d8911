"""Conflict-constrained best-fit packing.

Documents are cut in pieces of at most `capacity` and dealt by hash of id and piece into shards of about `shard_rows` pieces, so
that a hot source or a large group of copies is spread over all shards; rows of an id that alone would crowd a shard (null ids,
repeated rows) are dealt by their place in the staged table besides. In a shard pieces go by falling length to the open bin with
the least residual that holds them: bins are ordered by residual and carry bitmaps of their sources and duplicate clusters,
and the search goes on to the next larger residual until neither bitmap has the piece's bit. Without such a bin a new one
is opened. No bin holds two documents of one source or of one cluster. Each shard leaves its own open bins.

Defined results: a document of length 0 (null or empty text) gets one row with null bin; a null source or cluster conflicts
with nothing; ties go by id and piece, then by bin number; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANK_RUN, BLANKS, bounded, or_empty, stage

CAPACITY = 2048
SHARD_ROWS = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, taken in the given order; sources and clusters: bit numbers, -1 without conflict."""
    order: list[tuple[int, int]] = []  # (residual, bin), of bins with room
    held: list[tuple[int, int]] = []  # bitmaps of sources and clusters by bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]][0] & s or held[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            residual, bin_no = order.pop(at)
            held[bin_no] = (held[bin_no][0] | s, held[bin_no][1] | c)
        else:
            residual, bin_no = capacity, len(held)
            held.append((s, c))
        if residual > size:
            insort(order, (residual - size, bin_no))
        out.append(bin_no)
    return out


def _bits(values: pd.Series) -> list[int]:
    """Bit numbers of the values that occur twice or more; -1 for others and nulls."""
    again = values.where(values.duplicated(keep=False))
    return pd.factorize(again)[0].tolist()


def best_fit_packing(docs: DataFrame, length: Column, *, id_col: str = "doc_id", source: Column, cluster: Column, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, piece (from 0), start and length in the document, shard and bin (null: nothing to pack), bin_fill."""
    rows = stage(docs.select(docs[id_col].alias("id"), source.cast("string").alias("source"), cluster.alias("cluster"), length.cast("long").alias("total")), "packing")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity).cast("int") - 1, F.lit(0)))))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("start")))
    n = rows.agg(F.sum(F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-n // shard_rows))
    hot = stage(rows.groupBy(F.xxhash64("id").alias("key")).count().where(F.col("count") > shard_rows // 8).select("key", F.lit(True).alias("hot")), "hot")
    pieces = pieces.withColumn("key", F.xxhash64("id")).withColumn("place", F.monotonically_increasing_id()).join(bounded(hot), "key", "left")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "piece", F.when(F.col("hot"), F.col("place"))), F.lit(shards)).cast("int")).drop("key", "place", "hot")

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "id", "piece"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        full = shard["length"] > 0
        todo = shard[full]
        bins = best_fit(todo["length"].tolist(), _bits(todo["source"]), _bits(todo["cluster"]), capacity)
        shard["bin"] = pd.Series(bins, index=todo.index, dtype="Int64").reindex(shard.index)
        shard["bin_fill"] = shard.groupby("bin")["length"].transform("sum").astype("Int64")
        return shard[["id", "piece", "start", "length", "shard", "bin", "bin_fill"]]

    kind = docs.schema[id_col].dataType.simpleString()
    out = pieces.groupBy("shard").applyInPandas(pack, f"id {kind}, piece int, start long, length long, shard int, bin long, bin_fill long")
    return out.withColumnRenamed("id", id_col)


def n_words(docs: DataFrame, text_col: str = "text") -> Column:
    """The number of words of a text, the length that the queries pack by."""
    trimmed = F.btrim(or_empty(docs[text_col]), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK_RUN)))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packing by words, where exact copies are a cluster."""
    return best_fit_packing(docs, n_words(docs), source=docs["source"], cluster=F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"])))
