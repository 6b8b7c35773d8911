"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Bytes of a row group of staged tables, which a writing task holds in memory.
ROW_GROUP = 32 << 20
#: Parts into which a hot key is split in joins with tables too large to broadcast.
SALTED = 16
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one (local runs) or the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local"):
            path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            path = f"{spark.conf.get('spark.sql.warehouse.dir')}/stage"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing to come reads."""
    hadoop = staged.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = hadoop.Path(folder)
        path.getFileSystem(staged.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A staged table of narrow rows, to be broadcast if it has at most `most` rows; a join with a larger one shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_kept: dict = {}


def kept(key: Hashable, make: Callable):
    """What `make` gives for the key, made once in a Python worker and kept for its later tasks."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, UNBASE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * BASE**k over i <= k < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(len(data) + 1)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial hash of each span, the same wherever the span lies."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_blank = np.zeros(256, bool)
_blank[[ord(c) for c in BLANKS]] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; at: the rows' offsets in data."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~_blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, side="right") - 1
