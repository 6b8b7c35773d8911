"""The objects inside large JSON files, found by many tasks.

A file is read in chunks by byte ranges. Whether a chunk begins inside a string, and how deep in braces, follows from the chunks
before it: a first pass counts each chunk's unescaped quotes, and its braces outside strings for both cases; running sums of these
few numbers a chunk give every chunk its state. The second pass cuts out the objects that start in a chunk, reading on where the
last one ends later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .envi import OPENED, opened, resolved
from .staging import staged

CHUNK = 8 << 20
#: Bytes that are read on at a time for an object that ends beyond its chunk.
MORE = 1 << 20
QUOTE, OPEN, CLOSE, ESCAPE = 0x22, 0x7B, 0x7D, 0x5C


def marks(file: pa.NativeFile, start: int, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, the positions of unescaped quotes and of braces, and +1 or -1 for each brace."""
    data = file.read_at(size, start)
    back, step = 0, 64  # backslashes just before
    while back < start:
        before = file.read_at(min(step, start - back), max(0, start - back - step))
        run = len(before) - len(before.rstrip(b"\\"))
        back += run
        if run < len(before):
            break
    clean = b" " + data[1:] if back % 2 else data
    if ESCAPE in clean:
        clean = re.sub(rb"(?s)\\.", b"  ", clean)
    c = np.frombuffer(clean, np.uint8)
    brace = np.flatnonzero((c == OPEN) | (c == CLOSE))
    return data, np.flatnonzero(c == QUOTE), brace, np.where(c[brace] == OPEN, 1, -1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            store, path = opened(r["path"])
            with store.open_input_file(path) as f:
                _, quotes, brace, sign = marks(f, r["start"], r["size"])
            inside = np.searchsorted(quotes, brace) % 2
            yield pa.RecordBatch.from_pylist([r | {"quotes": len(quotes), "plain": int(sign[inside == 0].sum()), "quoted": int(sign[inside == 1].sum())}])


def _cut(depth: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = opened(r["path"])
                size = r["size"]
                with store.open_input_file(path) as f:
                    end = f.size()
                    while True:
                        data, quotes, brace, sign = marks(f, r["start"], size)
                        real = (np.searchsorted(quotes, brace) + r["inside"]) % 2 == 0
                        at, sign = brace[real], sign[real]
                        level = r["depth"] + np.cumsum(sign)
                        starts = at[(sign > 0) & (level == depth) & (at < r["size"])]
                        ends = at[(sign < 0) & (level == depth - 1)]
                        ends = ends[np.searchsorted(ends, starts[0]) :] if len(starts) else ends
                        if len(starts) <= len(ends) or r["start"] + size >= end:
                            break
                        size += MORE
                n = len(starts)
                if n > len(ends):
                    raise ValueError(f"an object has no end in {r['path']}")
                for i in range(0, n, 1024):
                    some = range(i, min(n, i + 1024))
                    yield pa.RecordBatch.from_pydict({"path": pa.repeat(pa.scalar(r["path"]), len(some)), "seq": pa.array([r["start"] + int(starts[k]) for k in some], pa.int64()), "json": [data[starts[k] : ends[k] + 1].decode() for k in some]})

    return cut


def readable(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open the path and cut its files."""
    return not re.search(r"[*?\[{]|\.(gz|bz2|zst|lz4|snappy)$", path) and resolved(spark, path).split(":", 1)[0] in OPENED


def json_objects(spark: SparkSession, path: str, depth: int = 2, chunk: int = CHUNK) -> DataFrame:
    """path, seq (the byte where it starts), json: every object `depth` braces deep in the JSON files of a file or folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(resolved(spark, path)).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long")))
    chunks = files.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.lit(chunk), F.col("length") - F.col("start")).cast("long").alias("size"))
    chunks = chunks.repartition("path", "start")
    counts = staged(chunks.mapInArrow(_counted, "path string, start long, size long, quotes long, plain long, quoted long"), "chunks")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    state = counts.withColumn("inside", sofar("quotes") % 2)
    state = state.withColumn("depth", sofar(F.when(F.col("inside") == 0, F.col("plain")).otherwise(F.col("quoted"))))
    return state.select("path", "start", "size", "inside", "depth").repartition("path", "start").mapInArrow(_cut(depth), "path string, seq long, json string")
