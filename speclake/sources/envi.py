"""ENVI cubes: a header (.hdr) and raw samples (.dat), as a data source of Spark's.

`spark.read.format("envi")` reads row blocks with range reads, a task for a part of a cube's rows, as Arrow batches; the option
`bands` (numbers from 0, with commas) reads only those planes. `write.format("envi")` takes pixels ordered by image, row and col
and writes a cube a time, which appears under its name when it is whole. A cube has all its planes; those of bands that an image
has no value of are named in its header (`missing bands`, numbers from 0) and read as null. Paths are opened in the tasks, on mounted
file systems and the stores that Arrow opens itself; read_envi and write_envi resolve other names (mount tables) first, and
read_envi takes cubes (up to 2 GB each) through Spark's own binary reader where nothing else opens them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.bands import matrix

#: ENVI data type codes.
TYPES = {"1": "u1", "2": "i2", "3": "i4", "4": "f4", "5": "f8", "12": "u2", "13": "u4"}
PIXELS = "image_id string, row int, col int, bands array<float>"
ARROW = pa.schema([("image_id", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("bands", pa.list_(pa.float32()))])
#: Bytes of samples and cubes that a reading task takes, and parts of one cube at most.
PIECE, CUBES, PARTS = 8 << 20, 64, 8
#: Schemes that tasks open themselves.
OPENED = {"file", "s3", "s3a", "gs", "hdfs", "abfs", "abfss"}


def parse_header(text: str) -> dict[str, str]:
    body = re.sub(r"\{([^}]*)\}", lambda m: m[1].replace("\n", " ").strip(), text)
    pairs = (line.split("=", 1) for line in body.splitlines() if "=" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def image_of(path: str) -> str:
    """The digits of a header's folder, or the header's stem without any."""
    folder, name = ["", *path.split("/")][-2:]
    return re.sub(r"\D", "", folder) or name.removesuffix(".hdr")


def local(path: str) -> str:
    """The path on a mounted file system."""
    return re.sub(r"^file:/+", "/", path)


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path, and the path in it."""
    if re.match(r"file:|[^:]*$|/", path):
        return stores.LocalFileSystem(), local(path)
    return stores.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


@dataclass
class Layout:
    """Where the samples of a cube lie."""

    rows: int
    cols: int
    n: int
    kind: np.dtype
    interleave: str
    offset: int
    missing: frozenset[int] = frozenset()

    @staticmethod
    def of(header: str, name: str) -> Layout:
        h = parse_header(header)
        for field, key in (("lines", "lines"), ("samples", "samples"), ("bands", "bands")):
            if not h.get(key, "").isdigit():
                raise ValueError(f"no number of {field} in {name}")
        kind = np.dtype(TYPES[h["data type"]]).newbyteorder(">" if h.get("byte order", "0") == "1" else "<")
        missing = frozenset(map(int, re.findall(r"\d+", h.get("missing bands", ""))))
        return Layout(int(h["lines"]), int(h["samples"]), int(h["bands"]), kind, h.get("interleave", "bsq").lower(), int(h.get("header offset", 0)), missing)

    def block(self, file: pa.NativeFile, start: int, stop: int, bands: list[int]) -> np.ndarray:
        """Rows start to stop as (rows, cols, bands), with range reads of what they need."""
        size = self.kind.itemsize

        def read(first: int, count: int) -> np.ndarray:
            got = file.read_at(count * size, self.offset + first * size)
            if len(got) < count * size:
                raise ValueError("a cube has fewer samples than its header says")
            return np.frombuffer(got, self.kind)

        if self.interleave == "bsq":
            out = np.empty((stop - start, self.cols, len(bands)), np.float32)
            for k, b in enumerate(bands):
                out[:, :, k] = read((b * self.rows + start) * self.cols, (stop - start) * self.cols).reshape(-1, self.cols)
            return out
        line = read(start * self.n * self.cols, (stop - start) * self.n * self.cols)
        cube = line.reshape(-1, self.n, self.cols).transpose(0, 2, 1) if self.interleave == "bil" else line.reshape(-1, self.cols, self.n)
        return np.ascontiguousarray(cube[:, :, bands], np.float32)

    def batches(self, image: str, file: pa.NativeFile, start: int, stop: int, step: int, bands: list[int] | None) -> Iterator[pa.RecordBatch]:
        bands = list(range(self.n)) if bands is None else bands
        for first in range(start, stop, step):
            block = self.block(file, first, min(stop, first + step), bands)
            row, col = np.divmod(np.arange(block.shape[0] * self.cols, dtype=np.int32), np.int32(self.cols))
            at = pa.array(np.arange(len(row) + 1, dtype=np.int32) * len(bands))
            gone = np.tile([b in self.missing for b in bands], len(row)) if self.missing else None
            values = pa.ListArray.from_arrays(at, pa.array(block.ravel(), mask=gone))
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(image), len(row)), pa.array(row + np.int32(first)), pa.array(col), values], schema=ARROW)


@dataclass
class Part(InputPartition):
    """Row ranges of cubes: header, samples, and the k-th of how many ranges."""

    ranges: list[tuple[str, str, int, int]]


class EnviReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step, self.parts = options["path"], int(options.get("blockRows", 64)), int(options.get("partsPerCube", 0))
        self.bands = [int(b) for b in options["bands"].split(",")] if options.get("bands") else None

    def partitions(self) -> list[Part]:
        """Row ranges of all headers that have their samples, small cubes together. Headers are read by the tasks."""
        store, path = opened(self.path)
        files = {f.path: f.size or 0 for f in store.get_file_info(stores.FileSelector(path, recursive=True)) if f.is_file}
        both = [(f, f"{f[:-4]}.dat") for f in sorted(files) if f.endswith(".hdr") and f"{f[:-4]}.dat" in files]
        if self.parts:
            return [Part([(h, d, k, self.parts)]) for h, d in both for k in range(self.parts)] or [Part([])]
        out, held = [], 0
        for h, d in both:
            parts = min(PARTS, max(1, -(-files[d] // PIECE)))
            if parts == 1 and out and 0 < held and held + files[d] <= PIECE and len(out[-1].ranges) < CUBES:
                out[-1].ranges.append((h, d, 0, 1))
                held += files[d]
            else:
                out += [Part([(h, d, k, parts)]) for k in range(parts)]
                held = max(1, files[d]) if parts == 1 else 0
        return out or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for header, samples, part, parts in partition.ranges:
            with store.open_input_stream(header) as f:
                cube = Layout.of(f.read().decode(), header)
            start, stop = (cube.rows * k // parts for k in (part, part + 1))
            with store.open_input_file(samples) as f:
                yield from cube.batches(image_of(header), f, start, stop, self.step, self.bands)


@dataclass
class Written(WriterCommitMessage):
    """The whole cubes that a task has left."""

    folders: list[str]


class EnviWriter(DataSourceArrowWriter):
    """Cubes of `rows` x `cols` pixels: folder/<image_id>/cube.dat and .hdr; 0 where no pixel is given, NaN where a pixel has no value.

    A task takes whole images, ordered by image, row and col. bil and bip go out line by line; bsq holds one cube. Samples are
    written under another name, moved when whole, and the header, without which no reader sees them, comes last.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.rows, self.cols, self.n = options["path"], *(int(options[k]) for k in ("rows", "cols", "bands"))
        self.interleave = options.get("interleave", "bsq")

    def lines(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """image, row, (cols, bands) of each row that has pixels, in order, and which bands have a value there."""
        at, line, known = None, np.zeros(0), np.zeros(0, bool)
        for batch in batches:
            images = batch.column("image_id").cast(pa.string()).to_pylist()
            row, col = (batch.column(c).to_numpy() for c in ("row", "col"))
            values = matrix(batch.column("bands"), self.n).astype("<f4")
            given = matrix(batch.column("bands"), self.n, valid=True)
            edges = [0, *(i for i in range(1, len(images)) if row[i] != row[i - 1] or images[i] != images[i - 1]), len(images)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if at != (images[a], int(row[a])):
                    if at:
                        yield *at, line, known
                    if at and at[0] == images[a] and at[1] > row[a]:
                        raise ValueError("pixels must be ordered by image_id, row and col")
                    at, line, known = (images[a], int(row[a])), np.zeros((self.cols, self.n), "<f4"), np.zeros(self.n, bool)
                line[col[a:b]] = values[a:b]
                known |= given[a:b].any(0)
        if at:
            yield *at, line, known

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = opened(self.path)
        done: list[str] = []
        lines = self.lines(iterator)
        line = next(lines, None)
        while line:
            image, folder = line[0], f"{path.rstrip('/')}/{line[0]}"
            if folder in done:
                raise ValueError("pixels must be ordered by image_id, row and col")
            store.create_dir(folder)
            spare = f"{folder}/.cube-{uuid.uuid4().hex}"
            try:
                with store.open_output_stream(spare) as f:
                    cube = np.zeros((self.n, self.rows, self.cols), "<f4") if self.interleave == "bsq" else None
                    following, known = 0, np.zeros(self.n, bool)
                    while line and line[0] == image:
                        if cube is not None:
                            cube[:, line[1]] = line[2].T
                        else:
                            f.write(bytes(4 * self.cols * self.n * (line[1] - following)))
                            f.write(np.ascontiguousarray(line[2].T if self.interleave == "bil" else line[2]).tobytes())
                        following = line[1] + 1
                        known |= line[3]
                        line = next(lines, None)
                    if cube is None:
                        f.write(bytes(4 * self.cols * self.n * (self.rows - following)))
                    for plane in cube if cube is not None else ():
                        f.write(plane.tobytes())
            except BaseException:
                store.delete_file(spare)
                raise
            store.move(spare, f"{folder}/cube.dat")
            missing = "" if known.all() else f"missing bands = {{{', '.join(map(str, np.flatnonzero(~known)))}}}\n"
            with store.open_output_stream(f"{folder}/cube.hdr") as f:
                f.write(f"ENVI\nsamples = {self.cols}\nlines = {self.rows}\nbands = {self.n}\nheader offset = 0\ndata type = 4\ninterleave = {self.interleave}\nbyte order = 0\n{missing}".encode())
            done.append(folder)
        return Written(done)

    def abort(self, messages: list[Written | None]) -> None:
        """A job that fails takes back the cubes of its tasks that were done."""
        store, _ = opened(self.path)
        for folder in (f for m in messages if m for f in m.folders):
            for name in ("cube.hdr", "cube.dat"):
                store.delete_file(f"{folder}/{name}")


class EnviSource(DataSource):
    """Options: path; reading: bands, blockRows, partsPerCube (by default, by size); writing: rows, cols, bands, interleave (bsq, bil, bip)."""

    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> EnviReader:
        return EnviReader(self.options)

    def writer(self, schema, overwrite: bool) -> EnviWriter:
        return EnviWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EnviSource)


def resolved(spark: SparkSession, path: str, create: bool = False) -> str:
    """The path with its scheme, behind mount tables."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if create:
        store.mkdirs(p)
    return store.resolvePath(p).toString()


def _files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """stem, path and content of the files of a kind; the content is only read if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(folder)
    return files.select(F.regexp_replace("path", rf"\.{kind}$", "").alias("stem"), F.col("path").alias(kind), F.col("content").alias(f"{kind}_content"))


def _acquisitions(spark: SparkSession, folder: str) -> DataFrame:
    digits = F.regexp_replace(F.element_at(F.split("stem", "/"), -2), r"\D", "")
    image = F.when(digits != "", digits).otherwise(F.element_at(F.split("stem", "/"), -1))
    return _files(spark, folder, "hdr").withColumn("image_id", image).join(_files(spark, folder, "dat"), "stem").drop("stem")


def list_acquisitions(spark: SparkSession, folder: str) -> DataFrame:
    """image_id, hdr, dat: one row per header that has its samples; the id is the digits of the folder, or the stem without any."""
    return _acquisitions(spark, folder).select("image_id", "hdr", "dat")


def read_envi(spark: SparkSession, folder: str, block_rows: int = 64, bands: list[int] | None = None) -> DataFrame:
    """pixels of all cubes in the folder (bsq, bil or bip, either byte order); a header without its sizes is an error."""
    path = resolved(spark, folder)
    if path.split(":", 1)[0] in OPENED:
        register(spark)
        reader = spark.read.format("envi").option("blockRows", block_rows)
        return (reader.option("bands", ",".join(map(str, bands))) if bands is not None else reader).load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cube = Layout.of(r["hdr_content"].decode(), r["hdr"])
                yield from cube.batches(r["image_id"], pa.BufferReader(r["dat_content"]), 0, cube.rows, block_rows, bands)

    return _acquisitions(spark, folder).select("image_id", "hdr", "hdr_content", "dat_content").mapInArrow(decode, PIXELS)


def write_envi(pixels: DataFrame, folder: str, rows: int, cols: int, n: int, interleave: str = "bsq") -> None:
    """One float32 cube per image: folder/<image_id>/cube.dat and .hdr, an image at a time in its task."""
    spark = pixels.sparkSession
    register(spark)
    ordered = pixels.select(F.col("image_id").cast("string").alias("image_id"), "row", "col", "bands").repartition("image_id").sortWithinPartitions("image_id", "row", "col")
    options = {"rows": rows, "cols": cols, "bands": n, "interleave": interleave}
    ordered.write.format("envi").mode("append").options(**options).save(resolved(spark, folder, create=True))
