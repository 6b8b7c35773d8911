"""Annotations (COCO JSON), laboratory and panel tables, parameter matrices, the result dataset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stats import numbered
from .objects import CHUNK, json_objects, readable
from .staging import staged

ATTRIBUTES = "attributes struct<tagged: boolean, plant_no: string, grape_no: string>"
COCO = f"images array<struct<id: int, file_name: string, width: int, height: int>>, annotations array<struct<id: int, image_id: int, category_id: int, bbox: array<double>, score: double, iscrowd: int, segmentation: array<array<double>>, {ATTRIBUTES.replace(' ', ': ', 1)}>>"


#: The fields of an image and of an annotation; both have an id.
FOUND = COCO.replace("images array<struct<id: int, ", "").replace(">>, annotations array<struct<id: int, ", ", id: int, ").removesuffix(">>")


def read_annotations(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row per annotation with its image's name and size; seq orders those of a file. A file is cut in chunks for many tasks.

    Files may hold one document or many, as lines, whose image ids differ. Globs, compressed files and stores that tasks can't open
    are read by Spark's own reader, a document a file.
    """
    if readable(spark, path):
        found = json_objects(spark, path, chunk=chunk).select(F.col("path").alias("_file"), "seq", F.from_json("json", f"struct<{FOUND}>").alias("o"))
        found = staged(found.select("_file", "seq", "o.*"), "coco")
        images = found.where("image_id is null and file_name is not null").select("_file", F.col("id").alias("image_no"), "file_name", "width", "height")
        ann = found.where("image_id is not null").drop("file_name", "width", "height").withColumnsRenamed({"id": "ann_id", "image_id": "image_no"})
    else:
        doc = spark.read.schema(COCO).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
        images = doc.select("_file", F.explode("images").alias("i")).select("_file", F.col("i.id").alias("image_no"), F.col("i.file_name").alias("file_name"), "i.width", "i.height")
        ann = doc.select("_file", F.posexplode("annotations").alias("seq", "a")).select("_file", F.col("seq").cast("long").alias("seq"), "a.*").withColumnsRenamed({"id": "ann_id", "image_id": "image_no"})
    out = ann.join(images, ["_file", "image_no"]).drop("_file")
    return out.withColumn("image_id", F.regexp_replace(F.element_at(F.split("file_name", "/"), -1), r"\.[^.]*$", ""))


def write_annotations(instances: DataFrame, folder: str) -> None:
    """COCO 1.0, a document a line per image, many in a file: ids from 1, category 1, polygons of more than 5 numbers. instances as read_annotations gives."""
    images = numbered(instances.select("file_name", "width", "height").distinct(), "no", "file_name").withColumn("no", F.col("no").cast("int")).drop("_total")
    w = Window.partitionBy("file_name").orderBy("seq")
    polygons = F.filter("segmentation", lambda p: F.size(p) > 5)
    a = instances.withColumn("ann_no", F.row_number().over(w)).join(images.select("file_name", "no"), "file_name")
    ann = F.struct(F.col("ann_no").alias("id"), F.col("no").alias("image_id"), F.lit(1).alias("category_id"), "bbox", "score", F.lit(0).alias("iscrowd"), polygons.alias("segmentation"), "attributes")
    image = F.struct(F.col("no").alias("id"), "file_name", "width", "height")
    a.groupBy("no", "file_name", "width", "height").agg(F.sort_array(F.collect_list(ann)).alias("annotations")).select(F.array(image).alias("images"), "annotations").write.mode("overwrite").json(folder)


def read_lab_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_panel_table(spark: SparkSession, path: str, panels: list[str], kinds: list[str]) -> DataFrame:
    """wavelength, panel, kind, pct from columns `<panel> <kind>`."""
    cols = [f"{p} {k}" for p in panels for k in kinds]
    wide = spark.read.schema("Wavelength int, " + ", ".join(f"`{c}` double" for c in cols)).csv(path, header=True)
    entries = F.explode(F.array(*[F.struct(F.lit(c.split(" ")[0]).alias("panel"), F.lit(c.split(" ")[1]).alias("kind"), F.col(f"`{c}`").alias("pct")) for c in cols]))
    return wide.select(F.col("Wavelength").alias("wavelength"), entries.alias("e")).select("wavelength", "e.*")


def load_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{c}` double" for c in columns)).csv(path)


def save_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


def write_dataset(spectra: DataFrame, path: str, wavelengths: list[float], chem: list[str]) -> None:
    """id, one column per wavelength, then the chemical columns."""
    wide = [F.get("bands", F.lit(k)).alias(f"{w:g}") for k, w in enumerate(wavelengths)]
    spectra.select("id", *wide, *chem).write.mode("overwrite").csv(path, header=True)


def read_dataset(spark: SparkSession, path: str, wavelengths: list[float], chem: list[str]) -> DataFrame:
    """id, bands and the chemical columns."""
    names = [f"{w:g}" for w in wavelengths]
    schema = "id string, " + ", ".join(f"`{c}` double" for c in [*names, *chem])
    return spark.read.schema(schema).csv(path, header=True).select("id", F.array(*[F.col(f"`{c}`") for c in names]).alias("bands"), *chem)


def polygon_runs(polygon: list[float], rows: int, cols: int) -> dict[int, list[tuple[int, int]]]:
    """Half-open column runs by row of the pixel centers inside a polygon (x0, y0, x1, y1, ...), even-odd."""
    x, y = np.asarray(polygon[0::2], float), np.asarray(polygon[1::2], float)
    out: dict[int, list[tuple[int, int]]] = {}
    for row in range(max(0, int(np.floor(y.min()))), min(rows, int(np.ceil(y.max())) + 1)):
        c = row + 0.5
        x1, y1 = np.roll(x, -1), np.roll(y, -1)
        cross = (y <= c) != (y1 <= c)
        at = np.sort(x[cross] + (c - y[cross]) * (x1[cross] - x[cross]) / (y1[cross] - y[cross]))
        for a, b in zip(at[0::2], at[1::2], strict=True):
            lo, hi = max(0, int(np.ceil(a - 0.5))), min(cols, int(np.ceil(b - 0.5)))
            if lo < hi:
                out.setdefault(row, []).append((lo, hi))
    return out


def rasterize_polygons(instances: DataFrame) -> DataFrame:
    """mask_runs of the instances (image_id, ann_id, segmentation, width, height): the union of an instance's polygons."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rows: dict[int, list[tuple[int, int]]] = {}
                for p in r.segmentation if r.segmentation is not None else []:
                    if len(p) > 5:
                        for row, runs in polygon_runs(list(p), r.height, r.width).items():
                            rows.setdefault(row, []).extend(runs)
                for row, runs in sorted(rows.items()):
                    merged: list[list[int]] = []
                    for a, b in sorted(runs):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    out += [(r.image_id, r.ann_id, row, a, b) for a, b in merged]
            yield pd.DataFrame(out, columns=["image_id", "ann_id", "row", "col0", "col1"])

    kind = dict(instances.dtypes)
    return instances.select("image_id", "ann_id", "segmentation", "width", "height").mapInPandas(run, f"image_id {kind['image_id']}, ann_id {kind['ann_id']}, row int, col0 int, col1 int")
