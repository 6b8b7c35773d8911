"""Alignment of band planes: mutual information, centroids, shifts. planes: image_id, band, row, col, value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import any_has, matrix, per_band
from ..sources.tables import load_matrix, save_matrix

#: Images whose joint counts a task adds up at once.
HELD = 64
#: Pixels that a task packs at once, and sensors whose source positions a worker keeps.
PACKED, MAPS = 1 << 20, 4
LENS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")


def assign_sensor(bands_dim: DataFrame, boundary: int) -> DataFrame:
    return bands_dim.withColumn("sensor", F.when(F.col("band") < boundary, 2).otherwise(1))


def average_lens_params(params: DataFrame, boundary: int, pixel_mm: float = 0.0055) -> DataFrame:
    """Per sensor: mean intrinsics and distortion over bands, focal length and principal point in mm."""
    cols = [c for c in LENS if c in params.columns]
    out = assign_sensor(params, boundary).groupBy("sensor").agg(*[F.avg(c).alias(c) for c in cols])
    return out.withColumns({f"{c}_mm": F.col(c) * pixel_mm for c in cols[:4]})


def save_lens(params: DataFrame, folder: str, prefix: str) -> None:
    """The lens table (a row a sensor) as text: for each sensor a matrix of intrinsics, and its distortion k1, k2, p1, p2, k3."""
    for sensor, p in lens_by_sensor(params).items():
        matrix = [(p["fx"], 0.0, p["cx"]), (0.0, p["fy"], p["cy"]), (0.0, 0.0, 1.0)]
        for name, rows in (("intrinsic_matrix", matrix), ("distortion", [tuple(p[c] for c in LENS[4:])])):
            schema = ", ".join(f"c{k} double" for k in range(len(rows[0])))
            save_matrix(params.sparkSession.createDataFrame(rows, schema).coalesce(1), f"{folder}/{prefix}_{name}_{sensor}")


def load_lens(spark: SparkSession, files: dict[int, tuple[str, str]]) -> DataFrame:
    """The lens table of the files of intrinsics and distortion by sensor, as average_lens_params gives it and undistort takes it."""
    out = None
    for sensor, (intrinsics, distortion) in files.items():
        m = load_matrix(spark, intrinsics, ["a", "b", "c"]).where("a <> 0 or b <> 0")  # one row has fx, the other fy
        of = lambda x, y: F.max(F.when(F.col(x) != 0, F.col(y)))
        row = m.agg(of("a", "a").alias("fx"), of("b", "b").alias("fy"), of("a", "c").alias("cx"), of("b", "c").alias("cy"))
        bent = load_matrix(spark, distortion, list(LENS[4:])).select(F.struct("*")).limit(1).scalar()
        one = row.select(F.lit(sensor).alias("sensor"), "*", bent.alias("_d")).select("sensor", *LENS[:4], "_d.*")
        out = one if out is None else out.unionByName(one)
    return out


def lens_by_sensor(params: DataFrame) -> dict[int, dict[str, float]]:
    """A lens table's rows, one for each of the two sensors."""
    rows = params.select("sensor", *LENS).limit(3).collect()
    if len(rows) > 2 or len({r["sensor"] for r in rows}) < len(rows):
        raise ValueError("a lens table has one row for each of two sensors")
    return {r["sensor"]: {c: float(r[c]) for c in LENS} for r in rows}


def _information(joint: DataFrame, keys: list[str]) -> DataFrame:
    """(H(a) + H(b)) / H(a, b) from counts n by keys, a, b; null where the joint entropy is 0. One pass over the counts."""
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), x.alias("x"), y.alias("y")) for k, x, y in (("ab", F.col("a"), F.col("b")), ("a", F.col("a"), F.lit(None)), ("b", F.lit(None), F.col("b")))]))
    each = joint.select(*keys, "n", part.alias("p")).groupBy(*keys, "p.of", "p.x", "p.y").agg(F.sum("n").alias("n"))
    total = F.sum(F.when(F.col("of") == "ab", F.col("n")))
    h = {k: F.log(total) - F.sum(F.when(F.col("of") == k, F.col("n") * F.log("n"))) / total for k in ("a", "b", "ab")}
    found = each.groupBy(*keys).agg(*[v.alias(f"_{k}") for k, v in h.items()])
    return found.select(*keys, F.try_divide(F.col("_a") + F.col("_b"), F.when(F.col("_ab") > 1e-12, F.col("_ab"))).alias("nmi"))


def normalized_mi(pixels: DataFrame, ref_band: int, n: int, bins: int = 100) -> DataFrame:
    """image_id, band, nmi of each of an image's n bands or fewer with the reference band; null where a plane is flat. pixels: image_id, row, col, bands.

    A pixel's row holds the reference value too, so nothing is joined but the bounds of the planes, one row an image. Joint counts
    are added up in each task, for up to HELD images at once, before they are dealt.
    """
    bounds = pixels.groupBy("image_id").agg(per_band(n, F.min).alias("_lo"), per_band(n, F.max).alias("_hi"), any_has(pixels, n))
    kind, size = dict(pixels.dtypes)["image_id"], bins * bins

    def rows_of(held: dict, of: pa.DataType) -> pa.RecordBatch:
        images, codes, counts = [], [], []
        for image, (code, count) in held.items():
            images.append(np.full(len(code), len(images)))
            codes.append(code), counts.append(count)
        code = np.concatenate(codes)
        who = pa.array(list(held), of).take(pa.array(np.concatenate(images)))
        parts = {"band": code // size, "a": code % size // bins, "b": code % bins}
        return pa.RecordBatch.from_pydict({"image_id": who, **{k: pa.array(v.astype(np.int32)) for k, v in parts.items()}, "n": pa.array(np.concatenate(counts))})

    def joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            image = batch.column("image_id").dictionary_encode()
            v, lo, hi = (matrix(batch.column(c), n) for c in ("bands", "_lo", "_hi"))
            with np.errstate(divide="ignore", invalid="ignore"):
                cell = np.minimum(np.floor((v - lo) / (hi - lo) * bins), bins - 1)
            there = (hi > lo) & np.isfinite(cell) & np.isfinite(cell[:, [ref_band]])
            there[:, ref_band] = False
            code = (np.arange(n) * size + np.where(there, cell, 0) * bins + np.where(np.isfinite(cell[:, [ref_band]]), cell[:, [ref_band]], 0)).astype(np.int64)
            which = image.indices.to_numpy()
            for k, name in enumerate(image.dictionary.to_pylist()):
                mine = which == k
                found, count = np.unique(code[mine][there[mine]], return_counts=True) if mine.sum() < 1000 else _counted(np.bincount(code[mine][there[mine]], minlength=n * size))
                if name in held:
                    found, at = np.unique(np.append(held[name][0], found), return_inverse=True)
                    count = np.bincount(at, np.append(held[name][1], count)).astype(np.int64)
                held[name] = found, count
            if len(held) > HELD:
                yield rows_of(held, image.dictionary.type)
                held = {}
        if held:
            yield rows_of(held, image.dictionary.type)

    bounds = bounds.where(F.get("there", F.lit(ref_band)))  # others have nothing to be held against
    counts = pixels.drop("there").join(bounds, "image_id").select("image_id", "bands", "_lo", "_hi").mapInArrow(joint, f"image_id {kind}, band int, a int, b int, n long")
    counts = counts.groupBy("image_id", "band", "a", "b").agg(F.sum("n").alias("n"))
    others = bounds.select("image_id", F.posexplode("there").alias("band", "_t")).where(F.col("_t") & (F.col("band") != ref_band)).drop("_t")
    return others.join(_information(counts, ["image_id", "band"]), ["image_id", "band"], "left")


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(n)
    return at, n[at]


def tiles(planes: DataFrame) -> DataFrame:
    """image_id, band, rows, cols, values: pixels of a plane that a task has met, as packed numbers. A plane moves as a few records."""
    kind = dict(planes.dtypes)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        image, band = (t.column(c).combine_chunks().dictionary_encode() for c in ("image_id", "band"))
        image, band = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (image, band))
        code = image.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(band.dictionary) + band.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        code = code[order]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        parts = {c: np.split(t.column(c).to_numpy().astype(of)[order], start[1:]) for c, of in (("row", np.int32), ("col", np.int32), ("value", np.float64))}
        own = pa.array(order[start])
        columns = [t.column(c).combine_chunks().take(own) for c in ("image_id", "band")] + [pa.array([x.tobytes() for x in parts[c]], pa.binary()) for c in parts]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["image_id", "band", "rows", "cols", "values"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    known = planes.where("image_id is not null and band is not null").select("image_id", "band", "row", "col", "value")
    return known.mapInArrow(pack, f"image_id {kind['image_id']}, band {kind['band']}, rows binary, cols binary, values binary")


def unpacked(plane: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, col and value of the pixels of one plane's tiles."""
    return tuple(np.frombuffer(b"".join(plane[c]), of) for c, of in (("rows", np.int32), ("cols", np.int32), ("values", np.float64)))


def _by_plane(planes: DataFrame) -> DataFrame:
    """Dealt by plane in a fixed number of tasks: a few rows mean much work, so small partitions aren't merged."""
    return planes.repartition(int(planes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "band")


def intensity_centroid(planes: DataFrame) -> DataFrame:
    """Center of mass of each plane."""
    v = F.sum("value")
    return planes.groupBy("image_id", "band").agg(F.try_divide(F.sum(F.col("row") * F.col("value")), v).alias("row_c"), F.try_divide(F.sum(F.col("col") * F.col("value")), v).alias("col_c"))


def shift_grid(max_shift: int, samples: int) -> list[int]:
    """Offsets of the search along one axis."""
    return [i * (max_shift // samples) for i in range(-(samples // 2), samples // 2 + 1)]


def apply_shift(planes: DataFrame, shifts: DataFrame) -> DataFrame:
    """Planes moved by (d_row, d_col) per image and band; 0 where nothing comes from inside."""
    s = planes.join(shifts, ["image_id", "band"])
    moved = s.select("image_id", "band", (F.col("row") + F.col("d_row")).alias("row"), (F.col("col") + F.col("d_col")).alias("col"), F.col("value").alias("_v"))
    grid = s.select("image_id", "band", "row", "col")
    return grid.join(moved, ["image_id", "band", "row", "col"], "left").select("image_id", "band", "row", "col", F.coalesce("_v", F.lit(0.0)).alias("value"))


def coarse_shift_search(planes: DataFrame, ref_band: int, rows: int, cols: int, *, max_shift: int, samples: int, bins: int = 100, least_overlap: float = 0.25, centered: bool = True) -> DataFrame:
    """image_id, band, d_row, d_col, nmi: the shift with the most information about the reference on the overlap, ties to the smallest.

    Shifts are those of shift_grid along both axes, around the offset of the centers of mass (or 0). A plane becomes one row, its
    bins as bytes; each meets its image's reference plane once, and all its shifts are counted in one task. Overlaps of less than
    `least_overlap` of the plane don't count; planes without a shift that says anything give no row.
    """
    if bins > 255:
        raise ValueError("bins are kept in bytes")
    kind, steps = dict(planes.dtypes), shift_grid(max_shift, samples)

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, v = unpacked(pdf)
        out = np.full((rows, cols), 255, np.uint8)
        if v.max() > v.min():
            out[r, c] = np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * bins), bins - 1)
        total = v.sum()
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "band": pdf["band"].iloc[:1], "bin": [out.tobytes()], "row_c": (r * v).sum() / total if total else None, "col_c": (c * v).sum() / total if total else None})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf.itertuples():
                mine, ref = (np.frombuffer(x, np.uint8).reshape(rows, cols) for x in (p.bin, p.ref))
                start = [0 if not centered or pd.isna(x) else int(np.floor(abs(x) + 0.5) * np.sign(x)) for x in (p.row_off, p.col_off)]
                best = None
                for dr in (start[0] + k for k in steps):
                    for dc in (start[1] + k for k in steps):
                        a = mine[max(0, -dr) : max(0, rows - dr), max(0, -dc) : max(0, cols - dc)].astype(np.int64)
                        b = ref[max(0, dr) : max(0, rows + dr), max(0, dc) : max(0, cols + dc)]
                        there = (a < 255) & (b < 255)
                        if there.sum() < max(1, least_overlap * rows * cols):
                            continue
                        joint = np.bincount((a * bins + b)[there], minlength=bins * bins).reshape(bins, bins)
                        ha, hb, hab = (_entropy(x) for x in (joint.sum(1), joint.sum(0), joint.ravel()))
                        if hab > 1e-12 and (best is None or round((ha + hb) / hab, 9) > round(best[-1], 9)):
                            best = (dr, dc, (ha + hb) / hab)
                if best:
                    out.append((p.image_id, p.band, *best))
            yield pd.DataFrame(out, columns=["image_id", "band", "d_row", "d_col", "nmi"])

    whole = _by_plane(tiles(planes)).groupBy("image_id", "band").applyInPandas(plane, f"image_id {kind['image_id']}, band {kind['band']}, bin binary, row_c double, col_c double")
    ref = whole.where(F.col("band") == ref_band).select("image_id", F.col("bin").alias("ref"), F.col("row_c").alias("_r"), F.col("col_c").alias("_c"))
    both = whole.where(F.col("band") != ref_band).join(ref, "image_id")
    both = both.select("image_id", "band", "bin", "ref", (F.col("_r") - F.col("row_c")).alias("row_off"), (F.col("_c") - F.col("col_c")).alias("col_off"))
    return _by_plane(both).mapInPandas(search, f"image_id {kind['image_id']}, band {kind['band']}, d_row int, d_col int, nmi double")


def _entropy(n: np.ndarray) -> float:
    p = n[n > 0] / n.sum()
    return float(-(p * np.log(p)).sum())


def remap(row: np.ndarray, col: np.ndarray, fx: float, fy: float, cx: float, cy: float, k1: float, k2: float, p1: float, p2: float, k3: float) -> tuple[np.ndarray, np.ndarray]:
    """Source position (row, col) of output pixels under radial and tangential distortion."""
    x, y = (col - cx) / fx, (row - cy) / fy
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) * fy + cy, (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) * fx + cx


_maps: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}


def _gathers(lens: dict[str, float], rows: int, cols: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the four neighbours of every output pixel's source: its place in the plane (rows * cols: outside) and its weight. Built once a sensor in a worker."""
    key = (*sorted(lens.items()), rows, cols)
    if key not in _maps:
        if len(_maps) >= MAPS:
            _maps.clear()
        sr, sc = (x.ravel() for x in remap(*np.mgrid[0:rows, 0:cols], **lens))
        r0, c0 = np.floor(sr), np.floor(sc)
        out = []
        for u, v in ((r0 + i, c0 + j) for i in (0, 1) for j in (0, 1)):
            inside = (u >= 0) & (u < rows) & (v >= 0) & (v < cols)
            place = np.where(inside, u, 0).astype(np.int64) * cols + np.where(inside, v, 0).astype(np.int64)
            out.append((np.where(inside, place, rows * cols).astype(np.int32), np.where(inside, (1 - np.abs(sr - u)) * (1 - np.abs(sc - v)), 0.0)))
        _maps[key] = out
    return _maps[key]


def undistort(planes: DataFrame, lens: dict[int, dict[str, float]] | DataFrame, boundary: int, rows: int, cols: int) -> DataFrame:
    """Bilinear value at each output pixel's source position, by sensor of the band; 0 outside the plane. A plane is one group.

    lens: by sensor, or a table as average_lens_params and load_lens give it.
    """
    kind, lens = dict(planes.dtypes), lens if isinstance(lens, dict) else lens_by_sensor(lens)

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, v = unpacked(pdf)
        image, band = pdf["image_id"].iloc[0], pdf["band"].iloc[0]
        plane = np.zeros(rows * cols + 1)
        at = r.astype(np.int64) * cols + c
        plane[at] = v
        value = np.zeros(len(at))
        for place, weight in _gathers(lens[2 if band < boundary else 1], rows, cols):
            value += weight[at] * plane[place[at]]
        return pd.DataFrame({"image_id": image, "band": band, "row": r, "col": c, "value": value})

    schema = ", ".join(f"{c} {kind[c]}" for c in ("image_id", "band", "row", "col"))
    return _by_plane(tiles(planes)).groupBy("image_id", "band").applyInPandas(gather, f"{schema}, value double")
