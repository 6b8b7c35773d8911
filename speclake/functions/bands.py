"""Column functions on `bands`, an array with one value per band.

Rows may lack bands: an optional column `there`, an array by band, says which a row has; without it, those of the array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_band(n: int, f) -> Column:
    """An array of f(value of band k) for k < n, as aggregates take it."""
    return F.array(*[f(F.get("bands", F.lit(k))) for k in range(n)])


def has(df: DataFrame, k: int) -> Column:
    """Whether a row of df has band k."""
    return F.coalesce(F.get("there", F.lit(k)) if "there" in df.columns else F.size("bands") > k, F.lit(False))


def any_has(df: DataFrame, n: int) -> Column:
    """there of a group, as aggregates take it: the bands that any of its rows has."""
    return F.array(*[F.max(has(df, k)) for k in range(n)]).alias("there")


def matrix(bands: pa.ListArray, n: int, valid: bool = False) -> np.ndarray:
    """(rows, n) numbers, NaN where a row has no value or ends before; valid: whether it has one instead."""
    flat, sizes = bands.flatten(), np.nan_to_num(bands.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = flat.is_valid().to_numpy(zero_copy_only=False) if valid else flat.to_numpy(zero_copy_only=False).astype(float)
    if (sizes == n).all():
        return values.reshape(-1, n)
    if (sizes > n).any():
        raise ValueError(f"a pixel has more than {n} bands")
    out = np.full((len(sizes), n), False if valid else np.nan)
    out[np.arange(n) < sizes[:, None]] = values
    return out


def select_bands(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Keep bands start <= k < stop."""
    return df.withColumns({c: F.slice(c, start + 1, stop - start) for c in ("bands", "there") if c in df.columns})


def composite(pixels: DataFrame, channels: list[int]) -> DataFrame:
    """Picture values (x 255) of the chosen bands."""
    there = F.array(*[has(pixels, k) for k in channels])
    return pixels.withColumns({"bands": F.array(*[F.get("bands", F.lit(k)) * 255 for k in channels]), "there": there})


def extremes(start: int, stop: int) -> list[int]:
    """Last, middle and first of the selected bands."""
    return [stop - 1, (start + stop) // 2, start]


def line_profile(pixels: DataFrame, row: int, col0: int, col1: int, bands: list[int]) -> DataFrame:
    """Values along a part of one image row for the chosen bands."""
    line = pixels.where((F.col("row") == row) & F.col("col").between(col0, col1 - 1))
    return to_long(line, ["image_id", "row", "col"]).where(F.col("band").isin(bands))


def to_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band, value: a row for each band that a row has."""
    if "there" not in df.columns:
        return df.select(*keys, F.posexplode("bands").alias("band", "value"))
    each = df.select(*keys, F.posexplode(F.arrays_zip("bands", "there")).alias("band", "_b"))
    return each.where("_b.there").select(*keys, "band", F.col("_b.bands").alias("value"))


def to_wide(long: DataFrame, keys: list[str], wavelengths: dict[int, float], leave_out: int | None = None) -> DataFrame:
    """One column per wavelength, without the reference band."""
    kept = {b: w for b, w in wavelengths.items() if b != leave_out}
    return long.groupBy(*keys).pivot("band", list(kept)).agg(F.first("value")).withColumnsRenamed({str(b): f"{w:g}" for b, w in kept.items()})


def _mean(x) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def let(body, **values: Column) -> Column:
    """body(values as a struct), with each value computed once a row: what a lambda refers to by column is computed per element."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def snv(df: DataFrame) -> DataFrame:
    """Each spectrum less its mean, over its population deviation; null for a flat one."""
    x = F.transform("bands", lambda v: v.cast("double"))
    centered = let(lambda q: let(lambda r: F.transform(r["x"], lambda v: v - r["m"]), x=q["x"], m=_mean(q["x"])), x=x)
    scaled = let(lambda q: let(lambda r: F.transform(r["c"], lambda v: F.try_divide(v, r["s"])), c=q["c"], s=F.sqrt(_dot(q["c"], q["c"]) / F.size(q["c"]))), c=centered)
    return df.withColumn("bands", scaled)


def msc(df: DataFrame, n: int, reference: list[float] | None = None) -> DataFrame:
    """Each centered spectrum regressed on the reference (by default the mean centered spectrum): (x - intercept) / slope."""
    x = F.transform("bands", lambda v: v.cast("double"))
    df = df.withColumn("bands", let(lambda q: let(lambda r: F.transform(r["x"], lambda v: v - r["m"]), x=q["x"], m=_mean(q["x"])), x=x))
    ref = F.array(*map(F.lit, reference)) if reference is not None else df.agg(per_band(n, F.avg)).scalar()

    def corrected(q: Column) -> Column:
        slope = F.try_divide(_dot(q["x"], q["r"]) - n * q["xm"] * q["rm"], _dot(q["r"], q["r"]) - n * q["rm"] * q["rm"])
        return let(lambda t: F.transform(t["x"], lambda v: F.try_divide(v - (t["xm"] - t["b"] * t["rm"]), t["b"])), x=q["x"], xm=q["xm"], rm=q["rm"], b=slope)

    both = let(lambda q: let(corrected, x=q["x"], r=q["r"], xm=_mean(q["x"]), rm=_mean(q["r"])), x=F.col("bands"), r=F.col("_r"))
    return df.withColumn("_r", ref).withColumn("bands", both).drop("_r")


def standardize(df: DataFrame, n: int) -> DataFrame:
    """Each band less its mean over all rows, over its population deviation; null for a constant band."""
    stats = df.agg(F.struct(per_band(n, F.avg).alias("m"), per_band(n, F.stddev_pop).alias("s"))).scalar()
    df = df.withColumn("_t", stats)
    return df.withColumn("bands", F.transform("bands", lambda v, i: F.try_divide(v - F.get("_t.m", i), F.get("_t.s", i)))).drop("_t")


def savgol_weights(window: int, order: int, der: int, at: float | None = None) -> list[float]:
    """Weights of the derivative at a position (the middle by default) of the polynomial fitted to `window` samples."""
    x = np.arange(window) - ((window - 1) / 2 if at is None else at)
    if at is None and window % 2 == 0:
        x = np.arange(window) - (window / 2 - 0.5)
    basis = np.vander(x, order + 1, increasing=True)
    factor = float(np.prod(np.arange(1, der + 1))) if der else 1.0
    return (factor * np.linalg.pinv(basis)[der]).tolist()


def savgol(df: DataFrame, window: int, order: int, der: int, n: int, trim: bool = True) -> DataFrame:
    """Local polynomial fit along the bands. window // 2 bands go at each end, or are read off the fits to the outermost windows."""
    if order >= window or der > order:
        raise ValueError("the order must be below the window and not below the derivative")
    w, half = savgol_weights(window, order, der), window // 2
    first = half - (window // 2 if window % 2 else window // 2 - 1)
    at = lambda start, weights: sum(F.get("bands", F.lit(start + j)) * weights[j] for j in range(window))
    out = [at(k + first, w) for k in range(n - 2 * half)]
    if not trim:
        edge = [savgol_weights(window, order, der, at=k) for k in range(window)]
        out = [at(0, edge[k]) for k in range(half)] + out + [at(n - window, edge[k]) for k in range(window - half, window)]
    return df.withColumn("bands", F.array(*out))
