"""Dark frames, panel regions, the empirical line and its application.

pixels: image_id, row, col, bands. panel_roi: panel, row0, row1, col0, col1 (half-open).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import any_has, per_band, to_long


def mean_dark_frame(dark: DataFrame, n: int) -> DataFrame:
    """Mean over acquisitions per pixel and band."""
    return dark.groupBy("row", "col").agg(per_band(n, F.avg).alias("bands"), any_has(dark, n))


def row_runs(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, row, run: a row's pixels as one record, an array of col and their other columns."""
    others = [c for c in pixels.columns if c not in (*keys, "row", "col")]
    return pixels.groupBy(*keys, "row").agg(F.collect_list(F.struct("col", *others)).alias("run"))


def subtract_dark(pixels: DataFrame, dark: DataFrame, own_time: float | None = None, other_time: float | None = None) -> DataFrame:
    """Frame less its dark frame, over its own exposure time where that differs from the other phase's (calibration or acquisition).

    Rows of pixels meet rows of the dark frame, whose bands lie in an array by column; pixels without a dark value go, and so do
    bands, by `there`.
    """
    whole = row_runs(dark.select("row", "col", F.col("bands").alias("_dark"))).withColumn("run", F.sort_array("run"))
    # bands by col, from 0: gaps are filled when the columns aren't dense
    dense = F.element_at("run", -1)["col"] + 1 == F.size("run")
    by_col = F.map_from_entries("run")
    filled = F.transform(F.sequence(F.lit(0), F.element_at("run", -1)["col"]), lambda c: F.try_element_at(by_col, c))
    whole = whole.select(F.col("row").alias("_row"), F.when(dense, F.transform("run", lambda x: x["_dark"])).otherwise(filled).alias("_dark"))
    runs = row_runs(pixels, "image_id")
    both = runs.join(whole, F.col("row") == F.col("_row"))
    time = own_time if own_time is not None and own_time != other_time else 1.0
    value = (lambda a, b: a - b) if time == 1.0 else (lambda a, b: (a - b) / time)
    less = lambda x: x.withField("bands", F.transform(x["bands"], lambda v, k: value(v, F.get(F.get("_dark", x["col"]), k))))
    known = lambda x: x.withField("there", F.transform(x["there"], lambda t, k: t & F.get(F.get("_dark", x["col"]), k).isNotNull()))
    taken = F.transform(F.filter("run", lambda x: F.get("_dark", x["col"]).isNotNull()), (lambda x: known(less(x))) if "there" in pixels.columns else less)
    return both.select("image_id", "row", F.inline(taken)).select(*pixels.columns)


def roi_pixels(pixels: DataFrame, panel_roi: DataFrame) -> DataFrame:
    """The pixels of each panel section. Regions are a handful of rectangles, so they are broadcast."""
    p, r = pixels, F.broadcast(panel_roi)
    inside = (p["row"] >= r["row0"]) & (p["row"] < r["row1"]) & (p["col"] >= r["col0"]) & (p["col"] < r["col1"])
    return p.join(r, inside).drop("row0", "row1", "col0", "col1")


def roi_mean(pixels: DataFrame, panel_roi: DataFrame, n: int) -> DataFrame:
    """Mean number of each band per image and panel."""
    p = roi_pixels(pixels, panel_roi)
    return p.groupBy("image_id", "panel").agg(per_band(n, F.avg).alias("bands"), any_has(p, n))


def mean_of_shots(roi_means: DataFrame) -> DataFrame:
    """Unweighted mean of the shots' means: panel, band, measured."""
    return to_long(roi_means, ["image_id", "panel"]).groupBy("band", "panel").agg(F.avg("value").alias("measured"))


def panel_lookup(bands_dim: DataFrame, reflectance: DataFrame, kind: str) -> DataFrame:
    """Known fraction of each band and panel, by the wavelength rounded half to even."""
    b = bands_dim.withColumn("wavelength", F.bround("wavelength", 0).cast("int"))
    r = reflectance.where(F.col("kind") == kind).select("wavelength", "panel", (F.col("pct") / 100).alias("known"))
    return b.join(r, "wavelength").select("band", "panel", "known")


def splice_panel(a: DataFrame, b: DataFrame, threshold_band: int, scaling: float) -> DataFrame:
    """Measured values per (band, panel): below the threshold from b over scaling, else from a."""
    both = a.join(b.withColumnRenamed("measured", "_b"), ["band", "panel"])
    return both.select("band", "panel", F.when(F.col("band") < threshold_band, F.col("_b") / scaling).otherwise(F.col("measured")).alias("measured"))


def fit_empirical_line(measured: DataFrame, known: DataFrame, origin: bool) -> DataFrame:
    """band, intercept, slope of known = intercept + slope * measured; origin adds the point (0, 0), for one panel."""
    points = measured.join(known, ["band", "panel"]).select("band", "measured", "known")
    if origin:
        points = points.union(points.select("band").distinct().select("band", F.lit(0.0), F.lit(0.0)))
    return points.groupBy("band").agg(F.regr_intercept("known", "measured").alias("intercept"), F.regr_slope("known", "measured").alias("slope"))


def apply_empirical_line(pixels: DataFrame, coef: DataFrame, scale: float = 1.0, clip: bool = False) -> DataFrame:
    """(value * slope + intercept) * scale of each band, clipped to [0, 1] if asked for; a band without a line keeps its value."""
    lines = coef.agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("intercept", "slope"))))).scalar()
    line = lambda v, k: (v * F.try_element_at("_c", k)["slope"] + F.try_element_at("_c", k)["intercept"]) * scale
    value = lambda v, k: F.when(F.try_element_at("_c", k).isNotNull(), line(v, k)).otherwise(v)
    cut = (lambda v, k: F.least(F.greatest(value(v, k), F.lit(0.0)), F.lit(1.0))) if clip else value
    return pixels.withColumn("_c", lines).withColumn("bands", F.transform("bands", cut)).drop("_c")


def calibrate_panel_check(pixels: DataFrame, coef: DataFrame, panel_roi: DataFrame, n: int) -> DataFrame:
    """Panel means after calibration."""
    return roi_mean(apply_empirical_line(pixels, coef), panel_roi, n)


def calibration_curve(coef: DataFrame, points: int = 100, most: float = 65535.0) -> DataFrame:
    """The fitted line of each band on an even grid of measured values."""
    grid = coef.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("i") * (most / (points - 1))
    return grid.select("band", "i", x.alias("measured"), (F.col("intercept") + F.col("slope") * x).alias("known"))


def dn_histogram(pixels: DataFrame, panel_roi: DataFrame, bin_width: float = 1.0) -> DataFrame:
    """Pixel counts per number bin, panel and band."""
    long = to_long(roi_pixels(pixels, panel_roi), ["panel"])
    return long.groupBy("panel", "band", F.floor(F.col("value") / bin_width).alias("bin")).agg(F.count("*").alias("pixels"))


def brightest_band(roi_means: DataFrame) -> DataFrame:
    """The band with the highest mean per panel, the smallest of several."""
    return mean_of_shots(roi_means).groupBy("panel").agg(F.max_by("band", F.struct("measured", -F.col("band"))).alias("band"))


def normalized_composite(picture: DataFrame, rois: DataFrame, color: list[float]) -> DataFrame:
    """Picture over its greatest value, with the regions painted in one color."""
    most = picture.agg(F.max(F.array_max("bands"))).scalar()
    rectangles = rois.agg(F.collect_list(F.struct("row0", "row1", "col0", "col1"))).scalar()
    painted = F.exists("_r", lambda r: (F.col("row") >= r["row0"]) & (F.col("row") < r["row1"]) & (F.col("col") >= r["col0"]) & (F.col("col") < r["col1"]))
    body = F.transform("bands", lambda v: F.try_divide(v, F.col("_m")))
    out = picture.withColumn("_r", rectangles).withColumn("_m", most)
    return out.withColumn("bands", F.when(painted, F.array(*map(F.lit, color))).otherwise(body)).drop("_r", "_m")


def save_line(coef: DataFrame, path: str) -> None:
    """The coefficients as text: band, intercept, slope."""
    coef.select("band", "intercept", "slope").coalesce(1).write.mode("overwrite").csv(path)


def load_line(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("band int, intercept double, slope double").csv(path)
