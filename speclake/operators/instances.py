"""Instances: masks, outliers, mean spectra and laboratory values.

mask_runs: image_id, ann_id, row, col0, col1 (half-open). masked: pixels with ann_id and the columns of their instance.

Masks, bounds and means all read the same pixels: pixel_layout writes them once by image and row, so that mask joins move only mask
runs, and bounds go to the pixels on the runs of their instance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import any_has, has, per_band
from ..sources.staging import bucketed
from .quantiles import band_quantiles
from .stats import numbered


def tagged_instances(instances: DataFrame) -> DataFrame:
    return instances.where("attributes.tagged")


def filter_by_score(instances: DataFrame, least: float = 0.99) -> DataFrame:
    return instances.where(F.col("score") > least)


def instance_key(instances: DataFrame) -> DataFrame:
    """code: g<grape>p<plant>; plant: p<plant>; null where a number is missing or none."""
    grape, plant = (F.col(c).try_cast("int").cast("string") for c in ("grape_no", "plant_no"))
    return instances.withColumn("code", F.concat(F.lit("g"), grape, F.lit("p"), plant)).withColumn("plant", F.concat(F.lit("p"), plant))


def row_side(df: DataFrame, cut: int = 14) -> DataFrame:
    """first or second row of the field, by the plant number at the end of the id; null without one."""
    plant = F.regexp_extract("id", r"p(\d+)$", 1).try_cast("int")
    return df.withColumn("side", F.when(plant < cut, "first").when(plant >= cut, "second"))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna()


def pixel_layout(pixels: DataFrame, buckets: int | None = None) -> DataFrame:
    """The pixels as a table bucketed by image and row, for mask_join. An image is spread over the buckets."""
    return bucketed(pixels, "pixels", "image_id", "row", buckets=buckets)


def mask_join(pixels: DataFrame, mask_runs: DataFrame) -> DataFrame:
    """The pixels of each instance, with the runs' other columns; a pixel may lie in several. Keyed by image and row, so a crowded image is spread."""
    both = pixels.join(mask_runs, ["image_id", "row"])
    return both.where((F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col1"))).drop("col0", "col1")


def iqr_bounds(masked: DataFrame, n: int, tolerance: float = 2.2, **options) -> DataFrame:
    """Per instance: lo and hi, arrays by band of median -+ tolerance * interquartile range (zeros included; null without values). options: band_quantiles'."""
    q = band_quantiles(masked, ["image_id", "ann_id"], n, [0.25, 0.5, 0.75], **options)
    side = lambda s: F.transform("q", lambda x: x[1] + s * tolerance * (x[2] - x[0]))
    return q.select("image_id", "ann_id", side(-1).alias("lo"), side(1).alias("hi"))


def zero_outliers(bounded: DataFrame) -> DataFrame:
    """Pixels with the columns lo and hi, which go: a pixel outside of them in any band is zeroed in all."""
    bad = F.exists(F.arrays_zip("bands", "lo", "hi"), lambda x: (x["bands"] < x["lo"]) | (x["bands"] > x["hi"]))
    return bounded.withColumn("bands", F.when(bad, F.transform("bands", lambda v: F.lit(0.0))).otherwise(F.col("bands"))).drop("lo", "hi")


def remove_outlier_pixels(masked: DataFrame, bounds: DataFrame) -> DataFrame:
    """A pixel outside the bounds in any band is zeroed in all."""
    return zero_outliers(masked.join(bounds, ["image_id", "ann_id"]))


def clean_instances(layout: DataFrame, mask_runs: DataFrame, n: int, tolerance: float = 2.2) -> DataFrame:
    """masked without outliers, of a pixel_layout: the runs bring their instance's bounds to the pixels."""
    bounds = iqr_bounds(mask_join(layout, mask_runs.select("image_id", "ann_id", "row", "col0", "col1")), n, tolerance)
    return zero_outliers(mask_join(layout, mask_runs.join(bounds, ["image_id", "ann_id"])))


def instance_mean_spectrum(masked: DataFrame, n: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per annotation: bands = means of non-zero values (0 if none), sums and counts of them; there. keep: columns of the instance."""
    own = lambda v: F.nullif(v, F.lit(0.0))
    g = masked.groupBy("image_id", "ann_id", *keep)
    return g.agg(per_band(n, lambda v: F.coalesce(F.avg(own(v)), F.lit(0.0))).alias("bands"), per_band(n, F.sum).alias("sums"), per_band(n, lambda v: F.count(own(v))).alias("counts"), any_has(masked, n))


def plant_mean_spectrum(instances: DataFrame, n: int, count: str = "first_band") -> DataFrame:
    """Per plant: pooled sums over pooled counts, those of the first band or of each band, of the instances that have both bands."""
    first = lambda k: 0 if count == "first_band" else k
    both = lambda k: has(instances, k) & has(instances, first(k))
    total = lambda c, k, of: F.sum(F.when(both(of), F.get(c, F.lit(k))))
    mean = lambda k: F.try_divide(total("sums", k, k), total("counts", first(k), k))
    there = F.array(*[F.max(both(k)) for k in range(n)])
    return instances.groupBy("plant_no").agg(F.array(*[mean(k) for k in range(n)]).alias("bands"), there.alias("there"))


def join_lab_bunch(instances: DataFrame, lab: DataFrame) -> DataFrame:
    """Instances whose code is in the laboratory's table."""
    return instances.join(lab, "code")


def unmatched_bunches(instances: DataFrame, lab: DataFrame) -> DataFrame:
    return instances.join(lab, "code", "left_anti")


def join_lab_plant(instances: DataFrame, lab: DataFrame, date: str) -> DataFrame:
    """Instances with the first laboratory row (by seq) of their plant on the date."""
    first = lab.where(F.col("date") == F.lit(date).cast("date")).withColumn("_n", F.row_number().over(Window.partitionBy("plant").orderBy("seq"))).where("_n = 1").drop("_n", "seq", "date")
    return instances.join(first, instances["plant_no"] == first["plant"]).drop("plant")


def number_annotations(instances: DataFrame) -> DataFrame:
    """Image numbers from 1 by file name, annotation numbers from 1 inside each image, in input order (seq)."""
    images = numbered(instances.select("file_name").distinct(), "image_no", "file_name").drop("_total").withColumn("image_no", F.col("image_no").cast("int"))
    ann = F.row_number().over(Window.partitionBy("file_name").orderBy("seq"))
    return instances.withColumn("ann_no", ann).join(images, "file_name")


def stack_campaigns(campaigns: dict[str, DataFrame]) -> DataFrame:
    """The plant tables of several dates in one, labelled by Date."""
    out = None
    for date, df in campaigns.items():
        one = df.withColumn("Date", F.lit(date))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
