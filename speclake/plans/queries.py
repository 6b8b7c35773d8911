"""Queries by operator name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import alignment as A
from ..operators import instances as I
from ..operators import radiometry as R
from ..operators import regression as P
from ..operators import stats as S
from ..sources import envi as E
from ..sources import tables as T
from . import views as V
from .views import N, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PIXEL = ["image_id", "row", "col"]


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def long(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return B.to_long(df, list(keys)).select(*keys, F.col("band").cast("int").alias("band"), F.round("value", digits).alias("value"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("select image_id, row, col, (band - 1)::int as band, round(value, 6) as value from planes where band between 1 and 8", "planes")
def select_bands(spark: SparkSession, d: str) -> DataFrame:
    return long(B.select_bands(V.pixels(spark, d), 1, 9), *PIXEL)


@query("select image_id, row, col, case band when 1 then 0 when 4 then 1 else 2 end::int as band, round(value * 255, 6) as value from planes where band in (1, 4, 8)", "planes")
def composite(spark: SparkSession, d: str) -> DataFrame:
    return long(B.composite(V.pixels(spark, d), [1, 4, 8]), *PIXEL)


@query("select p.image_id, p.row, p.col, band, case when roi.panel is null then round(value / (select max(value) from planes where band in (1, 4, 8)), 6) else case p.band when 1 then 1.0 else 0.0 end end as value from (select * from planes where band in (1, 4, 8)) p left join roi on p.row >= row0 and p.row < row1 and p.col >= col0 and p.col < col1".replace("band, case when", "case band when 1 then 0 when 4 then 1 else 2 end::int as band, case when", 1), "planes", "roi")
def normalized_composite(spark: SparkSession, d: str) -> DataFrame:
    return long(R.normalized_composite(B.composite(V.pixels(spark, d), [1, 4, 8]), V.roi(spark), [1.0, 0.0, 0.0]), *PIXEL)


@query("select image_id, row, col, band, value from planes where row = 3 and col >= 1 and col < 7 and band in (2, 5)", "planes")
def line_profile(spark: SparkSession, d: str) -> DataFrame:
    return B.line_profile(V.pixels(spark, d), 3, 1, 7, [2, 5])


def _instances(spark: SparkSession, d: str) -> DataFrame:
    m = V.masks(spark, d).select("image_id", "ann_id", "plant_no", "grape_no").distinct()
    return m.select("*", F.struct((F.col("image_id") % 3 != 0).alias("tagged")).alias("attributes"), (F.lit(0.97) + (F.col("image_id") % 4) / 100).alias("score"), F.concat(F.lit("img"), F.lpad(F.col("image_id").cast("string"), 6, "0")).alias("file_name"), F.col("ann_id").alias("seq"))


_INST = "select distinct image_id, ann_id, plant_no, grape_no from masks"


@query(f"select * from ({_INST}) where image_id % 3 <> 0", "masks")
def tagged_instances(spark: SparkSession, d: str) -> DataFrame:
    return I.tagged_instances(_instances(spark, d)).select("image_id", "ann_id", "plant_no", "grape_no")


@query(f"select * from ({_INST}) where image_id % 4 = 3", "masks")
def filter_by_score(spark: SparkSession, d: str) -> DataFrame:
    return I.filter_by_score(_instances(spark, d), 0.995).select("image_id", "ann_id", "plant_no", "grape_no")


@query(f"select image_id, ann_id, 'g' || grape_no || 'p' || plant_no as code, 'p' || plant_no as plant from ({_INST})", "masks")
def instance_key(spark: SparkSession, d: str) -> DataFrame:
    return I.instance_key(_instances(spark, d)).select("image_id", "ann_id", "code", "plant")


@query("select id, case when idx < 14 then 'first' else 'second' end as side from spectra", "spectra")
def row_side(spark: SparkSession, d: str) -> DataFrame:
    return I.row_side(V.spectra(spark, d)).select("id", "side")


@query("select id, target from spectra where idx % 7 <> 0", "spectra")
def drop_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return I.drop_incomplete(V.spectra(spark, d).select("id", F.when(F.col("idx") % 7 != 0, F.col("target")).alias("target")))


@query("select id from (select id, row_number() over (order by id) as n from spectra) where n % 2 = 1", "spectra")
def every_other(spark: SparkSession, d: str) -> DataFrame:
    return S.every_other(V.spectra(spark, d), "id").select("id")


@query("select image_id, row, col, band, value from planes", "planes")
def to_long(spark: SparkSession, d: str) -> DataFrame:
    return long(V.pixels(spark, d), *PIXEL)


@query("select image_id, row, col, max(case band when 0 then value end) as \"500\", max(case band when 2 then value end) as \"556.5\" from planes where band in (0, 1, 2) group by all", "planes")
def to_wide(spark: SparkSession, d: str) -> DataFrame:
    return B.to_wide(V.planes(spark, d), PIXEL, {b: V.WAVELENGTHS[b] for b in (0, 1, 2)}, leave_out=1)


@query("select row, col, band, round(avg(value * 0.05), 6) as value from planes where image_id % 10 = 0 group by all", "planes")
def mean_dark_frame(spark: SparkSession, d: str) -> DataFrame:
    return long(R.mean_dark_frame(V.dark(spark, d), N), "row", "col")


@query("with dark as (select row, col, band, avg(value * 0.05) as dk from planes where image_id % 10 = 0 group by all) select case when image_id % 2 = 0 then 'calibration' else 'acquisition' end as phase, image_id, row, col, band, round((value - dk) / case when image_id % 2 = 0 then 2.0 else 4.0 end, 6) as value from planes join dark using (row, col, band)", "planes")
def subtract_dark(spark: SparkSession, d: str) -> DataFrame:
    """Calibration frames over 2.0, acquisition frames over 4.0: each over its own exposure time."""
    p, dark = V.pixels(spark, d), R.mean_dark_frame(V.dark(spark, d), N)
    phases = (("calibration", 0, 2.0, 4.0), ("acquisition", 1, 4.0, 2.0))
    a, b = (R.subtract_dark(p.where(F.col("image_id") % 2 == k), dark, own, other).withColumn("phase", F.lit(name)) for name, k, own, other in phases)
    return long(a.unionByName(b), "phase", *PIXEL)


@query("select image_id, row, col, panel, band, value from inroi", "inroi")
def roi_pixels(spark: SparkSession, d: str) -> DataFrame:
    return long(R.roi_pixels(V.pixels(spark, d), V.roi(spark)), *PIXEL, "panel")


def _roi_means(spark: SparkSession, d: str) -> DataFrame:
    return R.roi_mean(V.pixels(spark, d), V.roi(spark), N)


@query("select image_id, panel, band, round(value, 6) as value from means", "means")
def roi_mean(spark: SparkSession, d: str) -> DataFrame:
    return long(_roi_means(spark, d), "image_id", "panel")


@query("select band, panel, round(measured, 6) as measured from measured", "measured")
def mean_of_shots(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.mean_of_shots(_roi_means(spark, d)), "measured")


def _reflectance(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("wavelength"), (F.col("p_retailprice").cast("double") / 100).alias("pct"))
    return p.select("wavelength", F.lit("W").alias("panel"), F.lit("total").alias("kind"), "pct")


@query("select band, 'W' as panel, round(p_retailprice::double / 100 / 100, 9) as known from bands_dim join part on p_partkey = round_even(wavelength, 0)", "bands_dim")
def panel_lookup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.panel_lookup(V.bands_dim(spark), _reflectance(spark, d), "total"), "known", digits=9)


def _coef(spark: SparkSession, d: str) -> DataFrame:
    return R.fit_empirical_line(R.mean_of_shots(_roi_means(spark, d)), V.known(spark), origin=False)


@query("select band, round(intercept, 6) as intercept, round(slope, 9) as slope from coef", "coef")
def fit_empirical_line(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(_coef(spark, d), "intercept"), "slope", digits=9)


@query("select image_id, row, col, band, round(least(greatest(coalesce((value * slope + intercept) * 1.0, value), 0), 1), 5) as value from planes left join (select * from coef where band < 9) using (band)", "planes", "coef")
def apply_empirical_line(spark: SparkSession, d: str) -> DataFrame:
    """Band 9 has no line: it keeps its value, and is clipped like the others."""
    return long(R.apply_empirical_line(V.pixels(spark, d), _coef(spark, d).where("band < 9"), 1.0, clip=True), *PIXEL, digits=5)


@query("select band, 0.0::double as intercept, round(known / measured, 12) as slope from measured join known using (band, panel) where panel = 3", "measured", "known")
def fit_single_panel(spark: SparkSession, d: str) -> DataFrame:
    """One panel section: the line through the origin, saved and loaded again."""
    one = R.fit_empirical_line(R.mean_of_shots(_roi_means(spark, d)).where("panel = 3"), V.known(spark), origin=True)
    path = V.scratch(spark, "line")
    R.save_line(one, path)
    return rounded(rounded(R.load_line(spark, path), "intercept"), "slope", digits=12)


@query("select image_id, panel, band, round(avg(value * slope + intercept), 5) as value from inroi join coef using (band) group by all", "inroi", "coef")
def calibrate_panel_check(spark: SparkSession, d: str) -> DataFrame:
    return long(R.calibrate_panel_check(V.pixels(spark, d), _coef(spark, d), V.roi(spark), N), "image_id", "panel", digits=5)


@query("select band, i::int as i, round(i * (65535.0 / 99), 6) as measured, round(intercept + slope * (i * (65535.0 / 99)), 5) as known from coef, range(100) r(i)", "coef")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(R.calibration_curve(_coef(spark, d)), "measured"), "known", digits=5)


@query("select panel, band, floor(value / 512)::bigint as bin, count(*) as pixels from inroi group by all", "inroi")
def dn_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.dn_histogram(V.pixels(spark, d), V.roi(spark), 512)


@query("select panel, arg_max(band, measured) as band from measured group by panel", "measured")
def brightest_band(spark: SparkSession, d: str) -> DataFrame:
    return R.brightest_band(_roi_means(spark, d))


@query("with a as (select band, panel, avg(value) as m from means where image_id % 2 = 0 group by all), b as (select band, panel, avg(value) as m from means where image_id % 2 = 1 group by all) select band, panel, round(case when band < 4 then b.m / 0.5 else a.m end, 6) as measured from a join b using (band, panel)", "means")
def splice_panel(spark: SparkSession, d: str) -> DataFrame:
    m = _roi_means(spark, d)
    return rounded(R.splice_panel(R.mean_of_shots(m.where("image_id % 2 = 0")), R.mean_of_shots(m.where("image_id % 2 = 1")), 4, 0.5), "measured")


@query("select image_id, band, sensor, count(*) as n from planes join (select band, case when band < 5 then 2 else 1 end as sensor from bands_dim) using (band) group by all", "planes", "bands_dim")
def assign_sensor(spark: SparkSession, d: str) -> DataFrame:
    return V.planes(spark, d).join(A.assign_sensor(V.bands_dim(spark), 5).select("band", "sensor"), "band").groupBy("image_id", "band", "sensor").agg(F.count("*").alias("n"))


_LENS_SQL = "select case when band < 5 then 2 else 1 end as sensor, " + ", ".join(f"round(avg({c}), 6) as {c}" for c in A.LENS) + "{} from (select band, avg(value) as fx, max(value) as fy, min(value) as cx, stddev_pop(value) as cy, avg(value * row) / 1e6 as k1, avg(value * col) / 1e6 as k2, avg(row * col) as p1, min(value) / 1e6 as p2, max(value) / 1e6 as k3 from planes group by band) group by 1"


def _lens(spark: SparkSession, d: str) -> DataFrame:
    v, row, col = F.col("value"), F.col("row"), F.col("col")
    of = dict(zip(A.LENS, (F.avg(v), F.max(v), F.min(v), F.stddev_pop(v), F.avg(v * row) / 1e6, F.avg(v * col) / 1e6, F.avg(row * col), F.min(v) / 1e6, F.max(v) / 1e6), strict=True))
    return A.average_lens_params(V.planes(spark, d).groupBy("band").agg(*[x.alias(c) for c, x in of.items()]), 5)


@query(_LENS_SQL.format("".join(f", round(avg({c}) * 0.0055, 8) as {c}_mm" for c in A.LENS[:4])), "planes")
def average_lens_params(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(_lens(spark, d), *A.LENS), *[f"{c}_mm" for c in A.LENS[:4]], digits=8)


@query(_LENS_SQL.format(""), "planes")
def load_lens(spark: SparkSession, d: str) -> DataFrame:
    """Both sensors' parameters, saved and loaded again."""
    path = V.scratch(spark, "lens")
    A.save_lens(_lens(spark, d), path, "s")
    files = {k: (f"{path}/s_intrinsic_matrix_{k}", f"{path}/s_distortion_{k}") for k in (1, 2)}
    return rounded(A.load_lens(spark, files), *A.LENS)


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return I.mask_join(V.pixels(spark, d), V.masks(spark, d))


@query("select image_id, ann_id, row, col, band, value from masked", "masked")
def mask_join(spark: SparkSession, d: str) -> DataFrame:
    return long(_masked(spark, d), "image_id", "ann_id", "row", "col")


@query("select image_id, ann_id, band, round(lo, 6) as lo, round(hi, 6) as hi from bounds", "bounds")
def iqr_bounds(spark: SparkSession, d: str) -> DataFrame:
    m = I.mask_join(I.pixel_layout(V.pixels(spark, d)), V.masks(spark, d))
    b = I.iqr_bounds(m, N, 1.2).select("image_id", "ann_id", F.posexplode(F.arrays_zip("lo", "hi")).alias("band", "x")).where("x.lo is not null")
    return rounded(b.select("image_id", "ann_id", "band", "x.lo", "x.hi"), "lo", "hi")


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return I.clean_instances(I.pixel_layout(V.pixels(spark, d)), V.masks(spark, d), N, 1.2)


@query("select image_id, ann_id, row, col, band, value from clean", "clean")
def remove_outlier_pixels(spark: SparkSession, d: str) -> DataFrame:
    return long(_clean(spark, d), "image_id", "ann_id", "row", "col")


def _inst(spark: SparkSession, d: str) -> DataFrame:
    return I.instance_mean_spectrum(_clean(spark, d), N, ("plant_no", "grape_no"))


@query("select image_id, ann_id, band, round(value, 6) as value from inst", "inst")
def instance_mean_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return long(_inst(spark, d), "image_id", "ann_id")


@query("select plant_no, band, round(value, 6) as value from plant", "plant")
def plant_mean_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return long(I.plant_mean_spectrum(_inst(spark, d), N), "plant_no")


@query("select plant_no, Brix, band, round(value, 6) as value from plant join lab_plant on plant_no = plant", "plant", "lab_plant")
def join_lab_plant(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: mean clean spectrum of each plant with its laboratory value."""
    return long(I.join_lab_plant(I.plant_mean_spectrum(_inst(spark, d), N), V.lab_plant(spark, d), V.DATE), "plant_no", "Brix")


_BUNCH = "select 'g1p' || plant as code, Brix from lab_plant"


@query(f"with i as ({_INST}), b as ({_BUNCH}) select image_id, ann_id, code, Brix from i join b on code = 'g' || grape_no || 'p' || plant_no", "masks", "lab_plant")
def join_lab_bunch(spark: SparkSession, d: str) -> DataFrame:
    lab = V.lab_plant(spark, d).select(F.concat(F.lit("g1p"), "plant").alias("code"), "Brix")
    return I.join_lab_bunch(I.instance_key(_instances(spark, d)), lab).select("image_id", "ann_id", "code", "Brix")


@query(f"with i as ({_INST}), b as ({_BUNCH}) select image_id, ann_id from i where 'g' || grape_no || 'p' || plant_no not in (select code from b)", "masks", "lab_plant")
def unmatched_bunches(spark: SparkSession, d: str) -> DataFrame:
    lab = V.lab_plant(spark, d).select(F.concat(F.lit("g1p"), "plant").alias("code"), "Brix")
    return I.unmatched_bunches(I.instance_key(_instances(spark, d)), lab).select("image_id", "ann_id")


@query("select image_id, ann_id, dense_rank() over (order by image_id)::int as image_no, row_number() over (partition by image_id order by ann_id)::int as ann_no from (select distinct image_id, ann_id from masks)", "masks")
def number_annotations(spark: SparkSession, d: str) -> DataFrame:
    return I.number_annotations(_instances(spark, d)).select("image_id", "ann_id", "image_no", "ann_no")


@query("select '2021-09-06' as Date, plant, Brix from lab_plant union all select '2022-09-15', plant, Brix + 1 from lab_plant", "lab_plant")
def stack_campaigns(spark: SparkSession, d: str) -> DataFrame:
    lab = V.lab_plant(spark, d).select("plant", "Brix")
    return I.stack_campaigns({"2021-09-06": lab, "2022-09-15": lab.withColumn("Brix", F.col("Brix") + 1)})


_BIN = "select *, case when max(value) over w > min(value) over w then least(floor((value - min(value) over w) / (max(value) over w - min(value) over w) * 4), 3) end as bin from planes window w as (partition by image_id, band)"
_H = "select {k}, -sum(n / t * ln(n / t)) as h from (select {k}, sum(n)::double as n from joint group by {k}, {x}) join (select {k}, sum(n)::double as t from joint group by {k}) using ({k}) group by {k}"


def _nmi_sql(k: str) -> str:
    return ", ".join(f"{name} as ({_H.format(k=k, x=x)})" for name, x in (("ha", "a"), ("hb", "b"), ("hab", "a, b"))) + f", found as (select {k}, case when hab.h > 1e-12 then (ha.h + hb.h) / hab.h end as nmi from ha join hb using ({k}) join hab using ({k}))"


@query(f"with b as ({_BIN}), joint as (select x.image_id, x.band, x.bin as a, y.bin as b, count(*) as n from b x join b y on x.image_id = y.image_id and x.row = y.row and x.col = y.col and y.band = 5 and x.band <> 5 group by all), {_nmi_sql('image_id, band')} select image_id, band, round(nmi, 6) as nmi from found", "planes")
def normalized_mi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.normalized_mi(V.pixels(spark, d), 5, N, 4), "nmi")


@query("select image_id, band, round(sum(row * value) / sum(value), 6) as row_c, round(sum(col * value) / sum(value), 6) as col_c from planes group by all", "planes")
def intensity_centroid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.intensity_centroid(V.planes(spark, d)), "row_c", "col_c")


_START = "c as (select image_id, band, sum(row * value) / sum(value) as r, sum(col * value) / sum(value) as k from planes group by all), s as (select c.image_id, c.band, round(e.r - c.r)::int as r0, round(e.k - c.k)::int as k0 from c join c e on e.image_id = c.image_id and e.band = 5 and c.band <> 5)"


@query(f"with b as ({_BIN}), {_START}, shifts as (select image_id, band, (r0 + i)::int as d_row, (k0 + j)::int as d_col from s, range(-5, 6) x(i), range(-5, 6) y(j)), counted as (select x.image_id, x.band, d_row, d_col, x.bin as a, y.bin as b, count(*) as n from b x join shifts using (image_id, band) join b y on x.image_id = y.image_id and x.row + d_row = y.row and x.col + d_col = y.col and y.band = 5 group by all), joint as (select * from counted qualify sum(n) over (partition by image_id, band, d_row, d_col) >= 16), {_nmi_sql('image_id, band, d_row, d_col')}, best as (select *, row_number() over (partition by image_id, band order by round(nmi, 9) desc nulls last, d_row, d_col) as n from found) select image_id, band, d_row, d_col, round(nmi, 6) as nmi from best where n = 1", "planes")
def coarse_shift_search(spark: SparkSession, d: str) -> DataFrame:
    """All 121 shifts around the offset of the centers of mass."""
    return rounded(A.coarse_shift_search(V.planes(spark, d), 5, 8, 8, max_shift=10, samples=10, bins=4), "nmi")


@query("select g.image_id, g.band, g.row, g.col, coalesce(p.value, 0) as value from planes g left join planes p on p.image_id = g.image_id and p.band = g.band and p.row = g.row - g.band % 3 and p.col = g.col + 1", "planes")
def apply_shift(spark: SparkSession, d: str) -> DataFrame:
    p = V.planes(spark, d)
    shifts = p.select("image_id", "band").distinct().select("image_id", "band", (F.col("band") % 3).alias("d_row"), F.lit(-1).alias("d_col"))
    return A.apply_shift(p, shifts)


_LENS = {1: dict(fx=9.0, fy=9.0, cx=3.6, cy=3.4, k1=-0.28, k2=0.31, p1=-0.0002, p2=0.0018, k3=0.0), 2: dict(fx=8.5, fy=8.7, cx=3.4, cy=3.6, k1=-0.2, k2=0.1, p1=0.001, p2=-0.001, k3=0.0)}
_LENS_ROWS = ", ".join(str((s, *p.values())) for s, p in _LENS.items())


@query(f"with lens as (select * from (values {_LENS_ROWS}) t(sensor, fx, fy, cx, cy, k1, k2, p1, p2, k3)), g as (select *, (col - cx)::double / fx as x, (row - cy)::double / fy as y from lens, (select r::int as row from range(8) a(r)), (select c::int as col from range(8) b(c))), h as (select *, x * x + y * y as r2 from g), s as (select sensor, row, col, (y * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) * fy + cy as sr, (x * (1 + r2 * (k1 + r2 * (k2 + r2 * k3))) + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) * fx + cx as sc from h), m as (select sensor, row, col, floor(sr) + i as u, floor(sc) + j as v, (1 - abs(sr - floor(sr) - i)) * (1 - abs(sc - floor(sc) - j)) as w from s, range(2) e(i), range(2) f(j)), o as (select p.image_id, p.band, m.row, m.col, sum(p.value * w) as value from m join planes p on p.row = u and p.col = v and m.sensor = case when p.band < 5 then 2 else 1 end where w > 0 group by all) select p.image_id, p.band, p.row, p.col, round(coalesce(o.value, 0), 3) as value from planes p left join o using (image_id, band, row, col)", "planes")
def undistort(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.undistort(V.planes(spark, d), _LENS, 5, 8, 8), "value", digits=3)


@query("select band, round(quantile_cont(diff, 0.5), 6) as median from diffs group by band", "diffs")
def median_by_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.median_by_band(_diffs(spark, d), "diff"), "median")


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_methods(V.nmi(spark, d, "A"), V.nmi(spark, d, "R"))


@query("select image_id, band, round(diff, 6) as diff from diffs", "diffs")
def pair_methods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_diffs(spark, d), "diff")


ITERS = 10_000
_SIGN = "(1.0 - 2.0 * (((instr('0123456789abcdef', substr(h, f::int // 4 + 1, 1)) - 1) >> (3 - f::int % 4)) & 1))"


def _flipped(key: str) -> str:
    """diffs with x, the difference times its sign, in each iteration i."""
    return f"select band, e * {S.FLIPS} + f as i, diff * {_SIGN} as x from (select *, md5({key}) as h from diffs, range(0, {-(-ITERS // S.FLIPS)}) e(e)), range(0, {S.FLIPS}) f(f) where e * {S.FLIPS} + f < {ITERS}"


_PER_BAND = f"with t0 as (select band, round(quantile_cont(diff, 0.5) * quantile_cont(diff, 0.5), 12) as t0 from diffs group by band), m as (select band, i, quantile_cont(x, 0.5) as m from ({_flipped("band || '-' || e || '-' || image_id")}) group by band, i), tests as (select band as test, avg(case when round(m * m, 12) > t0 then 1.0 else 0.0 end) as p from m join t0 using (band) group by band)"


@query(f"{_PER_BAND} select test, round(p, 6) as p from tests", "diffs")
def permutation_test_per_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.permutation_test_per_band(_diffs(spark, d), ITERS), "p")


@query(f"with t0 as (select round(sum(m * m), 12) as t0 from (select avg(diff) as m from diffs group by band)), m as (select i, band, avg(x) as m from ({_flipped("e || '-' || image_id")}) group by i, band) select round(avg(case when t > t0 then 1.0 else 0.0 end), 6) as p from (select i, round(sum(m * m), 12) as t from m group by i), t0", "diffs")
def permutation_test_global(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.permutation_test_global(_diffs(spark, d), ITERS), "p")


_STEP = "select test, m <= coalesce(max(case when p <= m * {a} / (n * {c}) then m end) over (), 0) as rejected from (select test, p, row_number() over (order by p, test) as m, count(*) over ()::double as n from {t})"


@query("select test, p < 0.05 as rejected from pvalues", "pvalues")
def correct_none(spark: SparkSession, d: str) -> DataFrame:
    return S.correct_none(V.pvalues(spark, d), 0.05).select("test", "rejected")


@query("select test, p < 0.05 / count(*) over () as rejected from pvalues", "pvalues")
def correct_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return S.correct_bonferroni(V.pvalues(spark, d), 0.05).select("test", "rejected")


@query(_STEP.format(a=0.3, c="1", t="pvalues"), "pvalues")
def correct_bh(spark: SparkSession, d: str) -> DataFrame:
    return S.correct_bh(V.pvalues(spark, d), 0.3).select("test", "rejected")


@query(_STEP.format(a=0.3, c="(ln(n) + 0.57721 + 1 / (2 * n))", t="pvalues"), "pvalues")
def correct_by(spark: SparkSession, d: str) -> DataFrame:
    return S.correct_by(V.pvalues(spark, d), 0.3).select("test", "rejected")


@query(f"{_PER_BAND}, cor as ({_STEP.format(a=0.1, c='(ln(n) + 0.57721 + 1 / (2 * n))', t='tests')}), med as (select band, round(quantile_cont(a.nmi, 0.5), 6) as median_a, round(quantile_cont(b.nmi, 0.5), 6) as median_b, round(quantile_cont(a.nmi - b.nmi, 0.5), 6) as median_diff from nmi_a a join nmi_b b using (image_id, band) group by band) select band, median_a, median_b, median_diff, round(p, 6) as p, rejected from med join tests on tests.test = band join cor on cor.test = band", "diffs")
def compare_methods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.compare_methods(V.nmi(spark, d, "A"), V.nmi(spark, d, "R"), "by", 0.1, ITERS), "median_a", "median_b", "median_diff", "p")


@query(f"{_PER_BAND.replace("diffs", "half_diffs")}, cor as ({_STEP.format(a=0.1, c='(ln(n) + 0.57721 + 1 / (2 * n))', t='tests')}), med as (select band, round(quantile_cont(a.nmi, 0.5), 6) as median_a, round(quantile_cont(b.nmi, 0.5), 6) as median_b, round(quantile_cont(a.nmi - b.nmi, 0.5), 6) as median_diff from half_a a join half_b b using (image_id, band) group by band) select band, median_a, median_b, median_diff, round(p, 6) as p, rejected from med join tests on tests.test = band join cor on cor.test = band", "half_diffs")
def compare_halves(spark: SparkSession, d: str) -> DataFrame:
    """Over every other image of each method."""
    return rounded(S.compare_methods(V.nmi(spark, d, "A"), V.nmi(spark, d, "R"), "by", 0.1, ITERS, halved=True), "median_a", "median_b", "median_diff", "p")


@query("with s as (select event_type, count(value) as n, avg(value) as mean, stddev_pop(value) as std, min(value) as least, max(value) as most, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3 from events group by all) select s.event_type, n, round(mean, 6) as mean, round(std, 6) as std, least, most, round(q1, 6) as q1, round(q2, 6) as q2, round(q3, 6) as q3, min(value) as whisker_lo, max(value) as whisker_hi from s join events e on e.event_type = s.event_type and value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.group_summary(V.table(spark, d, "events"), "event_type", "value"), "mean", "std", "q1", "q2", "q3")


@query("select id, round((target - (select least(min(p_retailprice::double), (select min(target) from spectra)) from part)) / (select greatest(max(p_retailprice::double), (select max(target) from spectra)) - least(min(p_retailprice::double), (select min(target) from spectra)) from part), 9) as target from spectra", "spectra")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    other = V.table(spark, d, "part").select(F.col("p_retailprice").cast("double").alias("target"))
    return rounded(S.minmax_scale(V.spectra(spark, d), other, "target").select("id", "target"), "target", digits=9)


_GRP = "with g as (select *, (select count(*) from (select unnest(quantile_cont(target, [0.2, 0.4, 0.6, 0.8])) as e from spectra) where e < target)::int as grp from spectra)"
_FOLD = _GRP + ", c as (select *, min(idx) over (partition by grp) as code from g), p as (select *, row_number() over (order by code, idx) - 1 as p, row_number() over (partition by grp order by idx) as rk from c), s as (select grp, p % 5 as fold, row_number() over (partition by grp order by p % 5, p) as rk from p), f as (select id, idx, target, bands, grp, fold from p join s using (grp, rk))"


@query(f"{_GRP} select id, grp from g", "spectra")
def quantile_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.quantile_groups(V.spectra(spark, d), "target", 5).select("id", "grp")


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_folds(S.quantile_groups(V.spectra(spark, d), "target", 5), 5)


@query(f"{_FOLD} select id, fold::int as fold from f", "spectra")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d).select("id", F.col("fold").cast("int").alias("fold"))


@query("select id, (ntile(7) over (order by idx) - 1)::int as inner from spectra".replace("as inner", 'as "inner"'), "spectra")
def contiguous_folds(spark: SparkSession, d: str) -> DataFrame:
    return S.contiguous_folds(V.spectra(spark, d), 7).select("id", F.col("inner").cast("int").alias("inner"))


@query("select id, (row_number() over (order by idx) - 1) // 7 as batch from spectra", "spectra")
def batch_number(spark: SparkSession, d: str) -> DataFrame:
    return S.batch_number(V.spectra(spark, d), 7, "idx").select("id", "batch")


@query("select id, row_number() over (order by md5('42:' || id), id)::int as idx from spectra", "spectra")
def shuffle_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.shuffle_rows(V.spectra(spark, d), 42).select("id", "idx")


@query("with s as (select id, avg(value) as m, stddev_pop(value) as s from long group by id) select id, band, round((value - m) / s, 6) as value from long join s using (id)", "long")
def snv(spark: SparkSession, d: str) -> DataFrame:
    return long(B.snv(V.spectra(spark, d)), "id")


@query("with c as (select id, band, value - avg(value) over (partition by id) as x from long), r as (select band, avg(x) as r from c group by band), f as (select id, regr_slope(x, r) as b, regr_intercept(x, r) as a from c join r using (band) group by id) select id, band, round((x - a) / b, 5) as value from c join f using (id)", "long")
def msc(spark: SparkSession, d: str) -> DataFrame:
    return long(B.msc(V.spectra(spark, d), 64), "id", digits=5)


@query("with s as (select band, avg(value) as m, stddev_pop(value) as s from long group by band) select id, band, round((value - m) / s, 6) as value from long join s using (band)", "long")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return long(B.standardize(V.spectra(spark, d), 64), "id")


_SG = B.savgol_weights(7, 3, 1)


@query("select id, (band - 3)::int as band, round(v, 6) as value from (select id, band, " + " + ".join(f"lag(value, {3 - j}) over w * {w!r}" if j <= 3 else f"lead(value, {j - 3}) over w * {w!r}" for j, w in enumerate(_SG)) + " as v from long window w as (partition by id order by band)) where v is not null", "long")
def savgol(spark: SparkSession, d: str) -> DataFrame:
    return long(B.savgol(V.spectra(spark, d), 7, 3, 1, 64), "id")


_EDGES = [B.savgol_weights(7, 3, 1, at=k) for k in range(7)]
_ROWS = ", ".join(str((k, (start := min(max(k - 3, 0), 57)) + 1, _EDGES[k - start])) for k in range(64))


@query(f"select id, band::int as band, round(list_inner_product(bands[s:s + 6], w), 6) as value from spectra, (values {_ROWS}) t(band, s, w)", "spectra")
def savgol_full(spark: SparkSession, d: str) -> DataFrame:
    """All bands: the outermost are read off the fits to the outermost windows."""
    return long(B.savgol(V.spectra(spark, d), 7, 3, 1, 64, trim=False), "id")


@query("select round(least(min(p_retailprice::double), (select min(target) from spectra)), 6) as lo, round(greatest(max(p_retailprice::double), (select max(target) from spectra)), 6) as hi from part", "spectra")
def target_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.target_range(V.spectra(spark, d), V.table(spark, d, "part").select(F.col("p_retailprice").cast("double").alias("target")), "target"), "lo", "hi")


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return P.pls_predict(_folds(spark, d), [10.0] * 64, 1200.0)


_PRED = _FOLD + ", pred as (select *, 1200 + list_sum(bands) * 10 as pred from f)"
_METRIC = "select fold::bigint as fold, avg((target - pred) * (target - pred)) as mse, 1 - avg((target - pred) * (target - pred)) / var_pop(target) as r2 from pred group by fold"


@query(f"{_PRED} select id, round(pred, 6) as pred from pred", "spectra")
def pls_predict(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pred(spark, d).select("id", "pred"), "pred")


@query(f"{_PRED} select fold, round(mse, 4) as mse, round(sqrt(mse), 4) as rmse, round(r2, 6) as r2 from ({_METRIC})", "spectra")
def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(P.fold_metrics(_pred(spark, d), ["fold"]), "mse", "rmse", digits=4), "r2").withColumn("fold", F.col("fold").cast("long"))


@query(f"{_PRED} select round(regr_slope(pred, target), 6) as slope, round(regr_intercept(pred, target), 4) as intercept from pred", "spectra")
def pred_vs_true_line(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(P.pred_vs_true_line(_pred(spark, d)), "slope"), "intercept", digits=4)


@query(f"{_PRED}, m as ({_METRIC}) select fold, round(mse, 4) as mse, round(sqrt(mse), 4) as rmse, round(r2, 6) as r2, null::double as mse_std, null::double as rmse_std, null::double as r2_std from m union all select null, round(avg(mse), 4), round(avg(sqrt(mse)), 4), round(avg(r2), 6), round(stddev_pop(mse), 4), round(stddev_pop(sqrt(mse)), 4), round(stddev_pop(r2), 6) from m", "spectra")
def cv_report(spark: SparkSession, d: str) -> DataFrame:
    r = P.cv_report(P.fold_metrics(_pred(spark, d), ["fold"]).withColumn("fold", F.col("fold").cast("long")))
    return rounded(rounded(r, "mse", "rmse", "mse_std", "rmse_std", digits=4), "r2", "r2_std")


def _table(spark: SparkSession, d: str) -> DataFrame:
    p = V.table(spark, d, "part")
    return p.select((F.col("p_partkey") % 3).alias("der"), (F.col("p_partkey") % 9).alias("ord"), F.lit(11).alias("wl"), (F.col("p_partkey") % 15 + 1).alias("components"), F.col("p_retailprice").cast("double").alias("mse")).groupBy("der", "ord", "wl", "components").agg(F.round(F.avg("mse"), 6).alias("mse"))


_TABLE = "with t as (select p_partkey % 3 as der, p_partkey % 9 as ord, 11 as wl, p_partkey % 15 + 1 as components, round(avg(p_retailprice::double), 6) as mse from part group by all)"


@query(f"{_TABLE} select der, ord, wl, components from (select *, row_number() over (partition by der, ord, wl order by mse, components) as n from t) where n = 1")
def best_components(spark: SparkSession, d: str) -> DataFrame:
    return P.best_components(_table(spark, d))


@query(f"{_TABLE} select der, ord, wl, mse from t where mse <> 0 order by mse, der, ord, wl limit 1")
def best_preprocessing(spark: SparkSession, d: str) -> DataFrame:
    return P.best_preprocessing(_table(spark, d)).select("der", "ord", "wl", "mse")


_CENTERED = "cen as (select band, avg(value) as v from long group by band union all select 64, avg(target) from f union all select -1, 0), xs as (select fold, id, band, value from (select fold, id, -1 as band, 1.0::double as value from f union all select fold, f.id, band, value from f join long using (id) union all select fold, id, 64, target from f)), zs as (select fold, id, band + 1 as k, value - v as value from xs join cen using (band))"


@query(f"{_FOLD}, {_CENTERED} select fold::int as fold, (a.k * 66 + b.k)::int as k, round(sum(a.value * b.value), 4) as m from zs a join zs b using (fold, id) group by fold, a.k, b.k", "long")
def moments(spark: SparkSession, d: str) -> DataFrame:
    """All numbers of each fold's centred Gram matrix."""
    m = P.moments(_folds(spark, d), "fold").select("fold", F.posexplode("m").alias("k", "m"))
    return rounded(m, "m", digits=4)


def _ten_folds(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_folds(S.quantile_groups(V.spectra(spark, d), "target", 5), 10).withColumn("fold", F.col("fold").cast("int"))


@query()
def cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """Single and nested cross-validation of plain spectra: 10 outer and 10 inner folds, 15 components."""
    return P.cv_summary(P.cross_validate(_ten_folds(spark, d)))


@query()
def preprocessing_grid(spark: SparkSession, d: str) -> DataFrame:
    """Single and nested results of SNV, MSC and the 243 filters on SNV spectra."""
    return P.cv_summary(P.preprocessing_grid(_ten_folds(spark, d), 64), "prep")


@query()
def select_best(spark: SparkSession, d: str) -> DataFrame:
    """The filter with the least nested error."""
    return P.select_best(P.preprocessing_grid(_ten_folds(spark, d), 64).where("prep = 'sg'"))


@query("with m as (select image_id, ann_id, min(row) as r, min(col0) as c from masks group by all), e as (select *, r + k as row, ceil(c + 4 * (1 - (k + 0.5) / 5) - 0.5)::int as stop from m, range(5) t(k)) select image_id, ann_id, row::int as row, c::int as col0, least(stop, 8)::int as col1 from e where least(stop, 8) > c", "masks")
def rasterize_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Row runs of a triangle per instance."""
    m = V.masks(spark, d).groupBy("image_id", "ann_id").agg(F.min("row").alias("r"), F.min("col0").alias("c"))
    corner = [F.col("c"), F.col("r"), F.col("c") + 4, F.col("r"), F.col("c"), F.col("r") + 5]
    polygon = F.array(F.array(*[x.cast("double") for x in corner]))
    return T.rasterize_polygons(m.select("image_id", "ann_id", polygon.alias("segmentation"), F.lit(8).alias("width"), F.lit(8).alias("height")))


def _cubes(spark: SparkSession, d: str) -> str:
    """The images as ENVI cubes in a new folder whose name has a space."""
    path = f"{V.scratch(spark, 'cubes')} x"
    E.write_envi(V.pixels(spark, d), path, 8, 8, N)
    return path


_CUBE = "select distinct image_id::varchar as image_id"


@query(f"{_CUBE}, 'cube.hdr' as hdr, 'cube.dat' as dat from planes", "planes")
def list_acquisitions(spark: SparkSession, d: str) -> DataFrame:
    last = lambda c: F.element_at(F.split(c, "/"), -1).alias(c)
    return E.list_acquisitions(spark, _cubes(spark, d)).select("image_id", last("hdr"), last("dat"))


@query(f"{_CUBE}, (8 * 8 * {N} * 4)::bigint as length from planes", "planes")
def write_envi(spark: SparkSession, d: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dat").load(_cubes(spark, d))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("image_id"), "length")


@query("select image_id::varchar as image_id, row, col, band, value from planes", "planes")
def read_envi(spark: SparkSession, d: str) -> DataFrame:
    p = E.read_envi(spark, _cubes(spark, d), 3).withColumn("there", F.transform("bands", lambda v: v.isNotNull()))
    return long(p.withColumn("bands", F.col("bands").cast("array<double>")), *PIXEL)


def _coco(spark: SparkSession, d: str) -> DataFrame:
    """Annotations as read_annotations gives them: the masks' rectangles; the numbers are those of the table."""
    m = V.masks(spark, d).groupBy("image_id", "ann_id", "plant_no", "grape_no").agg(F.min("row").cast("double").alias("r"), F.min("col0").cast("double").alias("c"))
    box = F.array(F.col("c"), F.col("r"), F.lit(4.0), F.lit(5.0)).alias("bbox")
    polygon = F.array(F.col("c"), F.col("r"), F.col("c") + 4, F.col("r"), F.col("c") + 4, F.col("r") + 5, F.col("c"), F.col("r") + 5)
    named = F.concat(F.lit("set/img"), F.lpad(F.col("image_id").cast("string"), 9, "0"), F.lit(".png")).alias("file_name")
    attributes = F.struct((F.col("image_id") % 3 != 0).alias("tagged"), F.col("plant_no").cast("string").alias("plant_no"), F.col("grape_no").cast("string").alias("grape_no")).alias("attributes")
    return m.select(named, F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("ann_id").alias("seq"), box, F.lit(0.995).alias("score"), F.array(polygon, F.array(F.lit(1.0), F.lit(2.0))).alias("segmentation"), attributes)


_COCO = "with m as (select image_id, ann_id, plant_no, grape_no, min(row) as r, min(col0) as c from masks group by all)"


@query(f"{_COCO} select 'img' || lpad(image_id::varchar, 9, '0') as image_id, ann_id::int as ann_id, plant_no::varchar as plant_no, grape_no::varchar as grape_no, image_id % 3 <> 0 as tagged, c::double as x, r::double as y, 1::int as polygons from m", "masks")
def read_annotations(spark: SparkSession, d: str) -> DataFrame:
    path = V.scratch(spark, "coco")
    T.write_annotations(_coco(spark, d), path)
    a = T.read_annotations(spark, path)
    return a.select("image_id", F.col("ann_id").cast("int").alias("ann_id"), "attributes.plant_no", "attributes.grape_no", "attributes.tagged", F.get("bbox", F.lit(0)).alias("x"), F.get("bbox", F.lit(1)).alias("y"), F.size("segmentation").alias("polygons"))


@query(f"{_COCO} select dense_rank() over (order by image_id)::int as no, 'set/img' || lpad(image_id::varchar, 9, '0') || '.png' as file_name, row_number() over (partition by image_id order by ann_id)::int as id, 1::int as category_id, 0::int as iscrowd, c || ',' || r || ',' || c + 4 || ',' || r || ',' || c + 4 || ',' || r + 5 || ',' || c || ',' || r + 5 as polygon, plant_no::varchar as plant_no from m", "masks")
def write_annotations(spark: SparkSession, d: str) -> DataFrame:
    """The written lines, read as plain JSON."""
    path = V.scratch(spark, "coco")
    T.write_annotations(_coco(spark, d), path)
    doc = spark.read.schema(T.COCO).json(path).select(F.explode("images").alias("i"), "annotations").select("i", F.explode("annotations").alias("a"))
    polygon = F.array_join(F.transform(F.flatten("a.segmentation"), lambda v: v.cast("long").cast("string")), ",")
    return doc.select(F.col("a.image_id").alias("no"), "i.file_name", "a.id", "a.category_id", "a.iscrowd", polygon.alias("polygon"), "a.attributes.plant_no")


@query("select c_custkey as seq, 'p' || c_nationkey as plant, round(c_acctbal::double, 6) as \"Brix\" from customer")
def read_lab_table(spark: SparkSession, d: str) -> DataFrame:
    path = V.scratch(spark, "lab")
    c = V.table(spark, d, "customer")
    c.select(F.col("c_custkey").alias("seq"), F.concat(F.lit("p"), "c_nationkey").alias("plant"), F.col("c_acctbal").cast("double").alias("Brix")).write.csv(path, header=True)
    return rounded(T.read_lab_table(spark, path, "seq long, plant string, Brix double"), "Brix")


@query("select p_partkey::int as wavelength, panel, kind, round(p_retailprice::double / f, 6) as pct from part, (values ('White', 'total', 100.0), ('White', 'diffuse', 200.0), ('Black', 'total', 400.0), ('Black', 'diffuse', 800.0)) t(panel, kind, f)")
def read_panel_table(spark: SparkSession, d: str) -> DataFrame:
    path, price = V.scratch(spark, "panels"), F.col("p_retailprice").cast("double")
    wide = [(price / f).alias(c) for c, f in (("White total", 100), ("White diffuse", 200), ("Black total", 400), ("Black diffuse", 800))]
    V.table(spark, d, "part").select(F.col("p_partkey").alias("Wavelength"), *wide).write.csv(path, header=True)
    return rounded(T.read_panel_table(spark, path, ["White", "Black"], ["total", "diffuse"]), "pct")


def _matrix(spark: SparkSession, d: str) -> str:
    path = V.scratch(spark, "matrix")
    T.save_matrix(_coef(spark, d).select("band", "intercept", "slope"), path)
    return path


@query("select band::double as band, round(intercept, 9) as intercept, round(slope, 12) as slope from coef", "coef")
def load_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(T.load_matrix(spark, _matrix(spark, d), ["band", "intercept", "slope"]), "intercept", digits=9), "slope", digits=12)


@query("select band, 3::int as fields from coef", "coef")
def save_matrix(spark: SparkSession, d: str) -> DataFrame:
    fields = F.split("value", ",")
    return spark.read.text(_matrix(spark, d)).select(F.get(fields, F.lit(0)).cast("int").alias("band"), F.size(fields).alias("fields"))


_BANDS = [500.0 + 6.25 * k for k in range(64)]


def _dataset(spark: SparkSession, d: str) -> str:
    path = V.scratch(spark, "dataset")
    T.write_dataset(V.spectra(spark, d).withColumnRenamed("target", "Brix"), path, _BANDS, ["Brix"])
    return path


@query("select id, band, round(value, 6) as value, round(target, 6) as \"Brix\" from long", "long")
def read_dataset(spark: SparkSession, d: str) -> DataFrame:
    return rounded(long(T.read_dataset(spark, _dataset(spark, d), _BANDS, ["Brix"]), "id", "Brix"), "Brix")


@query("select id, round(bands[1], 6) as first, round(bands[64], 6) as last from spectra", "spectra")
def write_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Under its own header: one column per wavelength."""
    t = spark.read.csv(_dataset(spark, d), header=True)
    return rounded(t.select("id", F.col(f"`{_BANDS[0]:g}`").cast("double").alias("first"), F.col(f"`{_BANDS[-1]:g}`").cast("double").alias("last")), "first", "last")
