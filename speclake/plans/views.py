"""Views of the given tables that stand in for cubes, masks, laboratory values and spectra, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import scratch  # noqa: F401

N = 10
WAVELENGTHS = {0: 500.0, 1: 508.2, 2: 556.5, 3: 600.0, 4: 642.7, 5: 688.0, 6: 721.5, 7: 780.0, 8: 842.5, 9: 900.0}
ROI = [(0, 0, 3, 0, 3), (1, 0, 3, 4, 8), (2, 4, 8, 0, 3), (3, 4, 8, 4, 8)]
KNOWN = {0: 0.05, 1: 0.2, 2: 0.5, 3: 0.95}
DATE = "2021-09-06"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def planes(spark: SparkSession, d: str) -> DataFrame:
    """Ten vectors are the ten 8 x 8 bands of an image."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    value = F.round((F.col("v").cast("double") + 1) * 32768)
    return v.select(F.expr("vec_id div 10").alias("image_id"), (F.col("vec_id") % 10).cast("int").alias("band"), F.expr("cast(p div 8 as int)").alias("row"), (F.col("p") % 8).alias("col"), value.alias("value"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """bands by number; there: which of them the image has."""
    of = [F.col("band") == k for k in range(N)]
    bands, there = F.array(*[F.max(F.when(x, F.col("value"))) for x in of]), F.array(*[F.max(x) for x in of])
    return planes(spark, d).groupBy("image_id", "row", "col").agg(bands.alias("bands"), there.alias("there"))


def dark(spark: SparkSession, d: str) -> DataFrame:
    dim = pixels(spark, d).where("image_id % 10 = 0")
    return dim.withColumn("bands", F.transform("bands", lambda v: v * 0.05))


def roi(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROI, "panel int, row0 int, row1 int, col0 int, col1 int")


def known(spark: SparkSession) -> DataFrame:
    return spark.range(N).select(F.col("id").cast("int").alias("band"), F.explode(F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])).alias("panel", "known"))


def bands_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WAVELENGTHS.items()), "band int, wavelength double")


def masks(spark: SparkSession, d: str) -> DataFrame:
    """Three overlapping 5 x 4 instances per image, one row per run, with plant and grape."""
    i = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("image_id")).distinct().withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    runs = i.select("image_id", (F.col("i") + 1).alias("ann_id"), ((F.col("image_id") + F.col("i")) % 25).cast("int").alias("plant_no"), (F.col("i") + 1).alias("grape_no"), ((F.col("image_id") + F.col("i")) % 4).cast("int").alias("r0"), ((F.col("image_id") + 2 * F.col("i")) % 4).cast("int").alias("col0"), F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    return runs.select("image_id", "ann_id", "plant_no", "grape_no", (F.col("r0") + F.col("k")).alias("row"), "col0", (F.col("col0") + 4).alias("col1"))


def lab_plant(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    by = c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_nationkey").agg(F.round(F.avg(F.col("c_acctbal").cast("double")), 5).alias("Brix"))
    return by.select(F.lit(DATE).cast("date").alias("date"), F.col("n_nationkey").cast("int").alias("plant"), F.lit(1).alias("seq"), "Brix")


def spectra(spark: SparkSession, d: str) -> DataFrame:
    e, p = table(spark, d, "embeddings"), table(spark, d, "part")
    s = e.join(p, e["vec_id"] == p["p_partkey"])
    ident = F.concat(F.lit("g"), F.col("label") + 1, F.lit("p"), F.col("vec_id"))
    return s.select(ident.alias("id"), F.col("vec_id").alias("idx"), F.transform("embedding", lambda v: v.cast("double")).alias("bands"), F.col("p_retailprice").cast("double").alias("target"))


def nmi(spark: SparkSession, d: str, flag: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag)
    return li.groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("band")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 9).alias("nmi"))


def pvalues(spark: SparkSession, d: str) -> DataFrame:
    p = F.pow(F.abs(F.col("s_acctbal").cast("double")) / 10000, F.lit(2.0))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("test"), p.alias("p")).where("p > 0 and p <= 1")


_values = lambda rows: ", ".join(str(tuple(r)) for r in rows)
SQL = {
    "planes": "select vec_id // 10 as image_id, (vec_id % 10)::int as band, (p // 8)::int as row, (p % 8)::int as col, round((v::double + 1) * 32768) as value from (select vec_id, unnest(range(64)) as p, unnest(embedding) as v from embeddings)",
    "roi": f"select * from (values {_values(ROI)}) t(panel, row0, row1, col0, col1)",
    "known": f"select b::int as band, panel, k::double as known from range({N}) r(b), (values {_values(KNOWN.items())}) t(panel, k)",
    "bands_dim": f"select band, wavelength::double as wavelength from (values {_values(WAVELENGTHS.items())}) t(band, wavelength)",
    "inroi": "select p.*, panel from planes p join roi on row >= row0 and row < row1 and col >= col0 and col < col1",
    "means": "select image_id, panel, band, avg(value) as value from inroi group by all",
    "measured": "select band, panel, avg(value) as measured from means group by all",
    "coef": "select band, regr_intercept(known, measured) as intercept, regr_slope(known, measured) as slope from measured join known using (band, panel) group by band",
    "masks": "select image_id, (i + 1)::int as ann_id, ((image_id + i) % 25)::int as plant_no, (i + 1)::int as grape_no, ((image_id + i) % 4 + k)::int as row, ((image_id + 2 * i) % 4)::int as col0, ((image_id + 2 * i) % 4 + 4)::int as col1 from (select distinct vec_id // 10 as image_id from embeddings), range(3) a(i), range(5) b(k)",
    "masked": "select m.image_id, ann_id, plant_no, grape_no, p.row, p.col, band, value from planes p join masks m on p.image_id = m.image_id and p.row = m.row and p.col >= col0 and p.col < col1",
    "bounds": "select image_id, ann_id, band, quantile_cont(value, 0.5) - 1.2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) as lo, quantile_cont(value, 0.5) + 1.2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) as hi from masked group by all",
    "bad": "select distinct image_id, ann_id, row, col from masked join bounds using (image_id, ann_id, band) where value < lo or value > hi",
    "clean": "select m.* replace (case when b.image_id is null then value else 0 end as value) from masked m left join bad b using (image_id, ann_id, row, col)",
    "inst": "select image_id, ann_id, plant_no, grape_no, band, coalesce(avg(nullif(value, 0)), 0) as value, sum(value) as s, count(nullif(value, 0)) as n from clean group by all",
    "plant": "select plant_no, a.band, sum(s) / nullif(sum(first), 0) as value from inst a join (select image_id, ann_id, n as first from inst where band = 0) using (image_id, ann_id) group by all",
    "lab_plant": "select n_nationkey::int as plant, round(avg(c_acctbal::double), 5) as Brix from customer join nation on c_nationkey = n_nationkey group by 1",
    "spectra": "select 'g' || (label + 1) || 'p' || vec_id as id, vec_id as idx, list_transform(embedding, lambda v: v::double) as bands, p_retailprice::double as target from embeddings join part on p_partkey = vec_id",
    "long": "select id, idx, target, unnest(range(64))::int as band, unnest(bands) as value from spectra",
    "nmi_a": "select l_suppkey as image_id, l_linenumber as band, round(avg(l_discount::double), 9) as nmi from lineitem where l_returnflag = 'A' group by all",
    "nmi_b": "select l_suppkey as image_id, l_linenumber as band, round(avg(l_discount::double), 9) as nmi from lineitem where l_returnflag = 'R' group by all",
    "diffs": "select a.image_id, a.band, a.nmi - b.nmi as diff from nmi_a a join nmi_b b using (image_id, band)",
    "half_a": "select * from nmi_a where image_id in (select image_id from (select image_id, row_number() over (order by image_id) as n from (select distinct image_id from nmi_a)) where n % 2 = 1)",
    "half_b": "select * from nmi_b where image_id in (select image_id from (select image_id, row_number() over (order by image_id) as n from (select distinct image_id from nmi_b)) where n % 2 = 1)",
    "half_diffs": "select a.image_id, a.band, a.nmi - b.nmi as diff from half_a a join half_b b using (image_id, band)",
    "pvalues": "select s_suppkey as test, pow(abs(s_acctbal::double) / 10000, 2) as p from supplier where pow(abs(s_acctbal::double) / 10000, 2) > 0 and pow(abs(s_acctbal::double) / 10000, 2) <= 1",
}
NEEDS = {
    "inroi": ["planes", "roi"], "means": ["inroi"], "measured": ["means"], "coef": ["measured", "known"], "masked": ["planes", "masks"],
    "bounds": ["masked"], "bad": ["bounds"], "clean": ["bad"], "inst": ["clean"], "plant": ["inst"], "long": ["spectra"], "diffs": ["nmi_a", "nmi_b"],
    "half_a": ["nmi_a"], "half_b": ["nmi_b"], "half_diffs": ["half_a", "half_b"],
}


def with_views(sql: str, *names: str) -> str:
    """sql after the views it names and those they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    views = ", ".join(f"{n} as materialized ({SQL[n]})" for n in order)
    return f"with {views}{', ' + sql[5:] if sql.startswith('with ') else ' ' + sql}"
