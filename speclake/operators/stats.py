"""Paired comparison of two alignment methods, multiple-testing corrections, group summaries, folds.

nmi: image_id, band, nmi. p-values: test, p.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

EULER = 0.57721
#: Sign flips that one digest gives, digests a row has in one group of rows, and numbers of a matrix of flipped values.
FLIPS, DIGESTS, HELD = 128, 8, 1 << 20


def numbered(df: DataFrame, name: str, *order: str, within: str | None = None) -> DataFrame:
    """name: position from 1 in the order, over all rows or those of equal `within` (null: a value of its own); _total: how many there are.

    Rows are range-partitioned, as many ranges as the shuffle's size asks for, and written in order; a row's number is its place in
    its range and the count of the rows in ranges before. Equal keys are split by where rows come from. Nulls come first.
    """
    by = [*([within] if within else []), *order, "_tie"]
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = staged(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    own, part = F.col(within) if within else F.lit(0), F.shiftright("_at", 33)  # the range
    sizes = placed.groupBy(own.alias("_w"), part.alias("_b")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ranges = Window.partitionBy("_w")
    before = F.coalesce(F.sum("_n").over(ranges.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_w", "_b", (before - F.col("_first") + 1).alias("_from"), F.sum("_n").over(ranges).alias("_total"))
    return placed.join(sizes, (part == F.col("_b")) & own.eqNullSafe(F.col("_w"))).withColumn(name, F.col("_from") + F.col("_at")).drop("_w", "_b", "_at", "_from")


def every_other(df: DataFrame, order: str) -> DataFrame:
    """The 1st, 3rd, 5th ... row in order."""
    return numbered(df, "_p", order).where("_p % 2 = 1").drop("_p", "_total")


def pair_methods(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, band, diff of two methods' information."""
    return a.join(b.withColumnRenamed("nmi", "_b"), ["image_id", "band"]).select("image_id", "band", (F.col("nmi") - F.col("_b")).alias("diff"))


def median_by_band(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("band").agg(F.percentile(value, F.lit(0.5)).alias("median"))


def _signs(keys: list[str], blocks: range, iters: int) -> np.ndarray:
    """(keys, iterations of the blocks): 1 or -1 by the bits of the md5 of key and block number; a digest gives FLIPS signs."""
    digests = b"".join(md5(k.replace("*", str(b)).encode()).digest() for k in keys for b in blocks)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(len(keys), -1)
    return 1.0 - 2.0 * bits[:, : iters - blocks[0] * FLIPS]


def _blocks(diff: DataFrame, iters: int, *by: str) -> DataFrame:
    """band, image (text after the block in a key), diff, group: every row in each group of blocks, dealt by `by` in a fixed number of tasks, as few rows mean much work."""
    tasks = int(diff.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    image = F.coalesce(F.concat(F.lit("-"), F.col("image_id").cast("string")), F.lit("")).alias("image")
    return diff.select("band", image, "diff", F.explode(F.sequence(F.lit(0), F.lit((iters - 1) // (FLIPS * DIGESTS)))).alias("group")).repartition(tasks, *by)


def _of_group(group: int, iters: int) -> range:
    return range(group * DIGESTS, min((group + 1) * DIGESTS, -(-iters // FLIPS)))


def permutation_test_per_band(diff: DataFrame, iters: int = 10_000) -> DataFrame:
    """test (band), p: share of sign flips whose squared median is greater than the observed one.

    Iteration i from 0 flips an image by bit i % 128 of the md5 of band, i div 128 and image.
    """
    seen = diff.groupBy("band").agg(F.percentile("diff", F.lit(0.5)).alias("m")).select("band", F.round(F.col("m") * F.col("m"), 12).alias("t0"))

    def medians(pdf: pd.DataFrame) -> pd.DataFrame:
        band = pdf["band"].iloc[0]
        rows = pdf.dropna(subset="diff")
        before, value = "" if pd.isna(band) else f"{int(band)}-", rows["diff"].to_numpy(float)
        keys = [f"{before}*{x}" for x in rows["image"]]
        blocks = _of_group(int(pdf["group"].iloc[0]), iters)
        step = max(1, HELD // max(1, len(value) * FLIPS))
        out = [np.median(value[:, None] * _signs(keys, blocks[i : i + step], iters), axis=0) for i in range(0, len(blocks), step)] if len(value) else []
        m = np.concatenate(out) if out else np.full(min(iters, blocks[-1] * FLIPS + FLIPS) - blocks[0] * FLIPS, np.nan)
        return pd.DataFrame({"band": [band] * len(m), "m": m})

    kind = diff.schema["band"].dataType.simpleString()
    flipped = _blocks(diff, iters, "band", "group").groupBy("band", "group").applyInPandas(medians, f"band {kind}, m double")
    m = F.nanvl("m", F.lit(None))
    t = flipped.select("band", F.round(m * m, 12).alias("t")).join(F.broadcast(seen), "band")  # a row a band
    return t.groupBy(F.col("band").alias("test")).agg(F.avg((F.col("t") > F.col("t0")).cast("double")).alias("p"))


def permutation_test_global(diff: DataFrame, iters: int = 10_000) -> DataFrame:
    """p of the squared length of the mean difference vector; one sign per image, by the md5 of i div 128 and image."""
    t0 = diff.groupBy("band").agg(F.avg("diff").alias("m")).agg(F.round(F.sum(F.col("m") * F.col("m")), 12)).scalar()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group, rows in pdf.groupby("group"):
                image, names = pd.factorize(rows["image"])
                band, bands = pd.factorize(rows["band"], use_na_sentinel=False)
                value = np.zeros((len(bands), len(names)))
                np.add.at(value, (band, image), rows["diff"].to_numpy(float))
                blocks = _of_group(int(group), iters)
                s = value @ _signs([f"*{x}" for x in names], blocks, iters)
                turns = np.arange(s.shape[1]) + blocks[0] * FLIPS
                yield pd.DataFrame({"iter": np.tile(turns, len(bands)), "band": np.repeat(bands, len(turns)), "s": s.ravel(), "n": np.repeat(np.bincount(band), len(turns))})

    kind = diff.schema["band"].dataType.simpleString()
    parts = _blocks(diff.where("diff is not null"), iters, "group", "image").mapInPandas(sums, f"iter int, band {kind}, s double, n long")
    m = parts.groupBy("iter", "band").agg((F.sum("s") / F.sum("n")).alias("m"))
    t = m.groupBy("iter").agg(F.round(F.sum(F.col("m") * F.col("m")), 12).alias("t")).withColumn("t0", t0)
    return t.agg(F.avg((F.col("t") > F.col("t0")).cast("double")).alias("p"))


def correct_none(tests: DataFrame, alpha: float) -> DataFrame:
    return tests.withColumn("rejected", F.col("p") < alpha)


def correct_bonferroni(tests: DataFrame, alpha: float) -> DataFrame:
    n = tests.agg(F.count("*").cast("double")).scalar()
    return tests.withColumn("_n", n).withColumn("rejected", F.col("p") < alpha / F.col("_n")).drop("_n")


def _step_up(tests: DataFrame, alpha: float, penalty: Callable[[Column], Column]) -> DataFrame:
    ranked = tests.withColumn("_m", F.row_number().over(Window.orderBy("p", "test"))).withColumn("_n", F.count("*").over(Window.partitionBy()).cast("double"))
    met = F.when(F.col("p") <= F.col("_m") * alpha / (F.col("_n") * penalty(F.col("_n"))), F.col("_m"))
    return ranked.withColumn("rejected", F.col("_m") <= F.coalesce(F.max(met).over(Window.partitionBy()), F.lit(0))).drop("_m", "_n")


def correct_bh(tests: DataFrame, alpha: float) -> DataFrame:
    """Step-up: ranks up to the largest m with p <= m alpha / n."""
    return _step_up(tests, alpha, lambda n: F.lit(1.0))


def correct_by(tests: DataFrame, alpha: float) -> DataFrame:
    """As correct_bh, with n times the approximate harmonic number."""
    return _step_up(tests, alpha, lambda n: F.log(n) + EULER + 1 / (2 * n))


CORRECTIONS = {"none": correct_none, "bonferroni": correct_bonferroni, "bh": correct_bh, "by": correct_by}


def compare_methods(a: DataFrame, b: DataFrame, correction: str | Callable = "by", alpha: float = 0.1, iters: int = 10_000, halved: bool = False) -> DataFrame:
    """Per band: medians of both methods and of their difference, p, rejected. halved: over every other image of a and of b, in the order of their ids."""
    if halved:
        a, b = (x.join(every_other(x.select("image_id").distinct(), "image_id"), "image_id") for x in (a, b))
    diff = pair_methods(a, b)
    tests = permutation_test_per_band(diff, iters)
    tests = (CORRECTIONS[correction] if isinstance(correction, str) else correction)(tests, alpha)
    both = a.join(b.withColumnRenamed("nmi", "_b"), ["image_id", "band"])
    half = F.lit(0.5)
    med = both.groupBy(F.col("band").alias("test")).agg(F.percentile("nmi", half).alias("median_a"), F.percentile("_b", half).alias("median_b"), F.percentile(F.col("nmi") - F.col("_b"), half).alias("median_diff"))
    return med.join(tests, "test").withColumnRenamed("test", "band")


def group_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, population deviation, quartiles, extremes and whiskers (last values within 1.5 ranges) per group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), q.alias("q"))
    s = s.select("*", *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)]).drop("q")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(s.select(key, (F.col("q1") - reach).alias("_lo"), (F.col("q3") + reach).alias("_hi")), key).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    return s.join(inside.groupBy(key).agg(F.min(value).alias("whisker_lo"), F.max(value).alias("whisker_hi")), key)


def target_range(df: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """lo and hi of a value over both tables."""
    return df.select(value).unionByName(other.select(value)).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def minmax_scale(df: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """value scaled to [0, 1] by its range over both tables."""
    return df.withColumn("_r", target_range(df, other, value).select(F.struct("*")).scalar()).withColumn(value, F.try_divide(F.col(value) - F.col("_r.lo"), F.col("_r.hi") - F.col("_r.lo"))).drop("_r")


def quantile_groups(df: DataFrame, target: str, n: int) -> DataFrame:
    """grp: equal-frequency class from 0, by interpolated quantile edges, right-closed."""
    edges = df.agg(F.percentile(target, F.array(*[F.lit(k / n) for k in range(1, n)]))).scalar()
    return df.withColumn("_e", edges).withColumn("grp", F.size(F.filter("_e", lambda e: e < F.col(target)))).drop("_e")


def stratified_folds(df: DataFrame, k: int, order: str = "idx", grp: str = "grp") -> DataFrame:
    """fold: k folds that keep the classes' shares, dealt in row order.

    Classes in the order of their first rows fill the places 0, 1, 2 ...; place p is of fold p % k. A class's rows, in order, take
    its places of fold 0, then those of fold 1 and so on, so a row's fold follows from its rank and the class's first place.
    """
    classes = df.groupBy(F.col(grp).alias("_g")).agg(F.min(order).alias("_code"), F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = numbered(df, "_rank", order, within=grp).join(classes.select("_g", start.alias("_start")), F.col(grp).eqNullSafe(F.col("_g")))
    places = lambda end, f: F.floor((end - 1 - f) / k) + 1
    upto = [sum((places(F.col("_start") + F.col("_total"), f) - places(F.col("_start"), f) for f in range(last + 1)), F.lit(0)) for last in range(k - 1)]
    fold = sum(((F.col("_rank") > n).cast("long") for n in upto), F.lit(0).cast("long"))
    return ranked.withColumn("fold", fold).drop("_g", "_start", "_rank", "_total")


def contiguous_folds(df: DataFrame, k: int, order: str = "idx", within: str | None = None) -> DataFrame:
    """inner: k contiguous folds, sizes differing by at most 1, the larger ones first."""
    least, more = F.floor(F.col("_total") / k), F.col("_total") % k
    place, large = F.col("_p") - 1, more * (least + 1)
    inner = F.when(place < large, F.floor(place / (least + 1))).otherwise(more + F.floor((place - large) / F.greatest(least, F.lit(1))))
    return numbered(df, "_p", order, within=within).withColumn("inner", inner.cast("int")).drop("_p", "_total")


def batch_number(df: DataFrame, size: int, order: str) -> DataFrame:
    return numbered(df, "_p", order).withColumn("batch", F.floor((F.col("_p") - 1) / size)).drop("_p", "_total")


def shuffle_rows(df: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """idx: position in a seeded order of the ids."""
    drawn = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return numbered(drawn, "idx", "_h", key).withColumn("idx", F.col("idx").cast("int")).drop("_h", "_total")
