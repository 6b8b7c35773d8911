"""Exact quantiles of band arrays in memory that doesn't depend on the rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import per_band
from ..sources.staging import staged

#: Parts of a bracket that are counted at once, and values of a bracket that are sorted in one row.
BINS, SORTED = 128, 4096


def _inside(df: DataFrame, keys: list[str], brackets: DataFrame) -> tuple[DataFrame, list[str]]:
    """The values inside each bracket (keys, band, lo, hi), and the columns that name the bracket: these with `_` before.

    A group's brackets meet its rows as one array.
    """
    by = brackets.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.collect_set(F.struct(F.col("band").alias("_band"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))).alias("_of"))
    same = [df[k].eqNullSafe(by[f"_{k}"]) for k in keys]
    named = [*[f"_{k}" for k in keys], "_band", "_lo", "_hi"]
    each = df.join(by, same).select(*named[:-3], "bands", F.inline("_of"))
    each = each.select(*named, F.get("bands", F.col("_band")).cast("double").alias("value"))
    return each.where((F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))), named


def band_quantiles(df: DataFrame, keys: list[str], n: int, probs: list[float], bins: int = BINS, most: int = SORTED) -> DataFrame:
    """keys, q: by band, the interpolated quantiles of the group's values; null without values (nulls and NaN don't count).

    Each quantile lies between two ranks. A rank's bracket, at first the least and the greatest value, is cut in `bins` parts whose
    counts, added up over tasks, say which part holds the rank; that part's own least and greatest value are the next bracket. A
    bracket of one value, or of at most `most` values, which are then sorted, gives the rank's value.
    """
    real = lambda v: F.nanvl(v.cast("double"), F.lit(None))
    stats = df.groupBy(*keys).agg(per_band(n, lambda v: F.count(real(v))).alias("_n"), per_band(n, lambda v: F.min(real(v))).alias("_lo"), per_band(n, lambda v: F.max(real(v))).alias("_hi"))
    stats = staged(stats, "band-stats")
    each = stats.select(*keys, F.posexplode(F.arrays_zip("_n", "_lo", "_hi")).alias("band", "_s")).where("_s._n > 0")
    position = [(F.col("_s._n") - 1) * p for p in probs]
    ends = F.array(*[F.struct(F.lit(i).alias("prob"), F.lit(side).alias("side"), f(x).cast("long").alias("rank")) for i, x in enumerate(position) for side, f in ((0, F.floor), (1, F.ceil))])
    ranks = each.select(*keys, "band", F.col("_s._lo").alias("lo"), F.col("_s._hi").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("_s._n").alias("inside"), F.inline(ends))
    ranks = staged(ranks, "ranks")
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > most)
    bracket = [*keys, "band", "lo", "hi"]
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in bracket]
    while not ranks.where(wide).isEmpty():
        old = ranks.where(wide)
        values, named = _inside(df, keys, old.select(*bracket))
        part = F.floor(F.nanvl((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins)
        part = F.when(F.col("value") == F.col("_hi"), bins - 1).otherwise(F.least(part, F.lit(bins - 1)))
        counts = values.groupBy(*named, part.alias("_part")).agg(F.count("*").alias("_in"), F.min("value").alias("_least"), F.max("value").alias("_most"))
        before = F.coalesce(F.sum("_in").over(Window.partitionBy(*named).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_before", before)
        place = F.col("rank") - F.col("below") - F.col("_before")
        new = old.join(counts, same).where((place >= 0) & (place < F.col("_in")))
        new = new.select(*keys, "band", F.col("_least").alias("lo"), F.col("_most").alias("hi"), (F.col("below") + F.col("_before")).alias("below"), F.col("_in").alias("inside"), "prob", "side", "rank")
        ranks = staged(ranks.where(~wide).unionByName(new), "ranks")
    several = F.col("lo") < F.col("hi")
    values, named = _inside(df, keys, ranks.where(several).select(*bracket))
    lists = values.groupBy(*named).agg(F.sort_array(F.collect_list("value")).alias("_values"))
    found = ranks.join(lists, same, "left").select(*keys, "band", "prob", "side", F.when(several, F.get("_values", F.col("rank") - F.col("below"))).otherwise(F.col("lo")).alias("value"))
    ends = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("band", "prob", "side").alias("k"), F.col("value").alias("v")))).alias("_at"))
    ends = stats.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n").join(ends, [F.col(f"_{k}").eqNullSafe(ends[k]) for k in keys], "left")

    def quantile(band: Column, i: int, p: float) -> Column:
        at = lambda side: F.try_element_at("_at", F.struct(band.alias("band"), F.lit(i).alias("prob"), F.lit(side).alias("side")))
        x = (F.get("_n", band) - 1) * p
        return at(0) + (at(1) - at(0)) * (x - F.floor(x))

    q = F.array(*[F.array(*[quantile(F.lit(k), i, p) for i, p in enumerate(probs)]) for k in range(n)])
    return ends.select(*[F.col(f"_{k}").alias(k) for k in keys], q.alias("q"))
