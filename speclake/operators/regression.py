"""PLS regression of one target from fold moments, with single and nested cross-validation.

One pass sums n, x, y, x'x, x'y and y'y, less the means over all rows, per (outer, inner) fold; everything after works on those
small sums. A Savitzky-Golay filter is linear, so the moments of filtered spectra follow from those of the plain ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import msc, savgol_weights, snv
from ..sources.staging import staged
from .stats import contiguous_folds

FIELDS = "m array<double>"
#: Bytes of all folds' moments that are sent to the tasks at most, and groups in which a key's partial moments meet first.
MOST_BYTES, FANS = 1 << 29, 64


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Gram matrix of (1, x, y), flat."""
    a = np.column_stack([np.ones(len(x)), x, y])
    return (a.T @ a).ravel()


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of partial Gram matrices (keys, m), on two levels: a key's parts, one a task, meet in FANS groups first."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1][[c for c in pdf.columns if c != "m"]].assign(m=[np.sum(np.stack(pdf["m"]), axis=0)])

    types = dict(parts.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    some = parts.withColumn("_fan", F.spark_partition_id() % FANS)
    some = some.groupBy(*keys, "_fan").applyInPandas(add, f"{schema}, _fan int, {FIELDS}")
    return some.drop("_fan").groupBy(*keys).applyInPandas(add, f"{schema}, {FIELDS}")


def center(spectra: DataFrame) -> tuple[np.ndarray, float]:
    """The means of bands and target: a number a band."""
    mean = {r["k"]: r["v"] for r in spectra.select(F.posexplode("bands").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).collect()}
    return np.array([mean[k] for k in sorted(mean)]), spectra.agg(F.avg("target")).first()[0]


def _gathered(rows: DataFrame, at: tuple[np.ndarray, float]) -> DataFrame:
    """outer, inner, m: the centred Gram matrix of the rows (bands, target, folds: an array of outer and inner) of each pair. A task reads a row once and adds it to all its sums."""
    x0, y0 = at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x, y = np.stack(pdf["bands"]) - x0, pdf["target"].to_numpy(float) - y0
            where: dict[tuple, list[int]] = {}
            for i, folds in enumerate(pdf["folds"]):
                for f in folds:
                    where.setdefault((f["outer"], f["inner"]), []).append(i)
            for key, at in where.items():
                sums[key] = sums.get(key, 0) + _sums(x[at], y[at])
        yield pd.DataFrame([(*k, m) for k, m in sums.items()], columns=["outer", "inner", "m"])

    return _summed(rows.select("bands", "target", "folds").mapInPandas(run, f"outer int, inner int, {FIELDS}"), ["outer", "inner"])


def moments(spectra: DataFrame, key: str) -> DataFrame:
    """key, m: the Gram matrix of (1, bands, target) less the means over all rows, of the rows of each value of key (an integer)."""
    at = center(spectra)
    own = F.array(F.struct(F.col(key).cast("int").alias("outer"), F.lit(-1).alias("inner")))
    return _gathered(spectra.withColumn("folds", own), at).select(F.col("outer").alias(key), "m")


def fold_moments(spectra: DataFrame, inner: int, split: Callable = contiguous_folds) -> DataFrame:
    """outer, inner, m: centred Gram matrices of the training rows of each outer fold by inner fold; inner -1 holds the fold's own rows.

    spectra: idx (unique), fold, bands, target. split: (rows, inner, order, within) -> rows with `inner`.
    """
    spectra = staged(spectra.select("idx", "fold", "bands", "target"), "spectra")
    at = center(spectra)
    n = spectra.agg(F.count_distinct("fold")).first()[0]
    if n * (inner + 1) * (len(at[0]) + 2) ** 2 * 8 > MOST_BYTES:
        raise ValueError("too many bands and folds to send their moments to every task")
    folds = spectra.select(F.col("fold").alias("outer")).distinct()
    others = folds.agg(F.collect_list("outer")).scalar()
    train = spectra.select("idx", "fold", others.alias("_folds")).select("idx", "fold", F.explode(F.filter("_folds", lambda f: f != F.col("fold"))).alias("outer"))
    train = split(train, inner, "idx", "outer")
    pair = lambda outer, of: F.struct(outer.cast("int").alias("outer"), of.cast("int").alias("inner"))
    inners = train.groupBy("idx").agg(F.collect_list(pair(F.col("outer"), F.col("inner"))).alias("inners"))
    wide = spectra.join(inners, "idx", "left")
    own = F.array(pair(F.col("fold"), F.lit(-1)))
    return _gathered(wide.withColumn("folds", F.when(F.col("inners").isNull(), own).otherwise(F.concat(own, "inners"))), at)


def pls_fit(m: np.ndarray, n_comp: int) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) for 1 to n_comp components, from a Gram matrix; x and y are scaled by their deviations."""
    n, d = m[0, 0], len(m) - 2
    mean = m[0, 1:] / n
    cov = m[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0) / (n - 1))
    scale[scale == 0] = 1.0
    cov = cov / np.outer(scale, scale)
    xx, xy = cov[:d, :d], cov[:d, d].copy()
    ws, ps, qs, rs, out = [], [], [], [], []
    for _ in range(n_comp):
        norm = np.linalg.norm(xy)
        if norm > 1e-10:
            w = xy / norm
            r = w.copy()
            for p, old in zip(ps, rs, strict=True):
                r -= (p @ w) * old
            t2 = r @ xx @ r
            if t2 > 1e-10:
                p, q = xx @ r / t2, (r @ xy) / t2
                xy = xy - p * q * t2
                ws.append(w), ps.append(p), qs.append(q), rs.append(r)
        b = (np.array(rs).T @ np.array(qs) if rs else np.zeros(d)) * scale[d] / scale[:d]
        out.append((b, float(mean[d] - mean[:d] @ b)))
    return out


def errors(m: np.ndarray, coef: np.ndarray, intercept: float) -> tuple[float, float]:
    """Mean squared error and r2 of a linear model on the rows behind a Gram matrix."""
    v = np.concatenate([[-intercept], -coef, [1.0]])
    sse, n = float(v @ m @ v), m[0, 0]
    sst = m[-1, -1] - m[0, -1] ** 2 / n
    return max(sse, 0.0) / n, 1 - max(sse, 0.0) / sst if sst > 0 else float("nan")


def filtered(m: np.ndarray, window: int, order: int, der: int) -> np.ndarray:
    """The Gram matrix after a Savitzky-Golay filter of the bands."""
    d, half = len(m) - 2, window // 2
    c = np.zeros((len(m), d - 2 * half + 2))
    c[0, 0] = c[-1, -1] = 1
    w, first = savgol_weights(window, order, der), half - (window // 2 if window % 2 else window // 2 - 1)
    for k in range(d - 2 * half):
        c[1 + k + first : 1 + k + first + window, 1 + k] = w
    return c.T @ m @ c


def grid(ders: range = range(3), orders: range = range(2, 11), windows: range = range(2, 16)) -> list[tuple[int, int, int]]:
    """The valid (der, order, window) combinations."""
    return [(d, o, w) for d in ders for o in orders for w in windows if o < w and d <= o]


def _square(flat) -> np.ndarray:
    a = np.asarray(flat, float)
    return a.reshape(int(round(len(a) ** 0.5)), -1)


def _scores(folds: dict[int, dict[int, np.ndarray]], most: int, config: tuple[int, int, int] | None, fit: Callable = pls_fit, score: Callable = errors) -> list[tuple]:
    """(kind, fold, components, mse, r2) of single and nested cross-validation over moments by outer and inner fold."""
    if config:
        der, order, window = config
        folds = {o: {i: filtered(m, window, order, der) for i, m in by.items()} for o, by in folds.items()}
    # by[o]: the training rows of outer fold o, by inner fold; key -1 holds the fold's own rows
    out = []
    for o, by in folds.items():
        own, train = by[-1], sum(m for i, m in by.items() if i >= 0)
        models = fit(train, most)
        out += [("single", o, k + 1, *score(own, *b)) for k, b in enumerate(models)]
        inner = np.zeros(most)
        for i, m in by.items():
            if i >= 0:
                inner += [score(m, *b)[0] for b in fit(train - m, most)]
        best = int(np.argmin(np.round(inner, 12)))
        out.append(("nested", o, best + 1, *score(own, *models[best])))
    return out


def cross_validate(spectra: DataFrame, *, most: int = 15, inner: int = 10, configs: list[tuple[int, int, int] | None] = (None,), fit: Callable = pls_fit, score: Callable = errors, split: Callable = contiguous_folds) -> DataFrame:
    """kind (single, nested), der, ord, wl (null without filter), fold, components, mse, rmse, r2. spectra: idx, fold, bands, target.

    The folds' moments, whose size depends on bands and folds only, go to the tasks once; a configuration is scored in one task.
    fit: (Gram matrix, components) -> [(coefficients, intercept)], score: (Gram matrix, coefficients, intercept) -> (mse, r2).
    """
    by: dict[int, dict[int, np.ndarray]] = {}
    for r in fold_moments(spectra, inner, split).toPandas().itertuples():
        by.setdefault(r.outer, {})[r.inner] = _square(r.m)
    rows = [(i, *(c or (None, None, None))) for i, c in enumerate(configs)]
    spark = spectra.sparkSession

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf.itertuples():
                config = None if pd.isna(c.wl) else (int(c.der), int(c.ord), int(c.wl))
                out = pd.DataFrame(_scores(by, most, config, fit, score), columns=["kind", "fold", "components", "mse", "r2"])
                out["rmse"] = np.sqrt(out["mse"])
                for name, value in zip(("der", "ord", "wl"), config or (None,) * 3, strict=True):
                    out[name] = pd.array([value] * len(out), dtype="Int32")
                yield out[["kind", "der", "ord", "wl", "fold", "components", "mse", "rmse", "r2"]]

    plan = spark.createDataFrame(rows, "config int, der int, ord int, wl int").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "config")
    return plan.mapInPandas(scored, "kind string, der int, ord int, wl int, fold int, components int, mse double, rmse double, r2 double")


def preprocessing_grid(spectra: DataFrame, n: int, *, configs: list[tuple[int, int, int]] | None = None, **options) -> DataFrame:
    """cross_validate's fold rows of SNV and MSC spectra (prep snv, msc) and of SNV spectra under each filter (prep sg)."""
    spectra = staged(spectra, "folds")
    filters = cross_validate(snv(spectra), configs=[None, *(grid() if configs is None else configs)], **options)
    return filters.withColumn("prep", F.when(F.col("wl").isNull(), "snv").otherwise("sg")).unionByName(cross_validate(msc(spectra, n), **options).withColumn("prep", F.lit("msc")))


def cv_summary(folds: DataFrame, *by: str) -> DataFrame:
    """Means and population deviations over folds; nested runs choose components per fold, so they have one row."""
    key = F.when(F.col("kind") == "single", F.col("components")).alias("components")
    stats = [f(c).alias(f"{c}_{n}") for c in ("mse", "rmse", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return folds.groupBy("kind", *by, "der", "ord", "wl", key).agg(*stats)


def best_components(cv: DataFrame) -> DataFrame:
    """Per configuration the component count with the least mean error, ties to the smallest. cv: der, ord, wl, components, mse."""
    return cv.groupBy("der", "ord", "wl").agg(F.min_by("components", F.struct("mse", "components")).alias("components"))


def best_preprocessing(table: DataFrame) -> DataFrame:
    """The configuration with the least error that isn't 0. table: der, ord, wl, mse."""
    return table.where("mse <> 0").orderBy("mse", "der", "ord", "wl").limit(1)


def pls_predict(spectra: DataFrame, coef: list[float], intercept: float) -> DataFrame:
    c = F.array(*map(F.lit, coef))
    return spectra.withColumn("pred", F.aggregate(F.zip_with("bands", c, lambda a, b: a * b), F.lit(float(intercept)), lambda s, v: s + v))


def fold_metrics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """mse, rmse, r2 per key. pred: keys, target, pred."""
    e = (F.col("target") - F.col("pred")) * (F.col("target") - F.col("pred"))
    out = pred.groupBy(*keys).agg(F.avg(e).alias("mse"), F.var_pop("target").alias("_v"))
    return out.select(*keys, "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "_v")).alias("r2"))


def pred_vs_true_line(pred: DataFrame) -> DataFrame:
    return pred.agg(F.regr_slope("pred", "target").alias("slope"), F.regr_intercept("pred", "target").alias("intercept"))


def cv_report(folds: DataFrame) -> DataFrame:
    """Per-fold rows and one row of means and deviations. folds: fold, mse, rmse, r2."""
    stats = folds.agg(*[f(c).alias(f"{c}{n}") for c in ("mse", "rmse", "r2") for n, f in (("", F.avg), ("_std", F.stddev_pop))])
    return folds.unionByName(stats, allowMissingColumns=True)


def select_best(folds: DataFrame) -> DataFrame:
    """The nested runs' best filter: the least mean error that isn't 0."""
    s = cv_summary(folds).where("kind = 'nested' and wl is not null and mse_mean <> 0").withColumnRenamed("mse_mean", "mse")
    return s.orderBy("mse", "der", "ord", "wl").limit(1)
