"""Exact quantiles against numpy, over several rounds; the bucketed pixel layout."""

import numpy as np
import pytest

from speclake.operators import instances as I
from speclake.operators import quantiles as Q
from speclake.plans import queries
from speclake.plans import views as V

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bins, most", [(16, 50), (128, 4096)])
def test_band_quantiles(spark, bins, most):
    """A large group, ties, values of very different size, infinite ones, nulls, a null key; small brackets force several rounds."""
    r, n, probs = np.random.default_rng(1), 3, [0.25, 0.5, 0.75]
    groups = {k: r.normal(0, 1, (m, n)) for k, m in (("big", 3000), ("small", 7), (None, 40), ("one", 1), ("ties", 2000))}
    for x in groups.values():
        x[:, 1] = np.round(x[:, 1])
    groups["ties"][:, 0] = np.where(np.arange(2000) % 2, 1.0, 2.0)
    groups["ties"][:, 2] = np.exp(r.normal(0, 9, 2000))
    groups["ties"][0, 2] = np.inf
    rows = [(k, [None if k == "small" and j == 2 and i % 2 else float(v) for j, v in enumerate(row)]) for k, x in groups.items() for i, row in enumerate(x)] + [("void", [None] * 3)]
    df = spark.createDataFrame(rows, "k string, bands array<double>").repartition(4)
    got = {x["k"]: x["q"] for x in Q.band_quantiles(df, ["k"], n, probs, bins, most).collect()}
    for k in groups:
        for j in range(n):
            v = np.array([w[1][j] for w in rows if w[0] == k and w[1][j] is not None])
            assert np.allclose(got[k][j], np.quantile(v, probs)), (k, j)
    assert got["void"] == [[None] * 3] * 3 and len(got) == 6
    assert Q.band_quantiles(df.limit(0), ["k"], n, probs).count() == 0


def test_layout(spark):
    """Mask joins over the layout move no pixels, and cleaning over it is that over joined tables."""
    pixels, masks = V.pixels(spark, SF), V.masks(spark, SF)
    layout = I.pixel_layout(pixels, buckets=3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = I.mask_join(layout, masks)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left, right = plan.split("embeddings.parquet")[0], plan.split("Bucketed: true")[1]
    assert "Exchange" not in plan.split("Bucketed: true")[0] and "SortMergeJoin" in left and "hashpartitioning(image_id" in right
    masked = I.mask_join(pixels, masks)
    rows = lambda df: sorted(map(str, df.select("image_id", "ann_id", "row", "col", "bands").collect()))
    assert rows(I.clean_instances(layout, masks, queries.N, 1.2)) == rows(I.remove_outlier_pixels(masked, I.iqr_bounds(masked, queries.N, 1.2)))
