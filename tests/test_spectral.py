"""Spectral operators: hand-made cases, properties, and the registered SQL over the smallest tables."""

import glob
import hashlib
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from speclake.functions import bands as B
from pyspark.sql import functions as F
from speclake.operators import alignment as A
from speclake.operators import instances as I
from speclake.operators import radiometry as R
from speclake.operators import regression as P
from speclake.operators import stats as S
from speclake.plans import queries as Q
from speclake.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables_sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, tables_sql, name):
    """The whole results: same columns, same rows, numbers to five digits after the point or nine significant ones."""
    got, want = Q.QUERIES[name](spark, SF).toPandas(), tables_sql.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) and (len(got) or name == "panel_lookup")  # no such wavelength in the smallest table
    number = lambda x: isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_))
    one = lambda x: (0, 0.0) if pd.isna(x) else (1, float(x)) if number(x) else (2, str(x).lower())
    cols = sorted(got.columns)
    rows = lambda df: sorted([one(x) for x in r] for r in df[cols].astype(object).itertuples(index=False, name=None))
    for a, b in zip(rows(got), rows(want), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x[0] == y[0] and (x == y if x[0] == 2 else np.isclose(x[1], y[1], rtol=1e-9, atol=1.01e-5)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_preprocessing(spark):
    rows = [(str(i), [float(x) for x in np.random.default_rng(i).normal(5, 2, 12)]) for i in range(6)] + [("flat", [3.0] * 12)]
    df = spark.createDataFrame(rows, "id string, bands array<double>")
    got = {r["id"]: r["bands"] for r in B.snv(df).collect()}
    x = np.array(rows[0][1])
    assert np.allclose(got["0"], (x - x.mean()) / x.std()) and got["flat"] == [None] * 12
    ref = list(map(float, range(12)))
    line = spark.createDataFrame([("a", [3 + 2 * v for v in ref])], "id string, bands array<double>")
    assert np.allclose(B.msc(line, 12, ref).first()["bands"], ref)
    for window in (5, 6):
        poly = spark.createDataFrame([("a", [v**3 - v for v in ref])], "id string, bands array<double>")
        at = np.arange(12 - 2 * (window // 2)) + window // 2 + (0.5 if window % 2 == 0 else 0)
        assert np.allclose(B.savgol(poly, window, 3, 1, 12).first()["bands"], 3 * at**2 - 1)


def test_corrections(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    df = spark.createDataFrame(list(enumerate(p)), "test int, p double")
    count = lambda f: f(df, 0.05).where("rejected").count()
    assert [count(f) for f in (S.correct_none, S.correct_bonferroni, S.correct_bh, S.correct_by)] == [5, 1, 2, 1]


def test_numbering(spark):
    """Positions and folds against loops over sorted rows, over many ranges; nulls, ties, one class with most rows, no rows."""
    r = np.random.default_rng(5)
    idx = r.permutation(9000)
    rows = [(int(i), None if i % 11 == 0 else "big" if i % 3 else f"c{i % 5}", None if i == 7 else float(i * 37 % 9001)) for i in idx]
    df = spark.createDataFrame(rows, "idx long, grp string, value double")
    by = sorted(rows, key=lambda x: (x[2] is not None, x[2]))
    assert {x["idx"]: x["n"] for x in S.numbered(df, "n", "value").collect()} == {x[0]: k + 1 for k, x in enumerate(by)}
    own = {}
    for x in by:
        own.setdefault(x[1], []).append(x[0])
    got = S.numbered(df, "n", "value", within="grp").collect()
    assert {(x["idx"], x["n"], x["_total"]) for x in got} == {(i, k + 1, len(ids)) for ids in own.values() for k, i in enumerate(ids)}
    ties = S.numbered(df.withColumn("value", F.lit(1)), "n", "value")
    assert sorted(x["n"] for x in ties.collect()) == list(range(1, 9001))
    assert all(f(df.limit(0)).count() == 0 for f in (lambda d: S.numbered(d, "n", "idx"), lambda d: S.stratified_folds(d, 3), lambda d: S.contiguous_folds(d, 3)))

    classes = {}
    for x in sorted(rows):
        classes.setdefault(x[1], []).append(x[0])
    want, start = {}, 0
    for ids in sorted(classes.values()):  # in the order of their first rows
        want |= zip(ids, sorted(p % 7 for p in range(start, start + len(ids))), strict=True)
        start += len(ids)
    assert {x["idx"]: x["fold"] for x in S.stratified_folds(df, 7).collect()} == want
    for n, k in ((9000, 7), (5, 8)):
        part = df.where(F.col("idx") < n)
        for within in (None, "grp"):
            groups = {}
            for x in sorted(x for x in rows if x[0] < n):
                groups.setdefault(within and x[1], []).append(x[0])
            want = {i: f for ids in groups.values() for f, a in enumerate(np.array_split(ids, k)) for i in a}
            assert {x["idx"]: x["inner"] for x in S.contiguous_folds(part, k, within=within).collect()} == want


def test_permutations(spark):
    assert Q.ITERS == 10_000
    sign = lambda before, i, image: -1.0 if int(hashlib.md5(f"{before}{i // 128}-{image}".encode()).hexdigest(), 16) >> (127 - i % 128) & 1 else 1.0
    r = np.random.default_rng(4)
    v = {b: r.normal(0.02 * b, 0.05, 9 + b).round(6) for b in (1, 2)}
    diff = spark.createDataFrame([(i, b, float(x)) for b in v for i, x in enumerate(v[b])] + [(99, 1, None)], "image_id int, band int, diff double")
    for iters in (1500, 128, 3):  # several groups of blocks, the last one short; one whole block; a part of one
        want = {b: np.mean([round(np.median([x * sign(f"{b}-", k, i) for i, x in enumerate(v[b])]) ** 2, 12) > round(np.median(v[b]) ** 2, 12) for k in range(iters)]) for b in v}
        assert {x["test"]: x["p"] for x in S.permutation_test_per_band(diff, iters).collect()} == pytest.approx(want)
        t = [sum(np.mean([x * sign("", k, i) for i, x in enumerate(v[b])]) ** 2 for b in v) for k in range(iters)]
        assert S.permutation_test_global(diff, iters).first()["p"] == pytest.approx(np.mean(np.round(t, 12) > round(sum(np.mean(x) ** 2 for x in v.values()), 12)))


def test_pls():
    r = np.random.default_rng(0)
    x = r.normal(size=(80, 6))
    y = x @ r.normal(size=6) + r.normal(size=80) * 0.1
    m = P._sums(x, y).reshape(8, 8)
    b, b0 = P.pls_fit(m, 6)[-1]
    full = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)[0]
    assert np.allclose(np.append(b0, b), full)
    assert np.isclose(P.errors(m, b, b0)[0], np.mean((y - x @ b - b0) ** 2))
    assert len(P.grid()) == 243
    xs, ys, mean = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1), []
    for _ in range(3):  # plain NIPALS
        w = xs.T @ ys / np.linalg.norm(xs.T @ ys)
        t = xs @ w
        xs = xs - np.outer(t, xs.T @ t / (t @ t))
        mean.append(t * (t @ ys) / (t @ t))
        ys = ys - mean[-1]
    b, b0 = P.pls_fit(m, 3)[-1]
    assert np.allclose(x @ b + b0, sum(mean) * y.std(ddof=1) + y.mean())


def test_geometry(spark):
    v = np.random.default_rng(2).normal(100, 20, (8, 8))
    planes = spark.createDataFrame([(1, b, r, c, float(v[r, c]) if b else float(np.roll(v, (2, -1), (0, 1))[r, c])) for b in (0, 1) for r in range(8) for c in range(8)], "image_id long, band int, row int, col int, value double")
    lens = dict(fx=9.0, fy=9.0, cx=4.0, cy=4.0, k1=0.0, k2=0.0, p1=0.0, p2=0.0, k3=0.0)
    same = A.undistort(planes, {1: lens, 2: lens}, 1, 8, 8).toPandas().sort_values(["band", "row", "col"]).value
    assert np.allclose(same, planes.toPandas().sort_values(["band", "row", "col"]).value)
    search = lambda centered: A.coarse_shift_search(planes, 1, 8, 8, max_shift=4, samples=4, bins=4, centered=centered).first()
    assert [(x["d_row"], x["d_col"]) for x in (search(True), search(False))] == [(-2, 1)] * 2
    blob = lambda r0, c0: [(r, c, 1.0 + 50.0 * np.exp(-((r - r0) ** 2 + (c - c0) ** 2) / 9)) for r in range(20) for c in range(20)]
    far = spark.createDataFrame([(1, b, r, c, float(v)) for b, at in ((0, (5, 13)), (1, (13, 6))) for r, c, v in blob(*at)], planes.schema)
    best = A.coarse_shift_search(far, 1, 20, 20, max_shift=4, samples=4, bins=16).first()
    assert abs(best["d_row"] - 8) <= 1 and abs(best["d_col"] + 7) <= 1  # found only from the centers of mass
    flat = spark.createDataFrame([(1, r, 0, [float(r), 7.0, float(r)]) for r in range(6)], "image_id long, row int, col int, bands array<double>")
    assert {r["band"]: r["nmi"] for r in A.normalized_mi(flat, 2, 3, 3).collect()} == {0: pytest.approx(2.0), 1: None}


def test_dark_rows(spark):
    """Dark columns with gaps, pixels without a dark value, other columns, own exposure time."""
    dark = spark.createDataFrame([(0, c, [float(c), 1.0]) for c in (1, 3, 4)] + [(1, c, [1.0, 1.0]) for c in (0, 1)], "row int, col int, bands array<double>")
    pixels = spark.createDataFrame([(i, r, c, [10.0, 20.0 + c], "x") for i in (1, 2) for r in (0, 1, 2) for c in range(5)], "image_id int, row int, col int, bands array<double>, note string")
    want = {(i, r, c): ([10.0 - (c if r == 0 else 1), 19.0 + c], "x") for i in (1, 2) for r, of in ((0, (1, 3, 4)), (1, (0, 1))) for c in of}
    got = R.subtract_dark(pixels, dark)
    assert got.columns == pixels.columns and {tuple(x)[:3]: (x["bands"], x["note"]) for x in got.collect()} == want
    half = R.subtract_dark(pixels, dark, 2.0, 4.0).collect()
    assert {tuple(x)[:3]: x["bands"] for x in half} == {k: [v / 2 for v in b] for k, (b, _) in want.items()} and R.subtract_dark(pixels, dark, 2.0, 2.0).first()["bands"] == want[tuple(R.subtract_dark(pixels, dark, 2.0, 2.0).first())[:3]][0]


def test_tiles(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(f"i{i}", b, x, y, float(r.normal())) for i in range(3) for b in (2, 5) for x in range(9) for y in range(7)]
    planes = spark.createDataFrame(rows, "image_id string, band int, row int, col int, value double").repartition(3)
    out = A.tiles(planes).toPandas()
    got = sorted((t.image_id, t.band, int(x), int(y), float(v)) for t in out.itertuples() for x, y, v in zip(*A.unpacked(pd.DataFrame([t])), strict=True))
    assert got == sorted(rows) and len(out) <= 18 and A.tiles(planes.limit(0)).count() == 0


def test_moments(spark):
    """Partial sums over many tasks on two levels, against the rows; no rows of a fold, a fold of one row."""
    r = np.random.default_rng(1)
    x, y, f = 100 + r.normal(size=(90, 4)), 50 + r.normal(size=90), np.where(np.arange(90) == 3, 9, np.arange(90) % 3)
    df = spark.createDataFrame([(int(f[i]), x[i].tolist(), float(y[i])) for i in range(90)], "fold int, bands array<double>, target double").repartition(20)
    a = np.column_stack([np.ones(90), x - x.mean(0), y - y.mean()])
    got = {m["fold"]: np.array(m["m"]).reshape(6, 6) for m in P.moments(df, "fold").collect()}
    assert set(got) == set(f.tolist()) and all(np.allclose(got[k], a[f == k].T @ a[f == k]) for k in got)


def nipals(x, y, most):
    """(coefficients, intercept) for 1 to most components by plain NIPALS on scaled data."""
    sx, sy, mx, my = x.std(0, ddof=1), y.std(ddof=1), x.mean(0), y.mean()
    a, b, ws, ps, qs, out = (x - mx) / sx, (y - my) / sy, [], [], [], []
    for _ in range(most):
        w = a.T @ b / np.linalg.norm(a.T @ b)
        t = a @ w
        p, q = a.T @ t / (t @ t), b @ t / (t @ t)
        a, b = a - np.outer(t, p), b - q * t
        ws.append(w), ps.append(p), qs.append(q)
        c = np.array(ws).T @ np.linalg.solve(np.array(ps) @ np.array(ws).T, np.array(qs)) * sy / sx
        out.append((c, my - mx @ c))
    return out


def test_cross_validation(spark):
    """Single and nested cross-validation against loops over the rows, on raw reflectance (a large mean, a small variance)."""
    r = np.random.default_rng(11)
    n, d, most, inner = 60, 9, 4, 3
    x = 0.5 + r.normal(0, 1e-3, (n, d)).cumsum(1)
    y = 1000 + x @ r.normal(0, 300, d) + r.normal(0, 0.1, n)
    fold = np.arange(n) * 7 % 4
    df = spark.createDataFrame([(i, int(fold[i]), x[i].tolist(), float(y[i])) for i in range(n)], "idx long, fold int, bands array<double>, target double")
    got = P.cross_validate(df, most=most, inner=inner, configs=[None, (1, 2, 5)]).toPandas()

    def brute(x):
        out = {}
        for o in range(4):
            train, test = np.flatnonzero(fold != o), np.flatnonzero(fold == o)
            mse = lambda fit, at: [np.mean((y[at] - x[at] @ c - c0) ** 2) for c, c0 in fit]
            errors = mse(nipals(x[train], y[train], most), test)
            parts = np.array_split(train, inner)
            best = np.argmin(np.mean([mse(nipals(x[t := np.setdiff1d(train, p)], y[t], most), p) for p in parts], axis=0))
            out |= {("single", o, k + 1): e for k, e in enumerate(errors)} | {("nested", o, int(best) + 1): errors[best]}
        return out

    for rows, x2 in ((got[got.wl.isna()], x), (got[got.wl == 5], np.array([[row[k : k + 5] @ B.savgol_weights(5, 2, 1) for k in range(d - 4)] for row in x]))):
        want = brute(x2)
        assert {(a.kind, a.fold, a.components) for a in rows.itertuples()} == set(want)
        assert all(np.isclose(a.mse, want[a.kind, a.fold, a.components], rtol=1e-5) for a in rows.itertuples())
    mean = P.cross_validate(df, most=1, inner=2, fit=lambda m, k: [(np.zeros(d), m[0, -1] / m[0, 0])]).where("kind = 'single' and fold = 0").first()["mse"]
    assert np.isclose(mean, np.mean((y[fold == 0] - y[fold != 0].mean()) ** 2))
    grid = P.preprocessing_grid(df, d, most=2, inner=2, configs=[(0, 2, 5), (1, 2, 5)])
    assert {x["prep"] for x in grid.select("prep").distinct().collect()} == {"snv", "msc", "sg"} and P.select_best(grid.where("prep = 'sg'")).count() == 1
    snv = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    ref = (x - x.mean(1, keepdims=True)).mean(0)
    lines = [np.polyfit(ref, row - row.mean(), 1) for row in x]
    msc = np.array([(row - row.mean() - b) / m for row, (m, b) in zip(x, lines, strict=True)])
    rows = grid.toPandas()
    most, inner = 2, 2
    for prep, x2 in (("snv", snv), ("msc", msc)):
        want = brute(x2)
        mine = rows[rows.prep == prep]
        assert {(a.kind, a.fold, a.components) for a in mine.itertuples()} == set(want)
        assert all(np.isclose(a.mse, want[a.kind, a.fold, a.components], rtol=1e-4) for a in mine.itertuples())
    zero = grid.withColumn("mse", F.when(F.col("der") == 1, 0.0).otherwise(F.col("mse")))
    assert P.select_best(zero.where("prep = 'sg'")).first()["der"] == 0  # an error of 0 is no result


def test_keys_and_lines(spark):
    ids = spark.createDataFrame([("g1p3",), ("g1p20",), ("none",), (None,)], "id string")
    assert [r["side"] for r in I.row_side(ids).collect()] == ["first", "second", None, None]
    keys = spark.createDataFrame([("3", "1"), ("x", "1"), (None, "2")], "plant_no string, grape_no string")
    assert [r["code"] for r in I.instance_key(keys).collect()] == ["g1p3", None, None]
    pixels = spark.createDataFrame([(1, 0, 0, [0.5, 2.0, -1.0])], "image_id long, row int, col int, bands array<double>")
    coef = spark.createDataFrame([(0, 0.1, 1.0)], "band int, intercept double, slope double")
    assert R.apply_empirical_line(pixels, coef, 0.5).first()["bands"] == [0.3, 2.0, -1.0] and R.apply_empirical_line(pixels, coef, clip=True).first()["bands"] == [0.6, 1.0, 0.0]
    line = spark.createDataFrame([("a", [float(k**2) for k in range(12)])], "id string, bands array<double>")
    assert np.allclose(B.savgol(line, 5, 2, 1, 12, trim=False).first()["bands"], 2 * np.arange(12))


def test_files(spark, tmp_path):
    shapes = spark.createDataFrame([("i", 1, [[0.0, 0.0, 4.0, 0.0, 4.0, 2.0, 0.0, 2.0], [2.0, 1.0, 9.0, 1.0, 9.0, 3.0, 2.0, 3.0]], 6, 6)], "image_id string, ann_id int, segmentation array<array<double>>, width int, height int")
    runs = sorted(tuple(r)[2:] for r in tables.rasterize_polygons(shapes).collect())
    assert runs == [(0, 0, 4), (1, 0, 6), (2, 2, 6)]
    (tmp_path / "a.json").write_text('{"images": [{"id": 1, "file_name": "x/img1.png", "width": 6, "height": 6}], "annotations": [{"id": 7, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1], "score": 0.995, "iscrowd": 0, "segmentation": [[0, 0, 4, 0, 4, 2], [1, 1, 2, 2]], "attributes": {"tagged": true, "plant_no": "3", "grape_no": "1"}}]}')
    ann = tables.read_annotations(spark, str(tmp_path / "a.json"))
    row = ann.first()
    assert (row["image_id"], row["attributes"]["plant_no"]) == ("img1", "3")
    tables.write_annotations(ann, str(tmp_path / "coco"))
    assert tables.read_annotations(spark, str(tmp_path / "coco")).first()["segmentation"] == [[0, 0, 4, 0, 4, 2]]
