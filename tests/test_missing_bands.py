"""Images that lack bands, at the end or between others: queries against their SQL."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from speclake.plans import queries as Q

SF = "/root/testdata/sf0.001"
#: Vectors that are left out: image 1 lacks band 2, 2 the last four, 3 all but two, 4 the reference of normalized_mi, 5 the first.
GONE = {12, *range(26, 30), *range(32, 40), 45, 50}
NAMES = [
    "list_acquisitions", "normalized_mi", "read_envi", "write_envi", "calibrate_panel_check", "composite", "instance_mean_spectrum",
    "iqr_bounds", "join_lab_plant", "normalized_composite", "plant_mean_spectrum", "roi_mean", "subtract_dark",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("gaps"))
    for f in glob.glob(f"{SF}/*.parquet"):
        if os.path.basename(f) != "embeddings.parquet":
            os.symlink(f, f"{out}/{os.path.basename(f)}")
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    e[(e.vec_id < 120) & ~e.vec_id.isin(GONE)].to_parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="module")
def gaps_sql(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_gaps_against_sql(spark, folder, gaps_sql, name):
    got, want = Q.QUERIES[name](spark, folder).toPandas(), gaps_sql.execute(Q.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    number = lambda x: isinstance(x, (int, float, np.number))
    rows = lambda df: sorted([(0, 0.0) if pd.isna(x) else (1, float(x)) if number(x) else (2, str(x)) for x in r] for r in df[cols].astype(object).itertuples(index=False, name=None))
    for a, b in zip(rows(got), rows(want), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x[0] == y[0] and (x == y if x[0] == 2 else np.isclose(x[1], y[1], rtol=1e-9, atol=1.01e-5)), (a, b)


def test_small_cubes_share_tasks(spark, folder, tmp_path, monkeypatch):
    """Small cubes are read together, large ones in parts; each pixel once."""
    Q.E.write_envi(Q.V.pixels(spark, folder), str(tmp_path), 8, 8, Q.N)
    parts = Q.E.EnviReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 1 and len(parts[0].ranges) == 12
    rows = lambda df: sorted((r.image_id, r.row, r.col, *np.nan_to_num(np.array(r.bands, float), nan=-1)) for r in df.itertuples())
    want = rows(Q.E.read_envi(spark, str(tmp_path)).toPandas())
    assert len(want) == 12 * 64
    for piece, n in ((3 * 2560, 4), (1000, 36)):
        monkeypatch.setattr(Q.E, "PIECE", piece)
        reader = Q.E.EnviReader({"path": str(tmp_path)})
        assert len(parts := reader.partitions()) == n
        assert rows(pd.concat(b.to_pandas() for p in parts for b in reader.read(p))) == want
