"""Cubes as a data source: layouts, range reads, mount tables, whole cubes or none."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from speclake.operators import alignment
from speclake.sources import envi, objects, tables

CUBE = np.arange(4 * 5 * 3, dtype=np.uint16).reshape(4, 5, 3)


@pytest.fixture(scope="module")
def cubes(tmp_path_factory):
    top = tmp_path_factory.mktemp("cubes") / "in put"
    for k, (kind, axes, order) in enumerate([("bsq", (2, 0, 1), "<"), ("bil", (0, 2, 1), ">"), ("bip", (0, 1, 2), "<")]):
        d = top / f"ref_{k}"
        d.mkdir(parents=True)
        (d / "c.dat").write_bytes(b"junk" + CUBE.transpose(axes).astype(f"{order}u2").tobytes())
        (d / "c.hdr").write_text(f"ENVI\nsamples = 5\nlines = 4\nbands = 3\nheader offset = 4\ndata type = 12\ninterleave = {kind}\nbyte order = {int(order == '>')}\n")
    (top / "without samples.hdr").write_text("ENVI\n")
    return str(top)


def same(pixels, bands=(0, 1, 2)):
    got = pixels.toPandas()
    return len(got) == 60 and not got.duplicated(["image_id", "row", "col"]).any() and all(list(CUBE[r.row, r.col][list(bands)]) == list(r.bands) for r in got.itertuples())


def test_reading(spark, cubes, monkeypatch):
    for block in (1, 3, 64):
        assert same(envi.read_envi(spark, cubes, block))
    assert same(envi.read_envi(spark, cubes, bands=[2, 0]), (2, 0))
    envi.register(spark)
    for parts in (1, 3, 9):  # more parts than rows
        assert same(spark.read.format("envi").option("partsPerCube", parts).load(cubes))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.cubes.link./in", f"file://{os.path.dirname(cubes)}")
    assert same(envi.read_envi(spark, "viewfs://cubes/in/in put"))
    monkeypatch.setattr(envi, "OPENED", set())  # a store that only Spark opens
    assert same(envi.read_envi(spark, cubes, 3)) and same(envi.read_envi(spark, cubes, bands=[1]), (1,))


def test_bad_cubes(spark, tmp_path):
    d = tmp_path / "1"
    d.mkdir()
    (d / "c.dat").write_bytes(bytes(10))
    (d / "c.hdr").write_text("ENVI\nsamples = 5\n")
    with pytest.raises(Exception, match="no number of lines"):
        envi.read_envi(spark, str(tmp_path)).count()
    (d / "c.hdr").write_text("ENVI\nsamples = 5\nlines = 4\nbands = 3\ndata type = 4\n")
    with pytest.raises(Exception, match="fewer samples"):
        envi.read_envi(spark, str(tmp_path)).count()
    (d / "c.dat").unlink()
    assert envi.read_envi(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_writing(spark, cubes, tmp_path, interleave):
    """What is read comes back; missing pixels and rows are 0; nothing but whole cubes is left."""
    out = str(tmp_path / "o ut")
    pixels = envi.read_envi(spark, cubes).where("not (row = 1 and col > 2) and row < 3")
    for _ in range(2):  # again over the old ones
        envi.write_envi(pixels, out, 4, 5, 3, interleave)
    got = envi.read_envi(spark, out).toPandas()
    there = lambda r: r.row < 3 and not (r.row == 1 and r.col > 2)
    assert len(got) == 60 and all(list(r.bands) == (list(CUBE[r.row, r.col]) if there(r) else [0, 0, 0]) for r in got.itertuples())
    assert {d: sorted(f) for d, _, f in os.walk(out)} == {out: [], **{f"{out}/{i}": ["cube.dat", "cube.hdr"] for i in range(3)}}


def test_failed_write(spark, cubes, tmp_path):
    pixels = envi.read_envi(spark, cubes)
    bad = pixels.withColumn("col", F.when((F.col("image_id") == "2") & (F.col("row") == 3), 99).otherwise(F.col("col")))
    with pytest.raises(Exception, match="99"):
        envi.write_envi(bad, str(tmp_path), 4, 5, 3)
    assert not os.listdir(tmp_path / "2")
    envi.write_envi(pixels, str(tmp_path), 4, 5, 3)
    envi.EnviWriter({"path": str(tmp_path), "rows": 4, "cols": 5, "bands": 3}).abort([envi.Written([f"{tmp_path}/1"]), None])
    assert [sorted(os.listdir(tmp_path / d)) for d in "012"] == [["cube.dat", "cube.hdr"], [], ["cube.dat", "cube.hdr"]]
    envi.register(spark)
    options = {"rows": 4, "cols": 5, "bands": 3}
    with pytest.raises(Exception, match="ordered by"):
        pixels.orderBy("row", "image_id").coalesce(1).write.format("envi").mode("append").options(**options).save(str(tmp_path / "new"))


def test_objects_in_chunks(spark, tmp_path):
    """Every object, whatever the chunk, of strings with braces, quotes, backslashes at any place; nothing from empty files."""
    r = np.random.default_rng(3)
    odd = ['{', '}', '"', '\\', '\\"', '[', ']', 'é', '🙂', ',', '\n', 'a']
    text = lambda: "".join(r.choice(odd, 6))
    items = [{"id": i, "name" + text(): text(), "inner": {"x": [text(), {"y": text()}]}} for i in range(25)]
    doc = {"info{": {"a": text()}, "images": items[:5], "annotations": items[5:]}
    (tmp_path / "a.json").write_text(json.dumps(doc, ensure_ascii=False))
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"one": [x], "s": "\\" * 300}) for x in items))
    (tmp_path / "c.json").write_text("")
    for chunk in (11, 64, 1 << 20):
        got = objects.json_objects(spark, str(tmp_path), chunk=chunk).orderBy("path", "seq").collect()
        by = {k: [json.loads(x["json"]) for x in got if x["path"].endswith(k)] for k in ("a.json", "b.json")}
        assert by == {"a.json": [doc["info{"], *items], "b.json": items} and len(got) == 51
    (tmp_path / "c.json").write_text('{"images": [{"id": 1}, {"id": 2')
    with pytest.raises(Exception, match="no end"):
        objects.json_objects(spark, str(tmp_path)).count()


def test_large_annotations(spark, tmp_path):
    """One file read by many tasks gives what a reader of whole documents gives."""
    ann = [{"id": i, "image_id": i % 7, "category_id": 1, "bbox": [i, 0, 1, 1], "score": 0.5, "iscrowd": 0, "segmentation": [[0, 0, 4, 0, 4, i]], "attributes": {"tagged": i % 2 == 0, "plant_no": "{", "grape_no": None}} for i in range(3000)]
    doc = {"images": [{"id": k, "file_name": f"x/img{k}.png", "width": 6, "height": 6} for k in range(7)], "annotations": ann, "categories": [{"id": 1, "name": "grape"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = lambda df: sorted(map(str, df.drop("seq").collect()))
    got = tables.read_annotations(spark, str(tmp_path / "a.json"), chunk=20_000)
    assert rows(got) == rows(tables.read_annotations(spark, str(tmp_path / "*.json"))) and got.count() == 3000
    assert [x["ann_id"] for x in got.orderBy("seq").collect()] == list(range(3000))
    cut = objects.json_objects(spark, str(tmp_path / "a.json"), chunk=20_000)
    assert cut.groupBy(F.expr("seq div 20000")).count().count() > 20


def test_lens_files(spark, tmp_path):
    rows = [(1, 1612.7, 1614.0, 497.6, 500.6, -0.28, 0.31, -0.0002, 0.0018, 0.0), (2, 1600.0, 1601.5, 490.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    lens = spark.createDataFrame(rows, "sensor int, " + ", ".join(f"{c} double" for c in alignment.LENS))
    alignment.save_lens(lens, str(tmp_path), "x")
    back = alignment.load_lens(spark, {k: (f"{tmp_path}/x_intrinsic_matrix_{k}", f"{tmp_path}/x_distortion_{k}") for k in (1, 2)})
    assert sorted(map(tuple, back.collect())) == rows
    np.savetxt(tmp_path / "m.txt", np.array([[1612.7, 0, 497.6], [0, 1614.0, 500.6], [0, 0, 1]]), delimiter=",")
    np.savetxt(tmp_path / "d.txt", np.array([rows[0][5:]]), delimiter=",")
    plain = alignment.load_lens(spark, {1: (str(tmp_path / "m.txt"), str(tmp_path / "d.txt"))})
    assert list(map(tuple, plain.collect())) == rows[:1]
    planes = spark.range(64).selectExpr("1L as image_id", "0 as band", "cast(id div 8 as int) as row", "cast(id % 8 as int) as col", "cast(id * id as double) as value")
    by = alignment.lens_by_sensor(lens)
    values = lambda x: sorted(map(tuple, alignment.undistort(planes, x, 1, 8, 8).collect()))
    assert values(lens) == values(by)
    with pytest.raises(ValueError):
        alignment.lens_by_sensor(lens.union(lens))
