"""The ledger of blocks, recovery, and the merge view."""

import os
import random
import shutil
import stat

import pytest
from pyspark.sql import functions as F

from stratagrid.plans import outputs
from stratagrid.sources import geotiff, merge_view

GRID = dict(width=64, height=48, origin_x=1000.0, origin_y=2000.0, res=2.0, nodata=-1.0, dtype="float64", epsg=32611)


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    geotiff.register(spark)


def put(spark, path, cells, **more):
    geotiff.write(spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col long, value double"), str(path), geotiff.Grid(**{**GRID, **more}), block=16)


def made(seed, where):
    rng = random.Random(seed)
    return {(r, c): rng.uniform(1, 9) for r in range(48) for c in range(64) if where(r, c)}


def cells_of(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_ledger_finds_broken_blocks(spark, tmp_path):
    cells = made(1, lambda r, c: True)
    for name in "abc":
        put(spark, tmp_path / f"{name}.tif", cells)
    paths = [f"{tmp_path}/{name}.tif" for name in "abc"]
    recorded = outputs.ledger(spark, paths).cache()
    assert recorded.count() == 36 and recorded.agg(F.sum("cells")).first()[0] == 3 * 48 * 64
    assert outputs.broken(spark, recorded).count() == 0
    jobs = spark.createDataFrame([("one",), ("two",), ("three",), ("never",)], "job string")
    made_by = spark.createDataFrame([("one", paths[0]), ("two", paths[1]), ("three", paths[2]), ("three", f"{tmp_path}/d.tif")], "job string, file string")
    assert {r[0] for r in outputs.to_redo(jobs, made_by, recorded, spark).collect()} == {"three", "never"}
    # a changed byte in one block, and a file that ends early
    image = geotiff.read_header(paths[0]).images[0]
    raw = bytearray((tmp_path / "a.tif").read_bytes())
    raw[int(image.offsets[5]) + 20] ^= 255
    (tmp_path / "a.tif").write_bytes(raw)
    (tmp_path / "b.tif").write_bytes((tmp_path / "b.tif").read_bytes()[:-30])
    found = {(os.path.basename(r["file"]), r["block"]) for r in outputs.broken(spark, recorded).collect()}
    assert found == {("a.tif", 5), *(("b.tif", k) for k in range(12))}
    assert {r[0] for r in outputs.to_redo(jobs, made_by, recorded, spark).collect()} == {"one", "two", "three", "never"}
    with pytest.raises(Exception, match="not a whole raster"):
        outputs.ledger(spark, paths).collect()


def test_recovery(spark, tmp_path):
    cells = made(2, lambda r, c: True)
    put(spark, tmp_path / "mosaic-temp.tif", cells)
    put(spark, tmp_path / "like.tif", {(0, 0): 1.0}, width=70, height=50, origin_x=998.0, origin_y=2004.0)
    image = geotiff.read_header(f"{tmp_path}/mosaic-temp.tif").images[0]
    cut = max(range(12), key=lambda k: image.offsets[k])
    (tmp_path / "mosaic-temp.tif").write_bytes((tmp_path / "mosaic-temp.tif").read_bytes()[:-10])
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("geotiff").load(f"{tmp_path}/mosaic-temp.tif").count()
    outputs.recover(spark, f"{tmp_path}/mosaic-temp.tif", f"{tmp_path}/out.tif", like=f"{tmp_path}/like.tif")
    r0, c0, rows, columns = image.box(cut)
    # the grids differ by whole cells, so that values stay
    want = {(r + 2, c + 1): v for (r, c), v in cells.items() if not (r0 <= r < r0 + rows and c0 <= c < c0 + columns)}
    got = cells_of(spark.read.format("geotiff").load(f"{tmp_path}/out.tif"))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    with pytest.raises(ValueError, match="there already"):
        outputs.recover(spark, f"{tmp_path}/mosaic-temp.tif", f"{tmp_path}/out.tif", res=2.0)
    with pytest.raises(ValueError, match="resolution"):
        outputs.recover(spark, f"{tmp_path}/none.tif", f"{tmp_path}/new.tif")

    def refuse():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        outputs.recover(spark, f"{tmp_path}/mosaic-temp.tif", f"{tmp_path}/new.tif", res=4.0, check=refuse)
    assert not (tmp_path / "new.tif").exists()
    outputs.recover(spark, f"{tmp_path}/mosaic-temp.tif", f"{tmp_path}/new.tif", res=4.0, heights=False)
    h = geotiff.read_header(f"{tmp_path}/new.tif")
    assert (h.xres, h.origin_x, h.images[0].width, h.images[0].dtype.str) == (4.0, 1000.0, 32, "<u2")


def test_merge_view(spark, tmp_path):
    first, then, last = made(3, lambda r, c: c < 40), made(4, lambda r, c: 16 <= c), made(5, lambda r, c: (r + c) % 2)
    (tmp_path / "batch").mkdir()
    for name, cells in (("first", first), ("then", then), ("last", last)):
        put(spark, tmp_path / "batch" / f"{name}.tif", cells)
    files = [f"{tmp_path}/batch/{n}.tif" for n in ("first", "then", "last")]
    merge_view.create(spark, files, f"{tmp_path}/batch/merge/view.json")
    want = {**last, **then, **first}
    assert cells_of(merge_view.read(spark, f"{tmp_path}/batch/merge/view.json")) == want
    # two of four columns of blocks are full in the first, the others in the second: the last has nothing to give
    opened = merge_view.plan(f"{tmp_path}/batch/merge/view.json")
    assert sorted((rank, block % 4) for rank, _, block in opened) == sorted([(0, k) for k in (0, 1, 2)] * 3 + [(1, k) for k in (2, 3)] * 3)
    window = {"row_min": 20, "row_max": 30, "col_min": 30, "col_max": 50}
    assert cells_of(merge_view.read(spark, f"{tmp_path}/batch/merge/view.json", **window)) == {k: v for k, v in want.items() if 20 <= k[0] <= 30 and 30 <= k[1] <= 50}
    assert len(merge_view.plan(f"{tmp_path}/batch/merge/view.json", **window)) == 4
    # moved as a whole, read-only, and made again
    text = (tmp_path / "batch/merge/view.json").read_text()
    assert str(tmp_path) not in text and not stat.S_IMODE((tmp_path / "batch/merge/view.json").stat().st_mode) & 0o222
    shutil.move(tmp_path / "batch", tmp_path / "moved")
    assert cells_of(merge_view.read(spark, f"{tmp_path}/moved/merge/view.json")) == want
    merge_view.create(spark, [f"{tmp_path}/moved/{n}.tif" for n in ("last", "first")], f"{tmp_path}/moved/merge/view.json")
    assert cells_of(merge_view.read(spark, f"{tmp_path}/moved/merge/view.json")) == {**first, **last}
    put(spark, tmp_path / "moved/shifted.tif", first, origin_x=1001.0)
    for given, what in (([], "has sources"), ([f"{tmp_path}/moved/first.tif", f"{tmp_path}/moved/shifted.tif"], "one grid")):
        with pytest.raises(ValueError, match=what):
            merge_view.create(spark, given, f"{tmp_path}/x.json")
