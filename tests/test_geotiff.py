"""GeoTIFF files: round trips, windows that read their blocks only, other writers' layouts, damaged files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.operators import raster
from stratagrid.sources import geotiff


@pytest.fixture(scope="module")
def source(spark):
    geotiff.register(spark)
    return spark.read.format("geotiff")


def cells_of(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def made(spark, height, width, seed=0, share=0.8):
    rng = np.random.default_rng(seed)
    return {(r, c): float(np.float32(rng.normal(100, 30))) for r in range(height) for c in range(width) if rng.random() < share}


def frame(spark, cells):
    return spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row long, col long, value double").repartition(3)


@pytest.mark.parametrize("dtype, nodata, predictor", [("float32", -9999.0, 3), ("float64", None, 1), ("float32", None, 3), ("uint16", 0.0, 2), ("int32", -5.0, 2), ("uint8", 255.0, 1)])
def test_round_trip(spark, tmp_path, dtype, nodata, predictor):
    geotiff.register(spark)
    cells = made(spark, 70, 45)
    if dtype[0] != "f":
        cells = {k: float(np.clip(round(v), 1, 250)) for k, v in cells.items()}
    grid = geotiff.Grid(45, 70, 500_000.0, 4_000_070.0, 0.5, nodata, dtype, 32611)
    assert geotiff.write(frame(spark, cells), f"{tmp_path}/a.tif", grid, block=32, predictor=predictor) == {1: 6}
    assert cells_of(spark.read.format("geotiff").load(f"{tmp_path}/a.tif")) == cells
    h = geotiff.read_header(f"{tmp_path}/a.tif")
    image = h.images[0]
    assert (image.width, image.height, image.nodata, image.dtype.str[1:], h.origin_x, h.origin_y, h.xres, h.yres, h.epsg) == (45, 70, nodata, np.dtype(dtype).str[1:], 500_000.0, 4_000_070.0, 0.5, 0.5, 32611)


def test_window_reads_its_blocks_only(spark, source, tmp_path, monkeypatch):
    cells = made(spark, 100, 100, share=1.0)
    path = f"{tmp_path}/a.tif"
    geotiff.write(frame(spark, cells), path, geotiff.Grid(100, 100, 1000.0, 2000.0, 2.0, -1.0), block=16)
    window = {k: v for k, v in cells.items() if 20 <= k[0] <= 40 and 50 <= k[1] < 60}
    pushed = spark.read.format("geotiff").load(path).where("row >= 20 AND row <= 40 AND col >= 50 AND col < 60")
    assert cells_of(pushed) == window
    given = {"row_min": 20, "row_max": 40, "col_min": 50, "col_max": 59}
    assert cells_of(spark.read.format("geotiff").options(**given).load(path)) == window
    box = {"xmin": 1100.0, "xmax": 1120.0, "ymin": 2000.0 - 82, "ymax": 1960.0}
    assert cells_of(spark.read.format("geotiff").options(**box).load(path)) == window
    reader = geotiff.GeoTiffReader({"path": path, **{k: str(v) for k, v in given.items()}, "part": "2"})
    parts = reader.partitions()
    assert sorted(b for p in parts for b in p.blocks) == [r * 7 + 3 for r in (1, 2)] and len(parts) == 1
    # the same, by the bytes that are read
    image, read = geotiff.read_header(path).images[0], []
    real = geotiff._open

    class Watched:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            read.append((at, n))
            return self.f.read_at(n, at)

    monkeypatch.setattr(geotiff, "_open", lambda p: (type("Files", (), {"open_input_file": lambda self, at: Watched(real(p)[0].open_input_file(at)), "get_file_info": lambda self, at: real(p)[0].get_file_info(at)})(), real(p)[1]))
    list(reader.read(parts[0]))
    blocks = {int(o): int(n) for o, n in zip(image.offsets, image.sizes)}
    assert [x for x in read if x[0] in blocks] == [(int(image.offsets[b]), int(image.sizes[b])) for b in (10, 17)]
    assert spark.read.format("geotiff").options(row_min=500).load(path).count() == 0


def test_overviews_sparse_and_empty(spark, source, tmp_path):
    cells = {k: v for k, v in made(spark, 80, 80, share=1.0).items() if k[0] < 20 or k[1] > 70}
    whole = frame(spark, cells).withColumn("source", F.lit(1))
    levels = whole.select(F.lit(1).alias("level"), "row", "col", "value").unionByName(raster.overviews(whole, (2, 4)).select("level", "row", "col", "value"))
    path = f"{tmp_path}/o.tif"
    assert geotiff.write(levels, path, geotiff.Grid(80, 80, nodata=-9999.0, dtype="float64"), block=16) == {1: 13, 2: 5, 4: 3}
    h = geotiff.read_header(path)
    assert [x.level for x in h.images] == [1, 2, 4] and (h.images[0].sizes == 0).sum() == 12
    for level in (1, 2, 4):
        want = {(r["row"], r["col"]): r["value"] for r in levels.where(F.col("level") == level).collect()}
        assert cells_of(spark.read.format("geotiff").option("level", level).load(path)) == pytest.approx(want)
    with pytest.raises(Exception, match="no level 8"):
        spark.read.format("geotiff").option("level", 8).load(path).count()
    geotiff.write(whole.limit(0), f"{tmp_path}/none.tif", geotiff.Grid(5, 5, nodata=0.0, dtype="uint16"))
    assert spark.read.format("geotiff").load(f"{tmp_path}/none.tif").count() == 0


def test_many_files_and_extent(spark, source, tmp_path, monkeypatch):
    tiles = {k: made(spark, 20, 20, seed=k) for k in range(3)}
    for k, cells in tiles.items():
        geotiff.write(frame(spark, cells), f"{tmp_path}/m/{k}.tif", geotiff.Grid(20, 20, nodata=-1.0, dtype="float64"), block=16)
    painted = {}
    for cells in tiles.values():
        painted.update(cells)
    for headers in (64, 1):
        monkeypatch.setattr(geotiff, "HEADERS", headers)
        mosaic = raster.mosaic(spark.read.format("geotiff").load(f"{tmp_path}/m"), "file")
        assert cells_of(mosaic) == painted
    own, grid = geotiff.cropped(mosaic, geotiff.Grid(20, 20, 0.0, 0.0, 1.0, -1.0, "float64"), (5.0, -12.0, 25.0, -3.0))
    assert (grid.width, grid.height, grid.origin_x, grid.origin_y) == (20, 9, 5.0, -3.0)
    geotiff.write(own, f"{tmp_path}/crop.tif", grid, block=16)
    assert cells_of(spark.read.format("geotiff").load(f"{tmp_path}/crop.tif")) == {(r - 3, c - 5): v for (r, c), v in painted.items() if 3 <= r < 12 and c >= 5}
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no GeoTIFF files"):
        spark.read.format("geotiff").load(f"{tmp_path}/empty").count()


def classic(order, values, strip_rows, compression, predictor=1, samples=1, more=()):
    """A small file as other programs write it: strips, either byte order, offsets of 32 bits."""
    height, width = values.shape[:2]
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    strips = []
    for k in range(0, height, strip_rows):
        own = values[k:k + strip_rows]
        if predictor == 2:
            own = np.diff(own, axis=1, prepend=own.dtype.type(0))
        data = own.astype(own.dtype.newbyteorder(order)).tobytes()
        strips.append(zlib.compress(data) if compression == 8 else data)
    tags = {256: ("H", [width]), 257: ("H", [height]), 258: ("H", [values.dtype.itemsize * 8] * samples), 259: ("H", [compression]), 277: ("H", [samples]), 278: ("H", [strip_rows]), 317: ("H", [predictor]), 339: ("H", [kind] * samples), **dict(more)}
    codes = {"H": 3, "I": 4, "d": 12}
    tags[273], tags[279] = ("I", [0] * len(strips)), ("I", [len(x) for x in strips])
    base = 8 + 2 + 12 * len(tags) + 4
    extra = sum(len(v) * struct.calcsize(t) for t, v in tags.values() if len(v) * struct.calcsize(t) > 4)
    at, offsets = base + extra, []
    for x in strips:
        offsets.append(at)
        at += len(x)
    tags[273] = ("I", offsets)
    body, tail = struct.pack(order + "H", len(tags)), b""
    for tag in sorted(tags):
        t, v = tags[tag]
        data = struct.pack(f"{order}{len(v)}{t}", *v)
        own = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", base + len(tail))
        tail += data if len(data) > 4 else b""
        body += struct.pack(order + "HHI", tag, codes[t], len(v)) + own
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body + struct.pack(order + "I", 0) + tail + b"".join(strips)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("dtype, compression, predictor", [("f4", 1, 1), ("u2", 8, 2), ("i2", 8, 1), ("f8", 8, 1)])
def test_other_layouts(spark, source, tmp_path, order, dtype, compression, predictor):
    values = (np.arange(7 * 5).reshape(7, 5) * 3 % 17).astype(dtype)
    scale = {33550: ("d", [2.0, 2.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0])}
    (tmp_path / "c.tif").write_bytes(classic(order, values, 3, compression, predictor, more=scale))
    assert cells_of(spark.read.format("geotiff").load(f"{tmp_path}/c.tif")) == {(r, c): float(values[r, c]) for r in range(7) for c in range(5)}
    h = geotiff.read_header(f"{tmp_path}/c.tif")
    assert (h.origin_x, h.origin_y, h.xres) == (10.0, 50.0, 2.0)


def test_bands(spark, source, tmp_path):
    values = np.arange(4 * 3 * 2).reshape(4, 3, 2).astype("u2")
    (tmp_path / "b.tif").write_bytes(classic("<", values, 4, 8, 2, samples=2))
    assert cells_of(spark.read.format("geotiff").option("band", 2).load(f"{tmp_path}/b.tif")) == {(r, c): float(values[r, c, 1]) for r in range(4) for c in range(3)}
    with pytest.raises(Exception, match="2 bands"):
        spark.read.format("geotiff").option("band", 3).load(f"{tmp_path}/b.tif").count()


def test_damaged_and_unsupported_files(spark, tmp_path):
    good = classic("<", np.zeros((6, 6), "f4"), 2, 1)
    for bad, what in ((good[:-1], "truncated"), (good[:40], "ends before"), (b"II", "ends before"), (b"no picture at all", "not a TIFF"), (classic("<", np.zeros((6, 6), "f4"), 2, 5), "compression 5"), (classic("<", np.zeros((6, 6), "f4"), 2, 1, 2), "predictor 2"), (good[:8] + b"\xff\xff" + good[10:], "damaged")):
        (tmp_path / "bad.tif").write_bytes(bad)
        with pytest.raises(ValueError, match=what):
            geotiff.read_header(f"{tmp_path}/bad.tif")
    for grid, options in ((geotiff.Grid(5, 5, dtype="uint16"), {}), (geotiff.Grid(5, 5), {"block": 20}), (geotiff.Grid(0, 5), {}), (geotiff.Grid(5, 5), {"predictor": 2})):
        with pytest.raises(ValueError):
            geotiff.write(frame(spark, {(0, 0): 1.0}), f"{tmp_path}/x.tif", grid, **options)
