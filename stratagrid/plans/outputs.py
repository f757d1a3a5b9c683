"""Raster outputs block by block: a ledger of what was written, what of it still stands, and what can be recovered."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from ..sources import geotiff

LEDGER = "file string, level int, block int, place long, size long, crc long, cells long"


def _blocks(spark: SparkSession, paths: Sequence[str], part: int = geotiff.PART) -> DataFrame:
    """(file, level, first, last): ranges of blocks of the files that can be opened, found by tasks; level is null for others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("file").to_pylist():
                try:
                    header = geotiff.read_header(path)
                except (ValueError, OSError):
                    rows.append((path, None, 0, 0))
                    continue
                rows += [(path, x.level, k, min(k + part, len(x.offsets))) for x in header.images for k in range(0, len(x.offsets), part)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["file", "level", "first", "last"])

    given = spark.createDataFrame([(p,) for p in paths], "file string")
    return given.repartition(max(1, min(len(paths), 1_000))).mapInArrow(run, "file string, level int, first int, last int")


def ledger(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(LEDGER) of files: place, size and checksum of each block, and how many cells have data. Commit it with the outputs. A file that
    can't be opened, or has a block that can't be decoded, is an error."""
    return _looked_at(_blocks(spark, paths), True)


def _looked_at(blocks: DataFrame, strict: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, level, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                if level is None:
                    if strict:
                        raise ValueError(f"{path} is not a whole raster")
                    continue
                image = next(x for x in geotiff.read_header(path).images if x.level == level)
                files, at = geotiff._open(path)
                with files.open_input_file(at) as f:
                    for k in range(first, last):
                        data, cells = f.read_at(int(image.sizes[k]), int(image.offsets[k])), 0
                        try:
                            cells = int(geotiff.valid(geotiff.decode(data, image, k), image).sum()) if len(data) else 0
                        except (ValueError, zlib.error) as e:
                            if strict:
                                raise ValueError(f"{path} is not a whole raster: block {k} can't be decoded") from e
                            cells = -1
                        rows.append((path, level, k, int(image.offsets[k]), int(image.sizes[k]), zlib.crc32(data), cells))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in LEDGER.split(", ")])

    # ranges of one file are dealt to many tasks
    return blocks.repartition("file", "first").mapInArrow(run, LEDGER)


def broken(spark: SparkSession, recorded: DataFrame) -> DataFrame:
    """(file, level, block) of the ledger's blocks that do not stand any more: the file is gone or cut, or the bytes are others."""
    paths = [r[0] for r in recorded.select("file").distinct().toLocalIterator()]
    now = _looked_at(_blocks(spark, paths), False).where("cells >= 0").select("file", "level", "block", "size", "crc")
    return recorded.join(now, ["file", "level", "block", "size", "crc"], "left_anti").select("file", "level", "block")


def to_redo(jobs: DataFrame, outputs: DataFrame, recorded: DataFrame, spark: SparkSession, key: str = "job") -> DataFrame:
    """``jobs`` of which some output (``outputs``: key, file) was never recorded or does not stand; each is redone whole."""
    bad = broken(spark, recorded).select("file").distinct()
    unknown = outputs.join(recorded.select("file").distinct(), "file", "left_anti").unionByName(outputs.join(bad, "file", "left_semi"))
    without = jobs.join(outputs.select(key).distinct(), key, "left_anti")
    return jobs.join(unknown.select(key).distinct(), key, "left_semi").unionByName(without)


def recover(spark: SparkSession, path: str, out: str, like: str | None = None, res: float | None = None, heights: bool = True, check: Callable[[], None] | None = None) -> dict[int, int]:
    """Writes what still stands of an interrupted mosaic to ``out``, on the grid of ``like``, or else with ``res`` on whole multiples of it.

    All arguments are looked at before anything is read or written: ``out`` must not be there, ``like`` must have square cells, and
    ``check`` may raise. Heights are 32-bit floats, intensities whole numbers with 0 for no data. Cells are interpolated between
    four; blocks that are cut or damaged have no cells.
    """
    if like is None and res is None:
        raise ValueError("give the grid of another raster, or a resolution")
    files, at = geotiff._open(out)
    if files.get_file_info(at).type.name != "NotFound":
        raise ValueError(f"{out} is there already")
    source = geotiff.read_header(path, whole=False)
    if abs(source.xres - source.yres) > 1e-9:
        raise ValueError(f"{path} has cells that are not square")
    image = source.images[0]
    if like is not None:
        h = geotiff.read_header(like)
        if abs(h.xres - h.yres) > 1e-9:
            raise ValueError(f"{like} has cells that are not square")
        grid = geotiff.Grid(h.images[0].width, h.images[0].height, h.origin_x, h.origin_y, h.xres)
    else:
        assert res is not None
        west, north = np.floor(source.origin_x / res) * res, np.ceil(source.origin_y / res) * res
        east, south = np.ceil((source.origin_x + image.width * source.xres) / res) * res, np.floor((source.origin_y - image.height * source.yres) / res) * res
        grid = geotiff.Grid(round((east - west) / res), round((north - south) / res), float(west), float(north), res)
    grid.dtype, grid.nodata, grid.epsg = ("float32", -9999.0, source.epsg) if heights else ("uint16", 0.0, source.epsg)
    if check is not None:
        check()
    cells = spark.read.format("geotiff").option("damaged", "skip").load(path).select("row", "col", "value")
    # only targets near cells that are there
    x, y = F.lit(source.origin_x) + (F.col("col") + 0.5) * source.xres, F.lit(source.origin_y) - (F.col("row") + 0.5) * source.xres
    reach = source.xres / grid.res
    span = lambda c: F.explode(F.sequence(F.floor(c - reach - 1).cast("bigint"), F.ceil(c + reach).cast("bigint")))
    near = cells.select(((F.lit(grid.origin_y) - y) / grid.res).alias("r"), ((x - grid.origin_x) / grid.res).alias("c")).withColumn("row", span(F.col("r"))).withColumn("col", span(F.col("c")))
    targets = near.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)).select("row", "col").distinct()
    place_r = (F.lit(source.origin_y) - (F.lit(grid.origin_y) - (F.col("row") + 0.5) * grid.res)) / source.xres - 0.5
    place_c = (F.lit(grid.origin_x) + (F.col("col") + 0.5) * grid.res - source.origin_x) / source.xres - 0.5
    return geotiff.write(raster.warp(cells, targets, place_r, place_c, by=()), out, grid)


def relative(paths: Sequence[str], folder: str) -> list[str]:
    return [os.path.relpath(p, folder) for p in paths]
