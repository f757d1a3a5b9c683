"""A merge of rasters that is not made until it is read: a list of sources in order of priority, and which of their blocks are full.

The first source with data in a cell has it. All sources are on one grid, so nothing is resampled. A read of a window opens only
blocks in it, and of these only such as no full block of an earlier source hides. The view keeps paths relative to itself, so a
folder that is moved as a whole stays readable; its file is read-only, and is replaced as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from ..plans import outputs
from . import geotiff


def create(spark: SparkSession, sources: Sequence[str], path: str) -> dict:
    """Writes the view of ``sources`` (files, the first has priority) to ``path`` (a file of a file system). Sources that are not on one
    grid, or whose blocks differ in size, are an error. Which blocks are full is found by tasks, once."""
    if not sources:
        raise ValueError("a merge has sources")
    headers = [geotiff.read_header(s) for s in sources]
    grids = {(h.origin_x, h.origin_y, h.xres, h.yres, h.images[0].width, h.images[0].height, h.epsg) for h in headers}
    if len(grids) > 1:
        raise ValueError(f"the sources are not on one grid: {sorted(map(str, grids))}")
    if len({(h.images[0].block_width, h.images[0].block_height) for h in headers}) > 1:
        raise ValueError("the sources have blocks of different sizes")
    image = headers[0].images[0]
    found = outputs.ledger(spark, list(sources)).where("level = 1")
    rows = F.least(F.lit(image.block_height), F.lit(image.height) - F.floor(F.col("block") / image.across) * image.block_height)
    columns = F.least(F.lit(image.block_width), F.lit(image.width) - F.col("block") % image.across * image.block_width)
    # a number for each full block, as the index of a file has one for each block
    full: dict[str, list[int]] = {s: [] for s in sources}
    for r in found.where(F.col("cells") == rows * columns).select("file", "block").toLocalIterator():
        full[r["file"]].append(r["block"])
    folder = os.path.dirname(os.path.abspath(path))
    about = {"sources": [{"path": p, "full": sorted(full[s])} for s, p in zip(sources, outputs.relative([os.path.abspath(s) for s in sources], folder), strict=True)]}
    os.makedirs(folder, exist_ok=True)
    new = f"{path}.new"
    with open(new, "w") as f:
        json.dump(about, f)
    os.chmod(new, 0o444)
    os.replace(new, path)
    return about


def plan(path: str, row_min: int = 0, row_max: int = 2**62, col_min: int = 0, col_max: int = 2**62) -> list[tuple[int, str, int]]:
    """(rank, file, block) of the blocks that a read of the window opens."""
    with open(path) as f:
        about = json.load(f)
    folder, out, hidden = os.path.dirname(os.path.abspath(path)), [], set()
    for rank, source in enumerate(about["sources"]):
        file = os.path.normpath(os.path.join(folder, source["path"]))
        reader = geotiff.GeoTiffReader({"path": file, "row_min": row_min, "row_max": row_max, "col_min": col_min, "col_max": col_max})
        _, blocks = reader.chosen(file)
        out += [(rank, file, b) for b in blocks if b not in hidden]
        hidden |= set(source["full"])
    return out


def read(spark: SparkSession, path: str, **window: int) -> DataFrame:
    """(row, col, value, from): the merged cells of a window (row_min, row_max, col_min, col_max, with its ends); ``from`` is the source's rank."""
    blocks = plan(path, **window)
    low_row, high_row, low_col, high_col = (window.get(k, d) for k, d in (("row_min", 0), ("row_max", 2**62), ("col_min", 0), ("col_max", 2**62)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = geotiff.read_header(file).images[0]
                files, at = geotiff._open(file)
                with files.open_input_file(at) as f:
                    cells = geotiff.decode(f.read_at(int(image.sizes[block]), int(image.offsets[block])), image, block)[:, :, 0]
                row, col, _, _ = image.box(block)
                r, c = np.nonzero(geotiff.valid(cells, image))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), rank, np.int32)), pa.array(r + row), pa.array(c + col), pa.array(cells[r, c].astype(np.float64))], names=["rank", "row", "col", "value"])

    jobs = spark.createDataFrame(blocks, "rank int, file string, block int").repartition(max(1, -(-len(blocks) // 8)))
    cells = jobs.mapInArrow(run, "rank int, row long, col long, value double").where(F.col("row").between(low_row, high_row) & F.col("col").between(low_col, high_col))
    return raster.mosaic(cells, "rank", last_wins=False)
