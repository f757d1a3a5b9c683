"""Binary geoid grids (GTX) as tables, and the geoid's height at points.

A grid is a header (south, west, steps, rows, columns) and 32-bit values from the south-western corner on, row by row. Partitions
are ranges of rows.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import written

#: Rows of a grid that a task reads; shares of a cell that are rounding.
ROWS, ROUNDED = 512, 1e-7
# Bytes of the header, and the value that stands for none.
HEADER, NONE = 40, -88.8888
# End of fixed values.


@dataclass
class Grid:
    path: str
    south: float
    west: float
    dlat: float
    dlon: float
    rows: int
    columns: int


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def header(path: str) -> Grid:
    """A grid's header; an error where the file is not as long as it says."""
    files, at = _open(path)
    with files.open_input_file(at) as f:
        if f.size() < HEADER:
            raise ValueError(f"{path} is not a GTX grid")
        south, west, dlat, dlon, rows, columns = struct.unpack(">4d2i", f.read_at(HEADER, 0))
        if rows < 2 or columns < 2 or not (dlat > 0 and dlon > 0) or f.size() != HEADER + 4 * rows * columns:
            raise ValueError(f"{path} is not a GTX grid, or not whole")
    # longitudes may count from 0 to 360
    return Grid(path, south, west - 360 if west >= 180 else west, dlat, dlon, rows, columns)


def write(path: str, south: float, west: float, dlat: float, dlon: float, values: np.ndarray) -> None:
    """``values``: rows from the south on; NaN for none."""
    files, at = _open(path)
    with files.open_output_stream(at, compression=None) as f:
        f.write(struct.pack(">4d2i", south, west, dlat, dlon, *values.shape) + np.where(np.isnan(values), NONE, values).astype(">f4").tobytes())


def read(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, list[Grid]]:
    """(grid, row, col, value) of a set of grids, numbered in their order, and their headers. Places without a value have no row."""
    grids = [header(p) for p in paths]
    jobs = [(k, g.path, first, min(ROWS, g.rows - first), g.columns) for k, g in enumerate(grids) for first in range(0, g.rows, ROWS)]

    def run(batches):
        for batch in batches:
            for k, path, first, n, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, at = _open(path)
                with files.open_input_file(at) as f:
                    values = np.frombuffer(f.read_at(4 * n * columns, HEADER + 4 * first * columns), ">f4").astype(np.float64)
                good = np.flatnonzero(np.abs(values - NONE) > 1e-3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), k, np.int32)), pa.array(first + good // columns), pa.array(good % columns), pa.array(values[good])], names=["grid", "row", "col", "value"])

    told = spark.createDataFrame(jobs, "k int, path string, first int, n int, columns int").repartition(max(1, len(jobs)))
    return told.mapInArrow(run, "grid int, row long, col long, value double"), grids


def with_undulation(points: DataFrame, values: DataFrame, grids: Sequence[Grid], lon: str = "lon", lat: str = "lat", into: str = "undulation") -> DataFrame:
    """``points`` with the geoid's height at their place (degrees), between the four values around it; null outside all grids, or where one
    of the four is missing. Of a set of grids the first that holds the point counts.

    The four values are found by their numbers in the grid: one exchange of points, one of values.
    """
    if into in points.columns:
        raise ValueError(f"there is a column {into} already")
    cell = F.lit(None).cast("struct<grid:int,r:double,c:double>")
    for k, g in reversed(list(enumerate(grids))):
        r = (F.col(lat) - g.south) / g.dlat
        c = F.pmod(F.col(lon) - g.west, F.lit(360.0)) / g.dlon
        # a point on the rim is in, however its place is rounded; there the last cell counts
        inside = (r >= -ROUNDED) & (r <= g.rows - 1 + ROUNDED) & (c >= -ROUNDED) & (c <= g.columns - 1 + ROUNDED)
        held = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
        cell = F.when(inside, F.struct(F.lit(k).alias("grid"), held(r, g.rows - 1).alias("r"), held(c, g.columns - 1).alias("c"))).otherwise(cell)
    sizes = F.array(*[F.struct(F.lit(g.rows - 2).alias("r"), F.lit(g.columns - 2).alias("c")) for g in grids])
    marked = points.withColumn("sg_id", F.monotonically_increasing_id()).withColumn("sg_at", cell)
    marked = written(marked, "undulation")
    last = F.element_at(sizes, F.col("sg_at.grid") + 1)
    r0, c0 = F.least(F.floor("sg_at.r"), last["r"]).cast("bigint"), F.least(F.floor("sg_at.c"), last["c"]).cast("bigint")
    own = marked.where("sg_at IS NOT NULL").select("sg_id", F.col("sg_at.grid").alias("grid"), r0.alias("r0"), c0.alias("c0"), (F.col("sg_at.r") - r0).alias("u"), (F.col("sg_at.c") - c0).alias("v"))
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    around = own.select("*", F.explode(four).alias("k")).select("sg_id", "grid", (F.col("r0") + F.col("k.a")).alias("row"), (F.col("c0") + F.col("k.b")).alias("col"), (F.when(F.col("k.a") == 1, F.col("u")).otherwise(1 - F.col("u")) * F.when(F.col("k.b") == 1, F.col("v")).otherwise(1 - F.col("v"))).alias("w"))
    found = around.where("w > 0").join(values, ["grid", "row", "col"], "left").groupBy("sg_id").agg(F.when(F.bool_and(F.col("value").isNotNull()), F.sum(F.col("w") * F.col("value"))).alias(into))
    return marked.join(found, "sg_id", "left").drop("sg_id", "sg_at")
