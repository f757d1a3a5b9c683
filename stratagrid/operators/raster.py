"""Raster algebra over long rasters: rows (source, row, col, value); a cell without data has no row (or a null value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geo import cell
from ..plans.quantiles import quantiles
from ..plans.tables import spread

CELL = ("row", "col")


def from_sentinel(raster: DataFrame, nodata: float) -> DataFrame:
    """Null for the sentinel and for NaN."""
    return raster.withColumn("value", F.when((F.col("value") != nodata) & ~F.isnan("value"), F.col("value")))


def to_sentinel(raster: DataFrame, nodata: float) -> DataFrame:
    return raster.withColumn("value", F.coalesce("value", F.lit(nodata)))


def mosaic(raster: DataFrame, order: str, last_wins: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """One value per cell, for each raster ``by``: tiles are painted in order (the last wins), sources merged by priority (the first wins).
    Cells without data do not compete."""
    pick = F.max_by if last_wins else F.min_by
    return raster.where("value IS NOT NULL").groupBy(*by, *CELL).agg(pick("value", order).alias("value"), pick(F.col(order), order).alias("from"))


#: Rows and columns of a block of cells that one task fills.
BLOCK = 256


def filled_block(row, col, value, i: int, j: int, block: int, size: int, power: float):
    """Rows, columns and values of a block's cells that have data or get some, and which of them get it. The block begins at row ``i`` and
    column ``j`` and has ``block`` of each; cells are those with data in it and up to ``size`` rows and columns around."""
    import numpy as np

    # cells with data are few in many blocks, so each goes to the places around it, on a frame so wide that none is left out
    side = block + 4 * size
    at = (row - i + 2 * size) * side + col - j + 2 * size
    weight, total = np.zeros(side * side), np.zeros(side * side)
    for a in range(-size, size + 1):
        for b in range(-size, size + 1):
            if a or b:
                w = math.hypot(a, b) ** -power
                # a cell comes once, so no place is met twice in a step
                weight[at + (a * side + b)] += w
                total[at + (a * side + b)] += w * value
    own = np.zeros(side * side, bool)
    own[at] = True
    weight[at], total[at] = 1.0, value
    inside = np.zeros((side, side), bool)
    inside[2 * size:2 * size + block, 2 * size:2 * size + block] = True
    found = np.flatnonzero((weight > 0) & inside.ravel())
    return found // side + (i - 2 * size), found % side + (j - 2 * size), total[found] / weight[found], ~own[found]


def window_fill(raster: DataFrame, size: int = 4, power: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, row, col, value, filled): cells without data within ``size`` rows and columns of data get the distance-weighted mean of these;
    others stay as they are. Each group ``by`` is a raster of its own.

    Cells go to their block and to those whose edge they are near, in one exchange; a block is filled as a whole.
    """
    by, cells = list(by), raster.where("value IS NOT NULL")
    near = lambda c: F.sequence(F.floor((F.col(c) - size) / BLOCK), F.floor((F.col(c) + size) / BLOCK))
    dealt = cells.select(*by, *[F.col(c).cast("bigint").alias(c) for c in CELL], F.col("value").cast("double").alias("value")).withColumn("sg_i", F.explode(near("row"))).withColumn("sg_j", F.explode(near("col")))
    schema = dealt.drop("sg_i", "sg_j").withColumn("filled", F.lit(False)).schema

    def run(table):
        import pyarrow as pa

        i, j = table.column("sg_i")[0].as_py() * BLOCK, table.column("sg_j")[0].as_py() * BLOCK
        out = filled_block(*(table.column(c).to_numpy() for c in (*CELL, "value")), i, j, BLOCK, size, power)
        held = [pa.repeat(table.column(c)[0], len(out[0])) for c in by]
        return pa.Table.from_arrays([*held, *map(pa.array, out)], schema=arrow)

    arrow = to_arrow_schema(schema)
    return spread(dealt, *by, "sg_i", "sg_j").groupBy(*by, "sg_i", "sg_j").applyInArrow(run, schema)


def common_cells(raster: DataFrame, sources: Sequence | None = None, source: str = "source", by: Sequence[str] = ()) -> DataFrame:
    """Cells with data in all of ``sources`` (by default in all of their group ``by``): one aggregation, however many there are."""
    own = raster if sources is None else raster.where(F.col(source).isin(*sources))
    cells = own.where(F.col("value").isNotNull()).groupBy(*by, *CELL).agg(F.count_distinct(source).alias("n"))
    if sources is not None:
        return cells.where(F.col("n") == len(sources)).select(*by, *CELL)
    # a row per group
    groups = own.groupBy(*by).agg(F.count_distinct(source).alias("sg_all"))
    return (cells.join(groups, list(by)) if by else cells.join(F.broadcast(groups))).where("n = sg_all").select(*by, *CELL)


def overviews(raster: DataFrame, factors: Sequence[int] = (2, 4, 8, 16), by: Sequence[str] = ("source",)) -> DataFrame:
    """Means of the valid cells of each block of ``factor`` rows and columns; column level is the factor."""
    levels = raster.where("value IS NOT NULL").withColumn("level", F.explode(F.array(*[F.lit(f) for f in factors])))
    block = lambda c: F.floor(F.col(c) / F.col("level")).cast("bigint").alias(c)
    return levels.groupBy(*by, "level", block("row"), block("col")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def decimated(raster: DataFrame, height: int, width: int, max_dim: int, by: Sequence[str] = ("source",)) -> DataFrame:
    """Means onto a grid of at most ``max_dim`` rows and columns; as it is if it is no larger."""
    scale = max(1.0, max(height, width) / max_dim)
    block = lambda c: F.floor(F.col(c) / scale).cast("bigint").alias(c)
    return raster.where("value IS NOT NULL").groupBy(*by, block("row"), block("col")).agg(F.avg("value").alias("value"))


def strided(raster: DataFrame, height: int, width: int, max_dim: int) -> DataFrame:
    """Every k-th row and column, as reading a reduced image does: k is the whole number that brings the larger side to ``max_dim``."""
    k = max(1, math.ceil(max(height, width) / max_dim))
    kept = (F.col("row") % k == 0) & (F.col("col") % k == 0) & (F.col("row") < height // k * k) & (F.col("col") < width // k * k)
    return raster.where(kept).withColumns({"row": F.floor(F.col("row") / k).cast("bigint"), "col": F.floor(F.col("col") / k).cast("bigint")})


def hillshade(raster: DataFrame, dx: float, dy: float, azimuth: float = 315.0, altitude: float = 45.0, by: Sequence[str] = ("source",)) -> DataFrame:
    """Shade from 0 to 1 by central differences, one-sided at the edges. Rows count downwards. Cells next to one without data have none."""
    def slope(axis: str, other: str, step: float) -> Column:
        w = Window.partitionBy(*by, other).orderBy(axis)
        lo, hi = F.lag("value").over(w), F.lead("value").over(w)
        has_lo, has_hi = F.lag(axis).over(w) == F.col(axis) - 1, F.lead(axis).over(w) == F.col(axis) + 1
        first, final = F.lag(axis).over(w).isNull(), F.lead(axis).over(w).isNull()
        return F.when(has_lo & has_hi, (hi - lo) / (2 * step)).when(first & has_hi, (hi - F.col("value")) / step).when(final & has_lo, (F.col("value") - lo) / step)

    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    out = raster.withColumns({"gx": slope("col", "row", dx), "gy": slope("row", "col", dy)})
    steep = F.lit(math.pi / 2) - F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    shade = F.lit(math.sin(alt)) * F.sin(steep) + F.lit(math.cos(alt)) * F.cos(steep) * F.cos(F.lit(az - math.pi / 2) - aspect)
    return out.withColumn("shade", F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0))).where("shade IS NOT NULL").select(*by, *CELL, "shade")


def _cubic(d: Column) -> Column:
    """Keys' cubic kernel (a = -1/2) at distance ``d``."""
    x = F.abs(d)
    return F.when(x <= 1, 1.5 * x * x * x - 2.5 * x * x + 1).when(x < 2, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2).otherwise(0.0)


def _spline(d: Column) -> Column:
    """The cubic B-spline at distance ``d``."""
    x = F.abs(d)
    return F.when(x <= 1, x * x * x / 2 - x * x + 2 / 3).when(x < 2, (2 - x) * (2 - x) * (2 - x) / 6).otherwise(0.0)


#: Kinds of resampling: the places around a target's own that count, and the weight of each by its distance along one axis.
KERNELS = {"bilinear": ((0, 1), lambda d: 1 - F.abs(d)), "cubic": ((-1, 0, 1, 2), _cubic), "cubic_spline": ((-1, 0, 1, 2), _spline)}


def warp(raster: DataFrame, targets: DataFrame, source_row: Column, source_col: Column, kind: str = "bilinear", shift: Column | None = None, by: Sequence[str] = ("source",)) -> DataFrame:
    """Values of ``raster`` at ``targets`` (row, col and what the two expressions need), which give each target's place in the
    source's rows and columns (0 is the first cell's middle). ``kind``: nearest, bilinear, cubic or cubic_spline; weights count only
    neighbours with data, and a target whose weights do not add up to more than nothing has no value. ``shift`` is added to the
    values: for heights, never for intensities."""
    if kind != "nearest" and kind not in KERNELS:
        raise ValueError(f"no kind {kind!r}; there are nearest, {', '.join(KERNELS)}")
    keep = [c for c in targets.columns if c not in CELL]
    t = targets.select("row", "col", *keep, source_row.alias("sr"), source_col.alias("sc"))
    if kind == "nearest":
        t = t.withColumns({"srow": F.floor(F.col("sr") + 0.5).cast("bigint"), "scol": F.floor(F.col("sc") + 0.5).cast("bigint"), "w": F.lit(1.0)})
    else:
        steps, weight = KERNELS[kind]
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in steps for b in steps])
        t = t.withColumn("k", F.explode(pairs)).withColumns({"srow": (F.floor("sr") + F.col("k.a")).cast("bigint"), "scol": (F.floor("sc") + F.col("k.b")).cast("bigint")})
        t = t.withColumn("w", weight(F.col("sr") - F.col("srow")) * weight(F.col("sc") - F.col("scol"))).where("w != 0")
    values = raster.where("value IS NOT NULL").select(*by, F.col("row").alias("srow"), F.col("col").alias("scol"), "value")
    out = t.join(values, [*[c for c in by if c in keep], "srow", "scol"]).groupBy(*by, "row", "col").agg(F.sum(F.col("value") * F.col("w")).alias("sg_v"), F.sum("w").alias("sg_w"))
    out = out.where("sg_w > 1e-9").select(*by, "row", "col", (F.col("sg_v") / F.col("sg_w")).alias("value"))
    return out if shift is None else out.withColumn("value", F.col("value") + shift)


def on_grid(points: DataFrame, origin_x: float, origin_y: float, resolution: float) -> DataFrame:
    """row (downwards from the upper edge) and col of map coordinates."""
    return points.withColumns({"col": cell(F.col("x"), origin_x, resolution), "row": F.floor((F.lit(origin_y) - F.col("y")) / resolution).cast("bigint")})


def footprint_edges(raster: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """The boundary of the cells with data: an edge (r0, c0)-(r1, c1) for each side that exactly one cell has."""
    r, c = F.col("row"), F.col("col")
    side = lambda r0, c0, r1, c1: F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))
    sides = F.array(side(r, c, r, c + 1), side(r + 1, c, r + 1, c + 1), side(r, c, r + 1, c), side(r, c + 1, r + 1, c + 1))
    out = raster.where("value IS NOT NULL").select(*by, *CELL).distinct().select(*by, F.explode(sides).alias("e")).select(*by, "e.*")
    return out.groupBy(*by, "r0", "c0", "r1", "c1").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def footprint_area(raster: DataFrame, resolution: float, by: Sequence[str] = ("source",)) -> DataFrame:
    return raster.where("value IS NOT NULL").select(*by, *CELL).distinct().groupBy(*by).agg((F.count(F.lit(1)) * resolution * resolution).alias("area"))


def masked_median(left: DataFrame, right: DataFrame, mask: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact median and number of ``left`` - ``right`` over cells that both have, and that ``mask`` has, for each group of
    ``left``. What has no column of ``by`` serves all groups."""
    keys = lambda other: [*[c for c in by if c in other.columns], *CELL]
    joined = left.where("value IS NOT NULL").join(right.where("value IS NOT NULL").withColumnRenamed("value", "other"), keys(right))
    if mask is not None:
        joined = joined.join(mask.select(*keys(mask)).distinct(), keys(mask), "left_semi")
    return quantiles(joined, by, F.col("value") - F.col("other"), [0.5]).select(*by, F.col("q")[0].alias("median"), "n")


def datum_state(median: Column, n: Column, undulation: Column, tolerance: float = 3.0, least: int = 100, fail: bool = False) -> Column:
    """Whether heights still need the geoid shift: ``true`` near zero, ``false`` near the undulation, ``error`` otherwise or with
    too few cells. ``fail`` makes ``error`` a failure, as a run should treat it. Near both, ``true`` counts."""
    enough = (n >= least) & median.isNotNull() & ~F.isnan(median)
    error = F.raise_error(F.lit("the vertical datum can't be told")) if fail else F.lit("error")
    return F.when(enough & (F.abs(median) <= tolerance), "true").when(enough & (F.abs(median - undulation) <= tolerance), "false").otherwise(error)


def stretch(raster: DataFrame, low: float = 0.02, high: float = 0.98, by: Sequence[str] = ("source",)) -> DataFrame:
    """Robust range per source: interpolated percentiles; where these coincide, the least value and one more."""
    out = quantiles(raster, by, F.col("value"), [low, high]).withColumnRenamed("q", "p")
    flat = F.col("p")[1] <= F.col("p")[0]
    return out.select(*by, F.when(flat, F.col("least")).otherwise(F.col("p")[0]).alias("lo"), F.when(flat, F.col("least") + 1).otherwise(F.col("p")[1]).alias("hi"), "n")
