"""From tiles to finished products, and from products to what a preview shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import FIXED_EPOCH
from ..plans.tables import written
from . import raster

#: Cells of the reference that the datum test needs at least, and how far its median may be off.
LEAST_CELLS, TOLERANCE = 100, 3.0


def datum_decisions(rasters: DataFrame, reference: DataFrame, undulation: Column, by: Sequence[str], mask: DataFrame | None = None, tolerance: float = TOLERANCE, least: int = LEAST_CELLS) -> DataFrame:
    """(by, median, n, state) of each raster against a reference on its grid, over the cells that ``mask`` has, for example bare ground."""
    found = raster.masked_median(rasters, reference, mask, by)
    return found.withColumn("state", raster.datum_state(F.col("median"), F.col("n"), undulation, tolerance, least))


def finalize(tiles: DataFrame, targets: DataFrame, source_row: Column, source_col: Column, by: Sequence[str], order: str = "tile", decisions: DataFrame | None = None, undulation: Column | None = None, heights: bool = True, levels: Sequence[int] = (2, 4, 8, 16), kind: str = "bilinear", dynamic: Column | bool = True) -> DataFrame:
    """(by, level, row, col, value, epoch): the finished rasters of ``tiles`` (by, ``order``, row, col, value), level 1 and its overviews.

    The tiles of a raster are painted in order, the result is brought to the target grid (see ``raster.warp``), and overviews
    are made of it. Heights whose decision (by, state) is ``true`` get ``undulation`` added; ``error`` is a failure, and rasters
    without a decision are left as they are. Intensities are never shifted. Coordinates in a ``dynamic`` system (see
    ``crs.is_dynamic``; True, False, or a Column of ``by``) have the epoch of the fixed-plate realization that they come from; others have none.
    """
    by = list(by)
    mosaic = raster.mosaic(tiles, order, by=by).drop("from")
    base = raster.warp(mosaic, targets, source_row, source_col, kind, by=by)
    if heights and decisions is not None:
        state = F.when(F.col("state") == "error", F.raise_error(F.lit("the vertical datum can't be told")).cast("string")).otherwise(F.col("state"))
        base = base.join(decisions.select(*by, state.alias("state")), by, "left").withColumn("value", F.when(F.col("state") == "true", F.col("value") + undulation).otherwise(F.col("value"))).drop("state")
    base = written(base, "finished")
    whole = base.select(*by, F.lit(1).alias("level"), *raster.CELL, "value").unionByName(raster.overviews(base, levels, by).select(*by, "level", *raster.CELL, "value"))
    moves = F.lit(dynamic) if isinstance(dynamic, bool) else dynamic
    return whole.withColumn("epoch", F.when(moves, F.lit(FIXED_EPOCH)))


def preview(rasters: DataFrame, shown: Sequence[str] = ("dsm", "dtm", "dtm_fill"), product: str = "product", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(project, product, lo, hi, n, clim_lo, clim_hi): the range of each panel, and for ``shown``, elevations, one range that all panels of a project share.

    A project that has dtm_fill shows no dtm.
    """
    ranges = raster.stretch(rasters.where("value IS NOT NULL"), low, high, ["project", product])
    filled = ranges.where(F.col(product) == "dtm_fill").select("project")
    panels = ranges.where(F.col(product) != "dtm").unionByName(ranges.where(F.col(product) == "dtm").join(filled, "project", "left_anti"))
    shared = panels.where(F.col(product).isin(*shown)).groupBy("project").agg(F.min("lo").alias("clim_lo"), F.max("hi").alias("clim_hi"))
    out = panels.join(shared, "project", "left")
    own = F.col(product).isin(*shown)
    return out.withColumns({"clim_lo": F.when(own, F.col("clim_lo")).otherwise(F.col("lo")), "clim_hi": F.when(own, F.col("clim_hi")).otherwise(F.col("hi"))})


def footer(projects: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, first_start, last_end, n_projects, tiles): dates of merged projects, and their tiles if all of them have a count."""
    return projects.groupBy(*by).agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.count(F.lit(1)).alias("n_projects"), F.when(F.bool_and(F.col("tiles").isNotNull()), F.sum("tiles")).alias("tiles"))
