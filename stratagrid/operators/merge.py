"""Priority merge of sources with radiometric normalization of intensities. Elevations are never normalized, nothing is resampled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import quantiles as exact_quantiles
from ..plans.tables import written
from .raster import CELL, stretch

#: Cells of overlap from which a source's line is fitted to the composite; the range that values are held in.
MIN_OVERLAP, LEAST, MOST = 20_000, 1000.0, 60000.0
QUANTILES = tuple(q / 100 for q in range(10, 91))


def check_grids(headers: DataFrame) -> DataFrame:
    """``headers`` (source, origin_x, origin_y, res, width, height, crs, ...) if all grids are the same; else an error."""
    grids = headers.select("origin_x", "origin_y", "res", "width", "height", "crs").distinct().count()
    if grids > 1:
        raise ValueError(f"the sources have {grids} different grids")
    return headers


def overlap_fit(left: DataFrame, right: DataFrame, by: Sequence[str] = (), quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """slope and intercept of the line that maps the quantiles of ``right`` to those of ``left``, over the cells of both, and n, for
    each group of ``right``; a ``left`` without the columns ``by`` serves all groups."""
    keys = [*[c for c in by if c in left.columns], *CELL]
    both = left.where("value IS NOT NULL").withColumnRenamed("value", "y").join(right.where("value IS NOT NULL").withColumnRenamed("value", "x"), keys)
    # both sides in one pass, as groups of their own
    values = both.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("sg_side"), F.col(c).cast("double").alias("sg_value")) for c in "xy"])).alias("v")).select(*by, "v.*")
    found = exact_quantiles(values, [*by, "sg_side"], F.col("sg_value"), quantiles)
    pairs = found.groupBy(*by).agg(F.max("n").alias("n"), F.any_value(F.when(F.col("sg_side") == "x", F.col("q")), ignoreNulls=True).alias("xs"), F.any_value(F.when(F.col("sg_side") == "y", F.col("q")), ignoreNulls=True).alias("ys")).where("n IS NOT NULL")
    return pairs.select(*by, "n", F.explode(F.arrays_zip("xs", "ys")).alias("q")).groupBy(*by, "n").agg(F.regr_slope("q.ys", "q.xs").alias("slope"), F.regr_intercept("q.ys", "q.xs").alias("intercept"))


def clamped_line(value: Column, gain: Column, offset: Column) -> Column:
    return F.least(F.greatest(value * gain + offset, F.lit(LEAST)), F.lit(MOST))


def saturated_share(raster: DataFrame, top: float, by: Sequence[str] = ("source",)) -> DataFrame:
    return raster.where("value IS NOT NULL").groupBy(*by).agg(F.avg((F.col("value") == top).cast("int")).alias("saturated"))


def normalize(raster: DataFrame, order: Sequence, min_overlap: int = MIN_OVERLAP) -> tuple[list[tuple], DataFrame]:
    """Gain and offset of each source in ``order``, and the merged, normalized cells.

    Every source starts with a stretch of its 2-98 % range to the whole range. Each after the first is then fitted to the
    composite of those before, where they overlap enough and the line rises: the fold is sequential by nature, over a few
    sources, and each step is a pass over the data in Spark. Lines are fitted to values as they are; only the result is held
    between ``LEAST`` and ``MOST``. With one source nothing is changed.
    """
    order = list(order)
    if len(order) < 2:
        return [(s, 1.0, 0.0, "raw") for s in order], raster.where(F.col("source").isin(*order)).select(*CELL, "value")
    ranges = {r["source"]: r for r in stretch(raster.where(F.col("source").isin(*order))).collect()}
    fitted, composite = [], None
    for source in order:
        own, r = raster.where(F.col("source") == source).select(*CELL, "value"), ranges[source]
        gain = (MOST - LEAST) / (r["hi"] - r["lo"])
        offset, method = LEAST - gain * r["lo"], "global-stretch"
        if composite is not None:
            fit = overlap_fit(composite, own).first()
            if fit and fit["n"] >= min_overlap and (fit["slope"] or 0) > 0:
                gain, offset, method = fit["slope"], fit["intercept"], "overlap-refined"
        fitted.append((source, gain, offset, method))
        scaled = own.where("value IS NOT NULL").withColumn("value", F.col("value") * gain + offset)
        if composite is None:
            composite = scaled
        else:
            new = scaled.join(composite.select(*CELL), list(CELL), "left_anti")
            composite = composite.unionByName(new)
        composite = written(composite, "composite")
    return fitted, composite.withColumn("value", clamped_line(F.col("value"), F.lit(1.0), F.lit(0.0)))
