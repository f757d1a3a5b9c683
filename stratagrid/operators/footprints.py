"""Footprints of rasters as polygons: the rims of cells with data, as rings with holes, and with fewer corners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written
from .raster import CELL

#: Directions of a side, with data on its left as rows count downwards: a cell's lower, right, upper and left side.
EAST, NORTH, WEST, SOUTH = 0, 1, 2, 3


def sides(raster: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, dir, line, lo, hi): the straight stretches of the rim of the cells with data. ``line`` is the row (east, west) or column (north,
    south) of the corner lattice that a stretch lies on, ``lo`` and ``hi`` its ends there."""
    by = list(by)
    r, c = F.col("row").cast("bigint"), F.col("col").cast("bigint")
    unit = lambda d, line, lo: F.struct(F.lit(d).alias("dir"), line.alias("line"), lo.alias("lo"))
    four = F.array(unit(EAST, r + 1, c), unit(NORTH, c + 1, r), unit(WEST, r, c), unit(SOUTH, c, r))
    each = raster.where("value IS NOT NULL").select(*by, *CELL).distinct().select(*by, F.explode(four).alias("s")).select(*by, "s.*")
    # a side that two cells share is no rim
    rim = each.groupBy(*by, (F.col("dir") % 2).alias("axis"), "line", "lo").agg(F.count(F.lit(1)).alias("n"), F.first("dir").alias("dir")).where("n = 1")
    run = Window.partitionBy(*by, "dir", "line").orderBy("lo")
    return rim.withColumn("run", F.col("lo") - F.row_number().over(run)).groupBy(*by, "dir", "line", "run").agg(F.min("lo").alias("lo"), (F.max("lo") + 1).alias("hi")).drop("run")


def _ranked(links: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, ring, place) of a table of closed chains (by, id, next): the smallest id of each, and how far behind it in the chain.

    Pointer doubling: after k rounds each knows the smallest of the 2**k ids from it on, how far ahead that is, and the one behind
    them. The round after which no smallest id has changed has seen whole chains.
    """
    now = links.select(*by, "id", F.col("next").alias("jump"), F.col("id").alias("least"), F.lit(0).cast("bigint").alias("ahead"))
    step = 1
    while True:
        other = now.select(*by, F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"), F.col("ahead").alias("ahead2"))
        closer = F.col("least2") < F.col("least")
        now = written(now.join(other, [*by, "jump"]).select(
            *by, "id", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least"), F.when(closer, F.col("ahead2") + step).otherwise(F.col("ahead")).alias("ahead"), closer.alias("moved"),
        ), "rings")
        if now.where("moved").isEmpty():
            break
        step *= 2
    whole = now.groupBy(*by, "least").agg(F.count(F.lit(1)).alias("n"))
    return now.join(whole, [*by, "least"]).select(*by, "id", F.col("least").alias("ring"), ((F.col("n") - F.col("ahead")) % F.col("n")).alias("place"))


def rings(raster: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """(by, ring, outer, parent, points): the rims of the cells with data, a row for each closed one.

    points: its corners in order, an array of struct row, col on the corner lattice (cell (r, c) reaches from there to (r + 1, c + 1)), the
    first not repeated. Data are on the left, as seen with rows counting downwards: outer rims and holes run in opposite ways.
    Cells that only touch at a corner do not hang together. parent: the outer rim that a hole lies in, or the rim itself.
    The columns ``by`` must not be null.
    """
    by = list(by)
    own = written(sides(raster, by), "sides")
    across, forward = F.col("dir") % 2 == 0, F.col("dir").isin(EAST, SOUTH)
    first, last = F.when(forward, F.col("lo")).otherwise(F.col("hi")), F.when(forward, F.col("hi")).otherwise(F.col("lo"))
    corner = lambda at: (F.when(across, F.col("line")).otherwise(at), F.when(across, at).otherwise(F.col("line")))
    (r0, c0), (r1, c1) = corner(first), corner(last)
    own = own.withColumns({"r0": r0, "c0": c0, "r1": r1, "c1": c1})
    # a stretch is known by where it begins and its direction; two may begin at one corner
    own = written(own.withColumn("id", F.struct("r0", "c0", "dir")), "stretches")
    starts = own.select(*by, F.col("r0").alias("r1"), F.col("c0").alias("c1"), F.col("id").alias("next"))
    turn = F.pmod(F.col("next.dir") - F.col("dir"), F.lit(4))
    # where two begin, the turn to the left stays with the same cell
    links = own.join(starts, [*by, "r1", "c1"]).groupBy(*by, "id").agg(F.min_by("next", F.when(turn == 1, 0).otherwise(1)).alias("next"))
    placed = written(_ranked(written(links, "links"), by), "placed")
    points = placed.groupBy(*by, "ring").agg(F.sort_array(F.collect_list(F.struct("place", F.col("id.r0").alias("row"), F.col("id.c0").alias("col")))).alias("p"))
    points = points.select(*by, "ring", F.transform("p", lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"))).alias("points"))
    points = written(points.withColumn("outer", twice_area(F.col("points")) > 0), "rims")
    return points.join(_parents(own, placed, points, by), [*by, "ring"], "left").withColumn("parent", F.coalesce("parent", "ring")).select(*by, "ring", "outer", "parent", "points")


def twice_area(points: Column) -> Column:
    """Twice the cells within a rim; less than 0 for a hole."""
    following = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points), F.lit(1))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, following, lambda p, q: q["col"] * p["row"] * -1 + p["col"] * q["row"] * 1), F.lit(0).cast("bigint"), lambda s, x: s + x) * -1


def _parents(stretches: DataFrame, placed: DataFrame, rims: DataFrame, by: list[str]) -> DataFrame:
    """(by, ring, parent) of holes. West of a hole's first corner lies data, as far as the next rim, which is the outer one's or another
    hole's in it; from hole to hole the outer one is found by doubling."""
    holes = rims.where(~F.col("outer")).select(*by, "ring", F.array_min(F.transform("points", lambda p: F.struct(p["row"].alias("r"), p["col"].alias("c")))).alias("at"))
    # the cell that is the hole's first lies in the row below its first corner
    holes = holes.select(*by, "ring", F.col("at.r").alias("row"), F.col("at.c").alias("c"))
    upright = stretches.where(F.col("dir") == SOUTH).join(placed.select(*by, "id", F.col("ring").alias("other")), [*by, "id"])
    sides = upright.select(*by, "line", "other", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("row"))
    # holes and western sides of a row in order: each hole takes the last side before it, so no hole meets all sides of its row
    west = Window.partitionBy(*by, "row").orderBy("at", "hole").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(None).cast(rims.schema["ring"].dataType)
    both = sides.select(*by, "row", F.col("line").alias("at"), F.lit(1).alias("hole"), "other", none.alias("ring")).unionByName(holes.select(*by, "row", F.col("c").alias("at"), F.lit(0).alias("hole"), none.alias("other"), "ring"))
    near = both.withColumn("up", F.last("other", ignorenulls=True).over(west)).where("hole = 0 AND up IS NOT NULL").select(*by, "ring", "up")
    outer = rims.select(*by, F.col("ring").alias("up"), F.col("outer").alias("done"))
    now = written(near.join(outer, [*by, "up"]), "holes")
    while not now.where("NOT done").isEmpty():
        other = now.select(*by, F.col("ring").alias("up"), F.col("up").alias("up2"), F.col("done").alias("done2"))
        now = written(now.join(other, [*by, "up"], "left").select(*by, "ring", F.coalesce("up2", "up").alias("up"), F.coalesce("done2", "done").alias("done")), "holes")
    return now.select(*by, "ring", F.col("up").alias("parent"))


def simplified(points: Column, tolerance: float) -> Column:
    """The corners of a closed ring (array of struct row, col) that are left when no other lies farther than ``tolerance`` cells from the
    lines between them (Douglas and Peucker, 1973, from the two corners that are farthest apart); four at least."""
    import pandas as pd

    def one(ring) -> list:
        import numpy as np

        p = np.array([(x["row"], x["col"]) for x in ring], float)
        if len(p) <= 4:
            return list(ring)
        a = int(np.argmax(((p - p[0]) ** 2).sum(1)))
        kept, waiting, closed = {0, a}, [(0, a), (a, len(p))], np.concatenate([p, p[:1]])
        while waiting:
            i, j = waiting.pop()
            if j - i < 2:
                continue
            line, between = closed[j] - closed[i], closed[i + 1:j] - closed[i]
            length = float(np.hypot(*line))
            off = np.hypot(*between.T) if length == 0 else np.abs(line[0] * between[:, 1] - line[1] * between[:, 0]) / length
            k = int(np.argmax(off))
            if off[k] > tolerance:
                kept.add(i + 1 + k)
                waiting += [(i, i + 1 + k), (i + 1 + k, j)]
        return [ring[k] for k in sorted(kept)] if len(kept) >= 4 else list(ring)

    return F.pandas_udf(lambda s: pd.Series([None if x is None else one(x) for x in s]), "array<struct<row:bigint,col:bigint>>")(points)


def footprint(raster: DataFrame, by: Sequence[str] = ("source",), origin: tuple[float, float] = (0.0, 0.0), resolution: float = 1.0, tolerance: float = 0.0) -> DataFrame:
    """(by, parts, cells): the footprint of each raster as ``parts``, in map units (``origin``: the upper left corner), with fewer corners if
    ``tolerance`` (cells) is above 0; cells: how many it holds before that. Rasters without data have none."""
    by = list(by)
    found = rings(raster, by).withColumn("cells", twice_area(F.col("points")) / 2)
    if tolerance > 0:
        found = found.withColumn("points", simplified(F.col("points"), tolerance))
    placed = F.transform("points", lambda p: F.struct((F.lit(origin[0]) + p["col"] * resolution).alias("x"), (F.lit(origin[1]) - p["row"] * resolution).alias("y")))
    each = found.select(*by, "parent", "cells", F.struct((~F.col("outer")).alias("hole"), "ring", placed.alias("points")).alias("r"))
    parts = each.groupBy(*by, "parent").agg(F.sort_array(F.collect_list("r")).alias("r"), F.sum("cells").alias("cells")).select(*by, "parent", "cells", F.transform("r", lambda x: x["points"]).alias("rings"))
    return parts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("parent", "rings"))), lambda x: x["rings"]).alias("parts"), F.sum("cells").cast("bigint").alias("cells"))
