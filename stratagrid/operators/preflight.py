"""Which transformation of heights a survey takes, decided before any work: it is chosen and checked, or it is refused with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import lon_in

#: Metres by which the chosen operation may differ from the first ranked one at the survey's middle.
SANE = 2.0


def choose_operations(surveys: DataFrame, operations: DataFrame, by: Sequence[str], sane: float = SANE) -> DataFrame:
    """``surveys`` (by, grids: array or null, west, south, east, north) with rank and state of the operation for each.

    ``operations``: by, rank (from 1), grids (array), there (whether all its files are), shift (metres at the survey's middle; null if
    it can't be told), and its area of use (west, south, east, north; west > east crosses the antimeridian). Of the operations that
    name all wanted grids the first ranked is taken; without wanted grids the first ranked of all. State is ``ok`` or why not:
    ``no operation``, ``grids missing``, ``area outside`` or ``not sane``. Nothing is put in place of what was asked for.
    """
    by = list(by)
    ops = operations.select(*by, "rank", F.col("grids").alias("op_grids"), "there", "shift", *[F.col(c).alias(f"op_{c}") for c in ("west", "south", "east", "north")])
    joined = surveys.join(ops, by, "left")
    w = Window.partitionBy(*by)
    first = F.min_by("shift", "rank").over(w)
    fits = F.col("rank").isNotNull() & (F.col("grids").isNull() | (F.size(F.array_except("grids", "op_grids")) == 0))
    marked = joined.withColumns({"sg_first": first, "sg_fits": F.coalesce(fits, F.lit(False))})
    taken = marked.withColumn("sg_n", F.row_number().over(w.orderBy(F.col("sg_fits").desc(), F.col("rank").asc_nulls_last()))).where("sg_n = 1")
    inside = lon_in(F.col("west"), F.col("op_west"), F.col("op_east")) & lon_in(F.col("east"), F.col("op_west"), F.col("op_east")) & (F.col("south") >= F.col("op_south")) & (F.col("north") <= F.col("op_north"))
    # across the antimeridian both ends may lie inside while the middle does not
    inside = inside & ((F.col("op_west") <= F.col("op_east")) | (F.col("west") > F.col("east")) | (F.col("west") >= F.col("op_west")) | (F.col("east") <= F.col("op_east")))
    sure = F.abs(F.col("shift") - F.col("sg_first")) <= sane
    state = F.when(~F.col("sg_fits"), "no operation").when(~F.coalesce("there", F.lit(False)), "grids missing").when(~F.coalesce(inside, F.lit(False)), "area outside").when(~F.coalesce(sure, F.lit(False)), "not sane").otherwise("ok")
    return taken.withColumn("state", state).withColumn("rank", F.when(F.col("sg_fits"), F.col("rank"))).select(*surveys.columns, "rank", "state")


def require(chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """``chosen``, if all are ``ok``; else an error that names the first that are not."""
    bad = chosen.where("state != 'ok'").orderBy(*by).select(*by, "state").limit(10).collect()
    if bad:
        raise ValueError(f"no transformation of heights for {[tuple(r) for r in bad]}")
    return chosen
