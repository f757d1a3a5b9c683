"""Point clouds: filters, derived attributes and grids. Points are rows; a cell is a pair of global integers, so no tile needs a halo."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geo import cell
from ..plans.tables import spread, written
from . import raster

LOW_NOISE, HIGH_NOISE, ROAD, GROUND = 7, 18, 11, 2


def drop_classes(points: DataFrame, *codes: int, cls: str = "cls") -> DataFrame:
    """Without the classes ``codes``; points without a class stay."""
    return points.where(F.col(cls).isNull() | ~F.col(cls).isin(*codes))


def ground_only(points: DataFrame, cls: str = "cls") -> DataFrame:
    return points.where(F.col(cls) == GROUND)


def return_group(groups: Iterable[str], rn: str = "rn", nr: str = "nr") -> Column:
    """Whether a return is one of ``groups``: only, first, last, intermediate. Only: the pulse's single return."""
    r, n = F.col(rn), F.col(nr)
    known = {"only": n == 1, "first": (n > 1) & (r == 1), "last": (n > 1) & (r == n), "intermediate": (n > 1) & (r > 1) & (r < n)}
    out = F.lit(False)
    for g in groups:
        if g not in known:
            raise ValueError(f"no return group {g!r}; there are {sorted(known)}")
        out = out | known[g]
    return out


def reset_classes(points: DataFrame, cls: str = "cls") -> DataFrame:
    return points.withColumn(cls, F.lit(0).cast(points.schema[cls].dataType))


def mark_high_z(points: DataFrame, share: float, by: Sequence[str] = ("tile",), z: str = "z", cls: str = "cls") -> DataFrame:
    """Class 18 for points whose z-score in their group exceeds the normal quantile of ``share``. NaN and null heights are
    left out of mean and population deviation; a group without spread stays as it is. Nulls in ``by`` are a group too."""
    value = F.when(~F.isnan(z), F.col(z))
    stats = points.groupBy(*[F.col(c).alias(f"sg_{c}") for c in by]).agg(F.avg(value).alias("sg_mean"), F.stddev_pop(value).alias("sg_std"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"sg_{c}")) for c in by])
    high = F.try_divide(value - F.col("sg_mean"), F.col("sg_std")) > NormalDist().inv_cdf(share)
    marked = F.when(F.coalesce(high, F.lit(False)), F.lit(HIGH_NOISE)).otherwise(F.col(cls))
    return points.join(stats, same).withColumn(cls, marked.cast(points.schema[cls].dataType)).select(*points.columns)


def with_cell(points: DataFrame, resolution: float, origin: tuple[float, float] = (0.0, 0.0), x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with col and row. Rows count upwards from the lower edge."""
    return points.withColumns({"col": cell(F.col(x), origin[0], resolution), "row": cell(F.col(y), origin[1], resolution)})


def grid_max(points: DataFrame, resolution: float, origin: tuple[float, float] = (0.0, 0.0), value: str = "z") -> DataFrame:
    """The largest value in each cell that has points."""
    return with_cell(points, resolution, origin).groupBy("row", "col").agg(F.max(value).alias("value"), F.count(F.lit(1)).alias("n"))


def near_cells(points: DataFrame, resolution: float, radius: float, origin: tuple[float, float] = (0.0, 0.0), x: str = "x", y: str = "y") -> DataFrame:
    """Each point once for every cell whose centre is within ``radius``, with row, col and the distance ``d``. Makes no join."""
    # of each column only the rows within the circle are made
    low = lambda c, o, r: F.ceil((F.col(c) - o - r) / resolution - 0.5).cast("bigint")
    high = lambda c, o, r: F.floor((F.col(c) - o + r) / resolution - 0.5).cast("bigint")
    centre = lambda i, o: (F.col(i) + 0.5) * resolution + o
    steps = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi))
    r = F.lit(radius)
    out = points.withColumn("col", F.explode(steps(low(x, origin[0], r), high(x, origin[0], r))))
    dx = F.col(x) - centre("col", origin[0])
    # a little wider, so that rounding loses nothing; the distance decides
    half = F.sqrt(F.greatest(F.lit(radius * radius) - dx * dx, F.lit(0.0))) + resolution * 1e-9
    out = out.withColumn("row", F.explode(steps(low(y, origin[1], half), high(y, origin[1], half))))
    dy = F.col(y) - centre("row", origin[1])
    return out.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)


def idw(value: Column, distance: Column, power: float = 1.0, where: Column | None = None) -> Column:
    """Inverse-distance weighted mean of a group; points at the very centre decide alone."""
    keep = lambda c: c if where is None else F.when(where, c)
    w = F.when(distance > 0, 1 / (distance if power == 1 else F.pow(distance, F.lit(power))))
    return F.coalesce(F.avg(keep(F.when(distance == 0, value))), F.sum(keep(value * w)) / F.nullif(F.sum(keep(w)), F.lit(0.0)))


def grid_idw(points: DataFrame, resolution: float, radius: float | None = None, power: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), value: str = "z") -> DataFrame:
    """Inverse-distance gridding (Shepard, 1968). The radius is half the cell's diagonal times two by default."""
    near = near_cells(points, resolution, resolution * math.sqrt(2) if radius is None else radius, origin)
    return near.groupBy("row", "col").agg(idw(F.col(value), F.col("d"), power).alias("value"), F.count(F.lit(1)).alias("n"))


def grid_idw_filled(points: DataFrame, resolution: float, radius: float | None = None, power: float = 1.0, origin: tuple[float, float] = (0.0, 0.0), value: str = "z", size: int = 4, fill_power: float = 1.0) -> DataFrame:
    """``raster.window_fill`` of ``grid_idw``: (row, col, value, filled).

    Points go to the blocks of cells that they can have a part in, in one exchange; a block is gridded and filled as a whole, so neither
    the pairs of points and cells nor the grid are rows.
    """
    radius = resolution * math.sqrt(2) if radius is None else radius
    # a point's own cell and those around it that the circle may meet, and one more for rounding
    steps = math.floor(radius / resolution + 0.5) + 1
    block, finite = raster.BLOCK, lambda c: F.col(c).between(-1.7e308, 1.7e308)
    near = lambda c, o: F.sequence(*[F.floor(((F.col(c) - o) / resolution + k * (size + steps)) / block) for k in (-1, 1)])
    dealt = points.where(finite("x") & finite("y")).select(*[F.col(c).cast("double").alias(c) for c in "xy"], F.col(value).cast("double").alias("z"))
    dealt = dealt.withColumn("sg_i", F.explode(near("y", origin[1]))).withColumn("sg_j", F.explode(near("x", origin[0])))

    def run(table):
        import numpy as np
        import pyarrow as pa

        i, j = table.column("sg_i")[0].as_py() * block, table.column("sg_j")[0].as_py() * block
        x, y = (table.column(c).to_numpy() for c in "xy")
        some, z = table.column("z").is_valid().to_numpy(), table.column("z").fill_null(0.0).to_numpy()
        # places of a frame as wide as the cells that the block is filled from
        side = block + 2 * size
        own_col, own_row = (np.floor((c - o) / resolution).astype(np.int64) for c, o in ((x, origin[0]), (y, origin[1])))
        met = []
        for a in range(-steps, steps + 1):
            col = own_col + a
            dx = x - ((col + 0.5) * resolution + origin[0])
            might = np.flatnonzero((np.abs(dx) <= radius) & (col >= j - size) & (col < j + block + size))
            if not len(might):
                continue
            for b in range(-steps, steps + 1):
                row = own_row[might] + b
                dy = y[might] - ((row + 0.5) * resolution + origin[1])
                d = np.sqrt(dx[might] * dx[might] + dy * dy)
                k = np.flatnonzero((d <= radius) & (row >= i - size) & (row < i + block + size))
                met.append((might[k], (row[k] - (i - size)) * side + col[might[k]] - (j - size), d[k]))
        if not met:
            return arrow.empty_table()
        who, place, d = map(np.concatenate, zip(*met))
        count = lambda keep, weight=None: np.bincount(place[keep], weight, side * side)
        held = some[who]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = 1 / (d if power == 1 else d ** power)
            off = d > 0
            out = count(off & held, (w * z[who])[off & held]) / count(off, w[off])
            there = count(off & held) > 0
            if not off.all():
                centre = ~off & held
                n = count(centre)
                out, there = np.where(n > 0, count(centre, z[who][centre]) / n, out), there | (n > 0)
        at = np.flatnonzero(there)
        filled = raster.filled_block(at // side + (i - size), at % side + (j - size), out[at], i, j, block, size, fill_power)
        return pa.Table.from_arrays([pa.array(c) for c in filled], schema=arrow)

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("filled", T.BooleanType())])
    arrow = to_arrow_schema(schema)
    return spread(dealt, "sg_i", "sg_j").groupBy("sg_i", "sg_j").applyInArrow(run, schema)


@dataclass(frozen=True)
class Product:
    """A grid: which points take part, which value is gridded, and how."""

    name: str
    where: Column
    value: str
    method: str = "idw"


def products(hag: str | None = None, max_hag: float | None = None) -> list[Product]:
    """dsm, dtm and intensity. Ground never depends on the height above it."""
    clean = F.col("cls").isNull() | ~F.col("cls").isin(LOW_NOISE, HIGH_NOISE)
    low = F.lit(True) if hag is None else F.col(hag).isNull() | (F.col(hag) <= max_hag)
    surface = clean & low & return_group(("first", "only"))
    return [Product("dsm", surface, "z"), Product("dtm", clean & (F.col("cls") == GROUND), "z"), Product("intensity", surface, "intensity")]


def grid_products(points: DataFrame, wanted: Sequence[Product], resolution: float, radius: float | None = None, power: float = 1.0, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """All products in one pass: one scan, one exchange by cell; a column per product, null where it has no points."""
    any_of = wanted[0].where
    for p in wanted[1:]:
        any_of = any_of | p.where
    flags = {f"sg_in_{p.name}": p.where for p in wanted}
    near = near_cells(points.where(any_of).withColumns(flags), resolution, resolution * math.sqrt(2) if radius is None else radius, origin)
    return near.groupBy("row", "col").agg(*[
        (idw(F.col(p.value), F.col("d"), power, F.col(f"sg_in_{p.name}")) if p.method == "idw" else F.max(F.when(F.col(f"sg_in_{p.name}"), F.col(p.value)))).alias(p.name)
        for p in wanted
    ])


#: Mean distances between ground points: the side of a block, its margin. Pairs of points that are compared at once.
SPAN, MARGIN, PAIRS = 16, 2, 100_000


def _nearest(px, py, gx, gy):
    """Of each point the nearest ground point's number, the smallest of several, and its squared distance. Points are halved until few
    pairs are left; a half keeps the ground that may be nearest to a point in its box, so that dense places cost no more."""
    import numpy as np

    best, least, todo = np.zeros(len(px), int), np.zeros(len(px)), [(np.arange(len(px)), np.arange(len(gx)))]
    while todo:
        p, g = todo.pop()
        west, east, south, north = px[p].min(), px[p].max(), py[p].min(), py[p].max()
        if len(p) * len(g) > PAIRS:
            x, y = gx[g], gy[g]
            far = np.maximum(x - west, east - x) ** 2 + np.maximum(y - south, north - y) ** 2
            near = np.maximum(np.maximum(west - x, x - east), 0) ** 2 + np.maximum(np.maximum(south - y, y - north), 0) ** 2
            # a little wider, so that rounding loses nothing
            g = g[near <= far.min() * (1 + 1e-9)]
        if len(p) * len(g) > PAIRS and (west < east or south < north):
            k = np.argsort(px[p] if east - west >= north - south else py[p], kind="stable")
            todo += [(p[k[:len(p) // 2]], g), (p[k[len(p) // 2:]], g)]
            continue
        rows = max(PAIRS // len(g), 1)
        # points at one place have one answer
        for own in [p[:1]] if west == east and south == north else [p[k:k + rows] for k in range(0, len(p), rows)]:
            dx, dy = px[own, None] - gx[g], py[own, None] - gy[g]
            d2 = dx * dx + dy * dy
            k = d2.argmin(1)
            to = p if west == east and south == north else own
            best[to], least[to] = g[k], d2[np.arange(len(own)), k]
    return best, least


def height_above_ground(points: DataFrame, by: Sequence[str] = ("tile",), bucket: float | None = None, cls: str = "cls") -> DataFrame:
    """``points`` with hag: the height above the nearest ground point of the group in x and y (of several, the lowest).

    Each group is cut into blocks, and a point goes to its block, a ground point to all blocks that it is near: one exchange, in which
    tasks read a block's ground and then its points in batches. Points whose nearest find may not be the nearest look around
    themselves in buckets that get four times as wide each round; only they are made into rows for buckets. A group without ground has
    null, and so has a point whose place isn't known. ``bucket``: the distance between ground points, by default that of each group
    if its ground were spread evenly. Needs ``x``, ``y``, ``z`` and no column starting with ``sg_``.
    """
    by, is_ground = list(by), F.col(cls) == GROUND
    finite = lambda c: F.col(c).between(-1.7e308, 1.7e308)
    x, y = (F.when(is_ground & finite("x") & finite("y"), F.col(c)) for c in "xy")
    width, height = F.max(x) - F.min(x), F.max(y) - F.min(y)
    reach = F.greatest(*[F.max(F.when(finite(c), F.col(c))) - F.min(F.when(finite(c), F.col(c))) for c in "xy"]).cast("double")
    # a group's ground may lie on a line, or at one place
    own = points.groupBy(*by).agg(F.greatest(F.sqrt(width * height / F.count(x)), F.greatest(width, height) / F.count(x)).alias("sg_s"), reach.alias("sg_reach"), F.count(x).alias("sg_n")).where("sg_n > 0")
    wide = F.greatest("sg_s", F.col("sg_reach") * 1e-5)
    own = written(own.select(*by, (F.when(wide > 0, wide).otherwise(1.0) if bucket is None else F.lit(float(bucket))).alias("sg_s"), "sg_reach"), "groups")
    at = lambda c, size, off=0: F.floor((F.col(c) + F.col("sg_s") * off) / (F.col("sg_s") * size))
    here = points.join(own.drop("sg_reach"), by, "left").withColumns({"sg_i": at("x", SPAN), "sg_j": at("y", SPAN), "sg_point": F.lit(True)}).drop("sg_s")
    near = lambda c: F.explode(F.sequence(at(c, SPAN, -MARGIN), at(c, SPAN, MARGIN)))
    ground = points.where(is_ground & finite("x") & finite("y")).select(*by, "x", "y", "z").join(own, by)
    around = ground.withColumn("sg_i", near("x")).withColumn("sg_j", near("y")).withColumn("sg_point", F.lit(False)).drop("sg_reach")
    key = [*by, "sg_i", "sg_j"]
    # the margin goes with the ground: points have no use for it otherwise
    dealt = here.withColumn("sg_s", F.lit(None).cast("double")).unionByName(around, allowMissingColumns=True)
    schema = points.withColumns({"sg_ground": F.col("z"), "sg_sure": F.lit(False)}).schema

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        group, held, ready = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keyed = [table.column(c).to_pylist() for c in (*key, "sg_point")]
            keyed = list(zip(*keyed))
            out, start = [], 0
            for k in [*(k for k in range(1, len(keyed)) if keyed[k] != keyed[k - 1]), len(keyed)]:
                part, own_key = table.slice(start, k - start), keyed[start][:-1]
                if own_key != group:
                    group, held, ready = own_key, [], None
                if not keyed[start][-1]:
                    held.append(part.select(["x", "y", "z", "sg_s"]))
                elif k > start:
                    n = len(part)
                    px, py = (part.column(c).to_numpy().astype(float) for c in "xy")
                    take, sure = np.full(n, -1), ~(np.isfinite(px) & np.isfinite(py))
                    if held and ready is None:
                        g = pa.concat_tables(held)
                        z = g.column("z").to_numpy().astype(float)
                        # of several, the first: the lowest
                        g = g.take(pa.array(np.argsort(np.where(g.column("z").is_null().to_numpy(), -np.inf, z), kind="stable")))
                        ready = *(g.column(c).to_numpy().astype(float) for c in "xy"), g.column("z"), (g.column("sg_s")[0].as_py() * MARGIN) ** 2
                    if ready:
                        good = np.flatnonzero(~sure)
                        if len(good):
                            best, d2 = _nearest(px[good], py[good], *ready[:2])
                            take[good], sure[good] = best, d2 <= ready[3]
                    z = ready[2].take(pa.array(take, mask=take < 0)) if ready else pa.nulls(n, arrow.field("sg_ground").type)
                    out.append(part.select(points_columns).append_column("sg_ground", z).append_column("sg_sure", pa.array(sure)).cast(arrow))
                start = k
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    points_columns, arrow = points.columns, to_arrow_schema(schema)
    found = written(dealt.repartition(*key).sortWithinPartitions(*key, "sg_point").mapInArrow(run, schema), "nearest-ground")
    sure = found.where("sg_sure").withColumn("hag", F.col("z") - F.col("sg_ground")).select(*points.columns, "hag")
    unsure = found.where("NOT sg_sure").drop("sg_ground", "sg_sure")
    left, out, wide = written(unsure.select(*by, "x", "y").distinct().join(own, by), "unsure"), None, 2 * MARGIN
    if left.isEmpty():
        return sure.unionByName(unsure.withColumn("hag", F.lit(None).cast(sure.schema["hag"].dataType)))
    while True:
        step = F.sequence(F.lit(-1), F.lit(1))
        spread = left.withColumn("sg_a", F.explode(step)).withColumn("sg_b", F.explode(step)).withColumns({"sg_i": at("x", wide) + F.col("sg_a"), "sg_j": at("y", wide) + F.col("sg_b")})
        there = ground.select(*by, F.col("x").alias("sg_gx"), F.col("y").alias("sg_gy"), F.col("z").alias("sg_gz"), at("x", wide).alias("sg_i"), at("y", wide).alias("sg_j"))
        dx, dy = F.col("x") - F.col("sg_gx"), F.col("y") - F.col("sg_gy")
        best = F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col("sg_gz").alias("gz")))
        met = spread.join(there, key).groupBy(*by, "x", "y").agg(best.alias("sg_best"))
        size = F.col("sg_s") * wide
        certain = F.coalesce(F.col("sg_best.d2") <= size * size, F.lit(False)) | (size > F.col("sg_reach"))
        met = written(left.join(met, [*by, "x", "y"], "left").withColumn("sg_sure", certain), "nearest-ground")
        done = met.where("sg_sure").select(*by, "x", "y", F.col("sg_best.gz").alias("sg_ground"))
        out = done if out is None else out.unionByName(done)
        left = met.where("NOT sg_sure").drop("sg_best", "sg_sure")
        if left.isEmpty():
            break
        wide *= 4
    return sure.unionByName(unsure.join(out, [*by, "x", "y"], "left").withColumn("hag", F.col("z") - F.col("sg_ground")).select(*points.columns, "hag"))


def mark_high(points: DataFrame, max_hag: float, hag: str = "hag", cls: str = "cls") -> DataFrame:
    """Class 18 for points more than ``max_hag`` above ground, so that what drops high noise drops them; points without a height stay."""
    high = F.coalesce(F.col(hag) > max_hag, F.lit(False))
    return points.withColumn(cls, F.when(high, F.lit(HIGH_NOISE)).otherwise(F.col(cls)).cast(points.schema[cls].dataType))


def thin(points: DataFrame, resolution: float, order: Sequence[Column]) -> DataFrame:
    """One point, the first by ``order``, of each cube of the given size."""
    cubes = {f"sg_{c}": F.floor(F.col(c) / resolution) for c in ("x", "y", "z")}
    w = Window.partitionBy(*cubes).orderBy(*order)
    return points.withColumns(cubes).withColumn("sg_n", F.row_number().over(w)).where("sg_n = 1").drop("sg_n", *cubes)


def crop(points: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, buffer: float = 0.0) -> DataFrame:
    """Points in the closed, buffered box; a range predicate that reaches the scan."""
    return points.where(F.col("x").between(xmin - buffer, xmax + buffer) & F.col("y").between(ymin - buffer, ymax + buffer))


def bounds(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def tile_lattice(extent: DataFrame, step: float, resolution: float, buffer: float) -> DataFrame:
    """Tiles over a one-row ``extent`` (xmin, ymin, xmax, ymax), numbered column by column from 1.

    The last tile of a row or column ends with the extent; boxes are then widened to multiples of the resolution, buffered and
    widened again.
    """
    count = lambda a, b: F.greatest(F.ceil((F.col(b) - F.col(a)) / step), F.lit(1))
    e = extent.select("xmin", "ymin", "xmax", "ymax", count("xmin", "xmax").alias("n_cols"), count("ymin", "ymax").alias("n_rows"))
    found = e.limit(2).collect()
    if len(found) > 1:
        raise ValueError("the extent has more than one row")
    # a range of numbers is dealt to all tasks and made row by row; a sequence of one row would be held by one task
    rows, cols = (found[0]["n_rows"], found[0]["n_cols"]) if found else (1, 0)
    of = {c: F.lit(found[0][c] if found else None).cast(e.schema[c].dataType).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")}
    t = extent.sparkSession.range(rows * cols).select(*of.values(), (F.col("id") + 1).alias("tile"), F.expr(f"id div {rows}L").alias("i"), (F.col("id") % rows).alias("j"))
    low = lambda c, k: F.floor((F.col(c) + F.col(k) * step) / resolution) * resolution
    high = lambda c, k, end: F.ceil(F.least(F.col(c) + (F.col(k) + 1) * step, F.col(end)) / resolution) * resolution
    t = t.select("tile", low("xmin", "i").alias("x0"), low("ymin", "j").alias("y0"), high("xmin", "i", "xmax").alias("x1"), high("ymin", "j", "ymax").alias("y1"))
    down, up = (lambda c: F.floor((F.col(c) - buffer) / resolution) * resolution), (lambda c: F.ceil((F.col(c) + buffer) / resolution) * resolution)
    return t.select("tile", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], down("x0").cast("double").alias("bx0"), down("y0").cast("double").alias("by0"), up("x1").cast("double").alias("bx1"), up("y1").cast("double").alias("by1"))


def to_tiles(points: DataFrame, step: float, buffer: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Each point once for every square tile of side ``step`` whose buffered, half-open square holds it, with tile_col and tile_row."""
    index = lambda c, o, b: F.floor((F.col(c) - o + b) / step).cast("bigint")
    out = points.withColumn("tile_col", F.explode(F.sequence(index("x", origin[0], -buffer), index("x", origin[0], buffer))))
    return out.withColumn("tile_row", F.explode(F.sequence(index("y", origin[1], -buffer), index("y", origin[1], buffer))))


def tile_counts(tiles: DataFrame, counts: DataFrame, key: str = "tile") -> DataFrame:
    """Every tile with its number of points, 0 and ``empty`` where it has none: an empty tile is an outcome, not a failure."""
    return tiles.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.col("n") == 0, F.lit(True)).alias("empty"))


#: Rows and columns of a block of cells; gaps that are filled at once; points of a group that one task takes whole; points that it takes at once.
BLOCK, GAPS, WHOLE, BATCH = 512, 4_096, 1_000_000, 100_000
#: Places of a plane for each cell in it, up to which the plane is made whole.
DENSE = 4


def _plane(group, row, col, window: int):
    """Rows and columns of cells of many groups in one plane: what is within ``window`` rows or columns stays as far apart as it is, all else
    is farther apart than that, and so are groups. Rows of two groups are never the same."""
    import numpy as np

    def closer(at, apart):
        order = np.lexsort((at, group))
        fresh, step = np.diff(group[order]) != 0, np.diff(at[order])
        # below zero: more than a long
        step = np.where(fresh | (step < 0) | (step > window), window + 1, step)
        made, out = np.concatenate([[0], np.cumsum(step)]), np.empty(len(at), int)
        if not apart:
            made -= made[np.maximum.accumulate(np.where(np.concatenate([[True], fresh]), np.arange(len(at)), 0))]
        out[order] = made
        return out

    return closer(row, True), closer(col, False)


def _surface(row, col, low, window: int, rise: float, dense: int):
    """Of each cell of a plane whether some opening lowers it by more than ``rise`` times the window's size; and its height: low, for flagged
    cells the distance-weighted mean of the others within ``window`` rows and columns, NaN if there are none. A plane of up to ``dense`` places
    a cell is made whole."""
    return (_filled_plane if (int(row.max()) + 1) * (int(col.max()) + 1) <= dense * len(row) else _few_cells)(row, col, low, window, rise)


def _few_cells(row, col, low, window: int, rise: float):
    """As ``_surface``, where few places of the plane have cells: each meets those that are near in its row and column, not all places."""
    import numpy as np

    # a margin on both sides: rows are farther apart than a window reaches
    wide, high = int(col.max()) + 2 * window + 1, int(row.max()) + 2 * window + 1
    order = np.argsort(row * wide + col, kind="stable")
    row, col, low = row[order], col[order], low[order]
    key = row * wide + col + window

    def pairs(keys, at):
        """For the 1st, 2nd, ... next cell in a line: cells, that next cell, and how many of them are within 0, 1, ... places."""
        for s in range(1, window + 1):
            d = keys[s:] - keys[:-s]
            i = np.flatnonzero(d <= window)
            if not len(i):
                return
            i = i[np.argsort(d[i], kind="stable")]
            yield at[i], at[i + s], np.searchsorted(d[i], np.arange(window + 1), "right")

    down = np.argsort(col * high + row, kind="stable")
    lines = list(pairs(key, np.arange(len(key)))), list(pairs((col * high + row)[down], down))
    now, flag = low, np.zeros(len(low), bool)
    for w in range(1, window + 1):
        made = now
        for pick in (np.minimum, np.maximum):
            for line in lines:
                held, made = made, made.copy()
                for a, b, n in line:
                    i, j = a[:n[w]], b[:n[w]]
                    # in a step a cell is met once from each side
                    made[i] = pick(made[i], held[j])
                    made[j] = pick(made[j], held[i])
        with np.errstate(invalid="ignore"):
            flag |= now - made > rise * w
        now = made
    z, gaps = low.copy(), np.flatnonzero(flag)
    ground, height = key[~flag], low[~flag]
    for k in range(0, len(gaps), 16 * GAPS):
        at = gaps[k:k + 16 * GAPS]
        total, share = np.zeros(len(at)), np.zeros(len(at))
        for a in range(-window, window + 1):
            here = key[at] + a * wide
            start = np.searchsorted(ground, here - window)
            n = np.searchsorted(ground, here + window, "right") - start
            who = np.repeat(np.arange(len(at)), n)
            other = np.arange(len(who)) + np.repeat(start - (np.cumsum(n) - n), n)
            weight = 1 / ((ground[other] - here[who]) ** 2 + a * a)
            total += np.bincount(who, weight * height[other], len(at))
            share += np.bincount(who, weight, len(at))
        with np.errstate(invalid="ignore", divide="ignore"):
            z[at] = total / share
    flags, heights = np.empty_like(flag), np.empty_like(z)
    flags[order], heights[order] = flag, z
    return flags, heights


def _filled_plane(row, col, low, window: int, rise: float):
    """As ``_surface``, where many places of the plane have cells."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    def widest(pick, none, values, w, axis):
        """The extreme of ``values`` within ``w`` places along an axis, from stretches that double."""
        pad = [(0, 0), (0, 0)]
        pad[axis] = (w, w)
        made, span = np.pad(values, pad, constant_values=none), 1
        cut = lambda a, b: (slice(None), slice(a, b)) if axis else slice(a, b)
        while span < 2 * w + 1:
            step = min(span, 2 * w + 1 - span)
            made = pick(made[cut(None, -step)], made[cut(step, None)])
            span += step
        return made

    there = np.zeros((row.max() + 1, col.max() + 1), bool)
    there[row, col] = True
    now = np.full(there.shape, np.inf)
    now[row, col] = low
    flag = np.zeros(there.shape, bool)
    for w in range(1, window + 1):
        made = now
        for pick, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
            for axis in (1, 0):
                made = widest(pick, none, np.where(there, made, none), w, axis)
        with np.errstate(invalid="ignore"):
            flag |= there & (now - made > rise * w)
        now = np.where(there, made, np.inf)
    flags, z = flag[row, col], low.copy()
    gaps = np.flatnonzero(flags)
    if len(gaps):
        ground, height = np.zeros(there.shape), np.zeros(there.shape)
        ground[row, col], height[row, col] = ~flags, np.where(flags, 0.0, low)
        d = np.arange(-window, window + 1)
        far = d[:, None] ** 2 + d[None, :] ** 2
        weight = np.where(far > 0, 1 / np.maximum(far, 1), 0.0)
        ground, height = (sliding_window_view(np.pad(x, window), far.shape) for x in (ground, height))
        for k in range(0, len(gaps), GAPS):
            at = gaps[k:k + GAPS]
            total, share = (np.einsum("kab,ab->k", x[row[at], col[at]], weight) for x in (height, ground))
            with np.errstate(invalid="ignore", divide="ignore"):
                z[at] = total / share
    return flags, z


def _opened(cells: DataFrame, by: Sequence[str], window: int, rise: float) -> DataFrame:
    """``cells`` (by, row, col, low) with flag and sg_z as ``_surface`` tells them, null for NaN.

    A cell's openings reach as far as all windows together, and those of the cells it is filled from one window farther.
    """
    by, margin = list(by), window * (window + 2)
    near = lambda c: F.sequence(F.floor((F.col(c) - margin) / BLOCK), F.floor((F.col(c) + margin) / BLOCK))
    dealt = cells.withColumn("sg_i", F.explode(near("row"))).withColumn("sg_j", F.explode(near("col")))
    schema = cells.withColumns({"flag": F.lit(False), "sg_z": F.lit(None).cast("double")}).schema

    def run(table):
        import numpy as np
        import pyarrow as pa

        row, col, low = (table.column(c).to_numpy() for c in ("row", "col", "low"))
        own = (row // BLOCK == table.column("sg_i")[0].as_py()) & (col // BLOCK == table.column("sg_j")[0].as_py())
        if not own.any():
            return arrow.empty_table()
        flags, z = _surface(*_plane(np.zeros(len(row), int), row, col, window), low.astype(float), window, rise, DENSE)
        z = pa.array(z[own], mask=np.isnan(z[own]))
        return table.select(schema.names[:-2]).filter(pa.array(own)).append_column("flag", pa.array(flags[own])).append_column("sg_z", z).cast(arrow)

    arrow = to_arrow_schema(schema)
    return dealt.groupBy(*by, "sg_i", "sg_j").applyInArrow(run, schema)


def _classified_whole(points: DataFrame, by: Sequence[str], resolution: float, window: int, slope: float, threshold: float, scalar: float, cls: str) -> DataFrame:
    """``classify_ground`` of groups that a task can hold: points are moved once, and groups are taken together while they are small."""
    known = reduce(and_, [F.col(c).isNotNull() for c in (*by, "sg_row", "sg_col")])
    cells = with_cell(points, resolution).withColumnsRenamed({"row": "sg_row", "col": "sg_col"}).withColumn("sg_z", F.when(known, F.col("z").cast("double")))
    schema = points.schema

    def ground(group, row, col, z):
        """Whether points, of which groups come one after the other, are ground."""
        import numpy as np

        row, col = _plane(group, row, col, window)
        key = row * (int(col.max()) + 1) + col
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], np.diff(key[order]) != 0])
        first = order[fresh]
        low, cell_of = np.fmin.reduceat(z[order], np.flatnonzero(fresh)), np.empty(len(z), int)
        cell_of[order] = np.cumsum(fresh) - 1
        row, col, group, dem, steep = row[first], col[first], group[first], np.full(len(low), np.nan), np.zeros(len(low))
        some = np.flatnonzero(~np.isnan(low))
        if len(some):
            dem[some] = _surface(row[some], col[some], low[some], window, slope * resolution, DENSE)[1]
        some = np.flatnonzero(~np.isnan(dem))
        row, col, group, known_z = row[some], col[some], group[some], dem[some]
        with np.errstate(invalid="ignore"):
            slopes = []
            for line, place in ((row, col), (group * (int(col.max(initial=0)) + 1) + col, row)):
                k, rise = np.lexsort((place, line)), np.zeros(len(some))
                between = line[k][2:] == line[k][:-2]
                rise[k[1:-1]] = np.where(between, (known_z[k][2:] - known_z[k][:-2]) / (2 * resolution), 0.0)
                slopes.append(rise)
            steep[some] = np.sqrt(slopes[0] ** 2 + slopes[1] ** 2)
            limit = threshold + steep[cell_of] * scalar
            # NaN is the largest number
            return ~np.isnan(dem[cell_of]) & ((np.abs(z - dem[cell_of]) <= limit) | np.isnan(limit))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def classified(table, group):
            there = table.column("sg_z").is_valid().to_numpy()
            out = np.full(len(table), 1)
            if there.any():
                row, col = (table.column(c).fill_null(0).to_numpy()[there] for c in ("sg_row", "sg_col"))
                out[there] = np.where(ground(group[there], row, col, table.column("sg_z").fill_null(0).to_numpy()[there]), GROUND, 1)
            own = table.select(schema.names)
            return own.set_column(schema.names.index(cls), cls, pa.array(out)).cast(arrow).to_batches(max_chunksize=10_000)

        held, n, enough = [], 0, BATCH
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            group = groups(table, np, pc)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from classified(table.slice(0, last), group[:last])
            # the last group may go on
            held = table.slice(last).to_batches()
            n, enough = n - last, max(BATCH, 2 * (n - last))
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from classified(table, groups(table, np, pc))

    def groups(table, np, pc):
        codes = [pc.dictionary_encode(table.column(c).chunk(0), null_encoding="encode").indices.to_numpy() for c in by]
        return np.concatenate([[0], np.cumsum(reduce(np.logical_or, [np.diff(c) != 0 for c in codes]))])

    arrow = to_arrow_schema(schema)
    return spread(cells, *by).sortWithinPartitions(*by).mapInArrow(run, schema)


def classify_ground(points: DataFrame, resolution: float = 1.0, window: int = 8, slope: float = 0.2, threshold: float = 0.45, scalar: float = 1.2, by: Sequence[str] = ("tile",), cls: str = "cls") -> DataFrame:
    """Class 2 for ground, 1 for all else, by a simple morphological filter (Pingel et al., 2013).

    The lowest point of each cell makes a surface. Openings with wider and wider windows flag cells that stand out by more than
    the slope allows; what is left, with its gaps filled from around, is the ground, and points near it are ground points.
    Openings are minima and maxima over ranges of rows and columns, so cells without points take no part. A group of up to ``WHOLE`` points is
    taken by one task, many groups at once; of larger ones, openings are made, and gaps are filled, on blocks of cells with a margin as
    wide as all windows together and one more, each by one task.
    """
    columns, kept = points.columns, list(by)
    by, points = kept or ["sg_all"], points if kept else points.withColumn("sg_all", F.lit(0))
    how = (by, resolution, window, slope, threshold, scalar, cls)
    large = written(points.groupBy(*by).agg(F.count(F.lit(1)).alias("sg_n")).where(F.col("sg_n") > WHOLE).select(*[F.col(c).alias(f"sg_{c}") for c in by]), "large-groups")
    if large.isEmpty():
        return _classified_whole(points, *how).select(*columns)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"sg_{c}")) for c in by])
    small = _classified_whole(points.join(large, same, "left_anti"), *how)
    return small.unionByName(_classified_in_blocks(points.join(large, same, "left_semi"), *how)).select(*columns)


def _classified_in_blocks(points: DataFrame, by: Sequence[str], resolution: float, window: int, slope: float, threshold: float, scalar: float, cls: str) -> DataFrame:
    cells = with_cell(points, resolution).groupBy(*by, "row", "col").agg(F.min("z").alias("low")).where("low IS NOT NULL AND NOT isnan(low)")
    dem = _opened(cells, by, window, slope * resolution).where("sg_z IS NOT NULL").select(*by, "row", "col", "sg_z")
    rise = lambda a, b: (F.lead("sg_z").over(Window.partitionBy(*by, a).orderBy(b)) - F.lag("sg_z").over(Window.partitionBy(*by, a).orderBy(b))) / (2 * resolution)
    dem = dem.withColumns({"sg_dx": rise("row", "col"), "sg_dy": rise("col", "row")})
    steep = F.sqrt(F.coalesce("sg_dx", F.lit(0.0)) ** 2 + F.coalesce("sg_dy", F.lit(0.0)) ** 2)
    out = with_cell(points, resolution).join(dem.select(*by, "row", "col", "sg_z", steep.alias("sg_steep")), [*by, "row", "col"], "left")
    is_ground = F.coalesce(F.abs(F.col("z") - F.col("sg_z")) <= F.lit(threshold) + F.col("sg_steep") * scalar, F.lit(False))
    return out.withColumn(cls, F.when(is_ground, F.lit(GROUND)).otherwise(F.lit(1)).cast(points.schema[cls].dataType)).select(*points.columns)


def on_tiles(points: DataFrame, function: Callable, schema: str, by: Sequence[str] = ("tile",), most: int = 5_000_000) -> DataFrame:
    """``function`` (pandas frame in, pandas frame of ``schema`` out) of each tile's points, for what no operator here does.

    A tile is one group, which its task holds whole, so tiles are counted first: one with more than ``most`` points is an error that
    names it. Make tiles smaller then, with a halo where the function looks around points (see ``assign_tiles``).
    """
    large = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).limit(5).collect()
    if large:
        raise ValueError(f"tiles with more than {most} points: {[tuple(r) for r in large]}")
    return points.groupBy(*by).applyInPandas(function, schema)
