"""Staging and audits: identifiers, tile indexes, reconciliation, conformance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import box_area_m2, boxes_touch, grid_square, grid_zone
from . import polygons

#: One index may lack up to this share of the other's tiles.
COMPLETE = 0.95
EXAMPLES = 8
SEVERITIES = ("blocker", "warning", "info")


def attach_ids(tiles: DataFrame, surveys: DataFrame, key: str = "workunit_id", name: str = "workunit", order: str = "ord") -> DataFrame:
    """``tiles`` with the survey's name by its id; of a repeated id the last counts. Names drift, ids do not."""
    last = surveys.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(name, order).alias(name))
    return tiles.join(last, key, "left")


def tile_footprints(tiles: DataFrame, zone: int, size: float = 1000.0, identifier: str = "grid_id") -> DataFrame:
    """``tiles`` with the box of each grid identifier; identifiers that can't be read have nulls."""
    east, north = grid_square(F.col(identifier), zone)
    return tiles.withColumns({"xmin": east, "ymin": north}).withColumns({"xmax": F.col("xmin") + size, "ymax": F.col("ymin") + size})


def zones(tiles: DataFrame, identifier: str = "grid_id") -> DataFrame:
    """(zone, south, n): the zones and hemispheres that the tiles' names say; names without one are left out."""
    zone, south = grid_zone(F.col(identifier))
    return tiles.select(zone.alias("zone"), south.alias("south")).where("zone IS NOT NULL").groupBy("zone", "south").agg(F.count(F.lit(1)).alias("n"))


def one_zone(tiles: DataFrame, identifier: str = "grid_id") -> tuple[int, bool] | None:
    """The one zone and hemisphere of all tiles (None if no name has one); several are an error, as are names decoded in another's zone."""
    found = zones(tiles, identifier).orderBy("zone", "south").limit(10).collect()
    if len(found) > 1:
        raise ValueError(f"tiles of several zones: {[(r['zone'], 'S' if r['south'] else 'N') for r in found]}")
    return (found[0]["zone"], found[0]["south"]) if found else None


def select_tiles(tiles: DataFrame, areas: DataFrame, by: Sequence[str], tile: str = "tile", resources: DataFrame | None = None, resource: str = "name", degrees: bool = False) -> DataFrame:
    """``tiles`` (box columns) that meet their area's polygon, with share, how much of the tile lies in it; with ``resources``
    only those that also meet one, whatever number. Each tile comes once."""
    shaped = tiles.withColumn("parts", polygons.box_parts(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
    # the tile is measured as the shape that is covered: all of the area's part in it, and of that what resources hold
    pieces = polygons.overlay(areas, shaped, by, tile, resources, resource, degrees)
    met = polygons.overlaps(pieces, by, "sg_id").drop("sg_first")
    if resources is not None:
        met = met.where("sg_more > 0")
    own = shaped.withColumn("sg_id", F.col(tile).cast("string")).join(met, [*by, "sg_id"])
    size = box_area_m2(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]) if degrees else (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return own.withColumn("share", F.col("sg_area") / size).select(*tiles.columns, "share")


def tiles_per_unit(tiles: DataFrame, key: str = "workunit_id") -> DataFrame:
    """Tiles of each unit; tiles without one are left out."""
    return tiles.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def site_manifest(wanted: DataFrame, surveys: DataFrame, folder: str, resolved: DataFrame | None = None, tesm: DataFrame | None = None, links: DataFrame | None = None, name: str = "workunit") -> DataFrame:
    """A row per wanted unit: its record (struct) or why there is none, its resource or why there is none, the reconciled tile
    counts, and the folder of its files.

    ``resolved`` is what ``catalog.resolve_names`` says, ``tesm`` and ``links`` are counts (name, n). An index that could not be read is
    None as a whole, and a list of links that could not be fetched a null n; neither is 0. Tiles have no status where neither
    index was asked for the unit.
    """
    own = wanted.select(name).where(F.col(name).isNotNull()).distinct()
    fields = [c for c in surveys.columns if c != name]
    records = surveys.groupBy(name).agg(F.count(F.lit(1)).alias("sg_n"), F.first(F.struct(name, *fields)).alias("record"))
    out = own.join(records, name, "left")
    out = out.withColumn("record_error", F.when(F.col("sg_n").isNull(), "no such workunit").when(F.col("sg_n") > 1, "several workunits of this name")).withColumn("record", F.when(F.col("sg_n") == 1, F.col("record"))).drop("sg_n")
    if resolved is not None:
        out = out.join(resolved.select(name, "resource", "tier"), name, "left").withColumn("resource_error", F.when(F.col("resource").isNull(), "no resource resolves to this workunit"))
    else:
        out = out.withColumns({"resource": F.lit(None).cast("string"), "tier": F.lit(None).cast("int"), "resource_error": F.lit(None).cast("string")})
    for counts, c in ((tesm, "tesm"), (links, "links")):
        if counts is None:
            out = out.withColumns({c: F.lit(None).cast("bigint"), f"sg_{c}": F.lit(False)})
        else:
            out = out.join(counts.select(name, F.col("n").cast("bigint").alias(c), F.lit(True).alias(f"sg_{c}")), name, "left")
    asked = F.coalesce("sg_tesm", F.lit(False)) | F.coalesce("sg_links", F.lit(False))
    # an index that was read and does not name the unit has no tiles of it
    known = F.lit(None).cast("bigint") if tesm is None else F.coalesce("tesm", F.lit(0))
    out = out.withColumn("tesm", F.when(asked, known)).withColumn("status", F.when(asked, reconcile(F.col("tesm"), F.col("links")))).drop("sg_tesm", "sg_links")
    return out.withColumn("files", F.concat(F.lit(folder.rstrip("/") + "/lpc_cache/"), F.col(name)))


def tiles_in_boxes(tiles: DataFrame, boxes: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """Tiles of each box, edges included: both sides are dealt to square cells, so it is an equi-join; each pair counts once."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell).cast("bigint"), F.floor(F.col(hi) / cell).cast("bigint")))
    t = tiles.withColumn("ci", cells("xmin", "xmax")).withColumn("cj", cells("ymin", "ymax"))
    b = boxes.select(*by, *[F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).withColumn("ci", cells("b_xmin", "b_xmax")).withColumn("cj", cells("b_ymin", "b_ymax"))
    own, other = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], [F.col(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    # the pair counts in the cell that holds the lower left corner of what they share
    first = (F.col("ci") == F.floor(F.greatest("xmin", "b_xmin") / cell)) & (F.col("cj") == F.floor(F.greatest("ymin", "b_ymin") / cell))
    return t.join(b, ["ci", "cj"]).where(boxes_touch(own, other) & first).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def reconcile(tesm: Column, links: Column) -> Column:
    """What two counts of tiles say of each other. Null is a source that could not be read, which is not 0."""
    return (
        F.when(tesm.isNull(), "tesm-unavailable").when(links.isNull(), "links-unavailable")
        .when((tesm == 0) & (links == 0), "no-tiles").when(tesm == 0, "tesm-missing")
        .when(tesm < links * COMPLETE, "tesm-incomplete").when(links < tesm * COMPLETE, "links-behind-tesm").otherwise("consistent")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value; nulls and empty strings are one."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def null_audit(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """A finding for each column with nulls: count, total and the first names, in one pass over the table."""
    there = [c for c in columns if c in df.columns]
    flags = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).isNull().alias("missing")) for c in there])
    long = df.select(name, F.explode(flags).alias("f")).select(name, "f.*")
    counts = long.groupBy("check").agg(F.count_if("missing").alias("count"), F.count(F.lit(1)).alias("total")).where(F.col("count") > 0)
    return counts.join(first_names(long.where("missing"), ["check"], name), "check", "left")


def first_names(df: DataFrame, by: Sequence[str], name: str, n: int = EXAMPLES) -> DataFrame:
    """The first ``n`` distinct names of each group, sorted. Spark keeps n per group and task only (a top-k window)."""
    ranked = df.select(*by, name).distinct().withColumn("sg_n", F.row_number().over(Window.partitionBy(*by).orderBy(name))).where(F.col("sg_n") <= n)
    return ranked.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("examples"))


def findings(df: DataFrame, rules: Sequence[tuple[str, str, Column]], name: str) -> DataFrame:
    """check, severity, count, total, fraction of rows that break each of ``rules`` (check, severity, Column)."""
    flags = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(s).alias("severity"), F.coalesce(x, F.lit(False)).alias("bad")) for c, s, x in rules])
    long = df.select(name, F.explode(flags).alias("f")).select(name, "f.*")
    out = long.groupBy("check", "severity").agg(F.count_if("bad").alias("count"), F.count(F.lit(1)).alias("total"))
    return out.where(F.col("count") > 0).withColumn("fraction", F.col("count") / F.col("total"))


def by_severity(found: DataFrame) -> DataFrame:
    """``found`` with place, the most severe and most frequent first, and in this order. One row per check: a constant number in one task."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(rank, F.col("count").desc(), "check"))).orderBy("place")
