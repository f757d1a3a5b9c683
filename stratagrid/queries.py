"""The library's operators applied to the test tables, each with the SQL that says the same.

Proxies: a row of lineitem is a point (an order a pulse, a line a return), an embedding an 8 x 8 raster, a customer's orders a
survey, events intensities of several sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import crs, geo, geodesic, geodesy, operations, text
from .operators import catalog, conformance, footprints, merge, points, polygons, preflight, products, raster, reports, staging, vendor
from .plans import batch
from .plans.tables import new_path, written
from .sources import geopackage, geotiff, gtx, merge_view, octree, readers
from .streaming import epochs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(value: str, digits: int) -> Column:
    """A double as SQL rounds it, halves away from zero. ``F.round`` goes by way of decimals, which takes longer than many a query."""
    scaled = F.col(value) * 10.0 ** digits
    whole = F.rint(scaled)
    # rint takes halves to the even number
    whole = whole + F.when((F.abs(scaled - whole) == 0.5) & (F.abs(whole) < F.abs(scaled)), F.signum(scaled)).otherwise(0.0)
    return F.when(F.abs(scaled) <= 1.7976931348623157e308, whole / 10.0 ** digits).otherwise(F.col(value))


# --- proxies -------------------------------------------------------------------------------------------------------------

def cloud(spark: SparkSession, sf_dir: str, returns: bool = False) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    cls = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).when(F.col("l_linestatus") == "F", 7).otherwise(18)
    cols = {"x": F.col("l_partkey") + F.col("l_discount"), "y": F.col("l_suppkey") + F.col("l_tax"), "z": F.col("l_extendedprice") / 1000, "cls": cls.cast("int"), "rn": F.col("l_linenumber"), "intensity": F.col("l_quantity"), "tile": F.floor(F.col("l_partkey") / 50).cast("bigint")}
    if returns:
        cols["nr"] = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return li.select(*[c.alias(k) for k, c in cols.items()])


PTS = """WITH p AS (SELECT l_partkey + l_discount AS x, l_suppkey + l_tax AS y, l_extendedprice / 1000 AS z,
  CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 1 WHEN l_linestatus = 'F' THEN 7 ELSE 18 END AS cls,
  l_linenumber AS rn, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS nr, l_quantity AS intensity, CAST(floor(l_partkey / 50) AS BIGINT) AS tile FROM lineitem)"""
STEP = "(SELECT unnest([-2, -1, 0, 1, 2]) AS d)"
CELLS = """, c AS (SELECT *, CAST(floor(x) AS BIGINT) + a.d AS col, CAST(floor(y) AS BIGINT) + b.d AS row FROM {src}, """ + STEP + " a, " + STEP + """ b),
n AS (SELECT *, sqrt((x - (col + 0.5)) * (x - (col + 0.5)) + (y - (row + 0.5)) * (y - (row + 0.5))) AS dist FROM c),
k AS (SELECT * FROM n WHERE dist <= 1.5)"""
IDW = "round(coalesce(avg({v}) FILTER (dist = 0{f}), sum({v} / dist) FILTER (dist > 0{f}) / nullif(sum(1 / dist) FILTER (dist > 0{f}), 0)), 6)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source"), "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("source", "label", F.floor(F.col("i") / 8).cast("bigint").alias("row"), (F.col("i") % 8).cast("bigint").alias("col"), F.col("v").cast("double").alias("value"))


IMG = """WITH e AS (SELECT vec_id AS source, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT source, label, CAST(i // 8 AS BIGINT) AS row, CAST(i % 8 AS BIGINT) AS col, CAST(v AS DOUBLE) AS value FROM e)"""


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"), F.min("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("n"), F.min("o_orderstatus").alias("st"))
    k = F.col("o_custkey")
    undated = k % 11 == 0
    return o.select((k % 25).alias("aoi"), F.concat(F.lit("WU_"), k.cast("string")).alias("workunit"), k.alias("workunit_id"), F.when(~undated, F.col("s")).alias("start"), F.when(~undated, F.col("e")).alias("end"),
                    F.concat(F.lit("QL "), (F.substring("p", 1, 1).cast("int") - 1).cast("string")).alias("ql"), (F.least("n", F.lit(40)) / 40.0).alias("overlap"),
                    F.when(k % 7 != 0, F.when(F.col("st") == "F", "Meets").otherwise("Does not meet")).alias("category"), F.when(k % 5 != 0, F.concat(F.lit("GEOID"), (k % 3).cast("string"))).alias("geoid"),
                    (k % 17).cast("double").alias("xmin"), (k % 13).cast("double").alias("ymin"), (k % 17 + 1 + k % 5).cast("double").alias("xmax"), (k % 13 + 1 + k % 4).cast("double").alias("ymax"))


SRV = """WITH o AS (SELECT o_custkey AS k, min(o_orderdate) AS s, max(o_orderdate) AS e, min(o_orderpriority) AS p, count(*) AS n, min(o_orderstatus) AS st FROM orders GROUP BY 1),
sv AS (SELECT k % 25 AS aoi, 'WU_' || k AS workunit, k AS workunit_id, CASE WHEN k % 11 <> 0 THEN s END AS start, CASE WHEN k % 11 <> 0 THEN e END AS "end",
  'QL ' || (CAST(substr(p, 1, 1) AS INT) - 1) AS ql, least(n, 40) / 40.0 AS overlap, CASE WHEN k % 7 <> 0 THEN CASE WHEN st = 'F' THEN 'Meets' ELSE 'Does not meet' END END AS category,
  CASE WHEN k % 5 <> 0 THEN 'GEOID' || (k % 3) END AS geoid, k % 17 AS xmin, k % 13 AS ymin, k % 17 + 1 + k % 5 AS xmax, k % 13 + 1 + k % 4 AS ymax FROM o),
m AS (SELECT *, coalesce(epoch_us(start) + (epoch_us("end") - epoch_us(start)) // 2, epoch_us(start), epoch_us("end")) AS mid FROM sv)"""
ANCHOR = SRV + """, a1 AS (SELECT * FROM (SELECT *, max(coalesce(category = 'Meets', false)) OVER (PARTITION BY aoi) AS anym FROM m) WHERE coalesce(category = 'Meets', false) OR NOT anym),
a2 AS (SELECT * FROM (SELECT *, max(mid IS NOT NULL) OVER (PARTITION BY aoi) AS anyd FROM a1) WHERE mid IS NOT NULL OR NOT anyd),
an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY overlap DESC NULLS LAST, "end" DESC NULLS LAST, workunit) AS rn FROM a2) WHERE rn = 1),
rel AS (SELECT m.*, m.workunit = an.workunit AS anchor, round(floor((m.mid - an.mid) / 86400000000) / 365.25, 2) AS dt_years, coalesce(m.geoid = an.geoid, false) AS same_geoid FROM m JOIN an USING (aoi))"""


def areas(spark: SparkSession) -> DataFrame:
    a = F.col("aoi")
    return spark.range(25).select(F.col("id").alias("aoi")).select("aoi", (a % 10).cast("double").alias("xmin"), (a % 7).cast("double").alias("ymin"), (a % 10 + 8).cast("double").alias("xmax"), (a % 7 + 8).cast("double").alias("ymax"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return d.withColumn("no", F.col("no").cast("bigint"))


# --- points --------------------------------------------------------------------------------------------------------------

@query(PTS + " SELECT x, y, z, CAST(cls AS INT) AS cls FROM p WHERE cls NOT IN (7, 18)")
def pts_noise_filter(spark, sf_dir):
    return points.drop_classes(cloud(spark, sf_dir), points.LOW_NOISE, points.HIGH_NOISE).select("x", "y", "z", "cls")


@query(PTS + " SELECT tile, count(*) AS n, min(z) AS low, max(z) AS high FROM p WHERE nr = 1 OR (nr > 1 AND rn = 1) GROUP BY tile")
def pts_first_only(spark, sf_dir):
    kept = cloud(spark, sf_dir, returns=True).where(points.return_group(("first", "only")))
    return kept.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))


@query(PTS + " SELECT CAST(0 AS INT) AS cls, CAST(count(*) AS BIGINT) AS n, max(z) AS high FROM p")
def pts_reset_classes(spark, sf_dir):
    return points.reset_classes(cloud(spark, sf_dir)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("high"))


@query(PTS + " SELECT x, y, z FROM p WHERE x BETWEEN 18 AND 52 AND y BETWEEN 2 AND 8")
def pts_crop(spark, sf_dir):
    return points.crop(cloud(spark, sf_dir), 20, 4, 50, 6, 2).select("x", "y", "z")


@query(PTS + " SELECT tile, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM p GROUP BY tile")
def pts_bounds(spark, sf_dir):
    return points.bounds(cloud(spark, sf_dir), ["tile"])


@query(PTS + """ SELECT x, y, z, intensity FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 4.0), floor(y / 4.0), floor(z / 4.0) ORDER BY z, x, y, intensity) AS i FROM p) WHERE i = 1""")
def pts_thin(spark, sf_dir):
    return points.thin(cloud(spark, sf_dir), 4.0, [F.col(c) for c in ("z", "x", "y", "intensity")]).select("x", "y", "z", "intensity")


@query(PTS + " SELECT CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col, max(z) AS value, count(*) AS n FROM p WHERE cls NOT IN (7, 18) GROUP BY 1, 2")
def dsm_max(spark, sf_dir):
    return points.grid_max(points.drop_classes(cloud(spark, sf_dir), 7, 18), 1.0)


@query(PTS + """, s AS (SELECT tile, avg(z) AS m, stddev_pop(z) AS sd FROM p GROUP BY tile)
SELECT CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col, max(z) AS value, count(*) AS n FROM p JOIN s USING (tile) WHERE cls NOT IN (7, 18) AND NOT coalesce((z - m) / nullif(sd, 0) > 1.2815515655446008, false) GROUP BY 1, 2""")
def dsm_zscore(spark, sf_dir):
    return points.grid_max(points.drop_classes(points.mark_high_z(cloud(spark, sf_dir), 0.9), 7, 18), 1.0)


@query(PTS + CELLS.format(src="(SELECT * FROM p WHERE cls NOT IN (7, 18))") + f" SELECT row, col, {IDW.format(v='z', f='')} AS value, count(*) AS n FROM k GROUP BY 1, 2")
def dsm_idw(spark, sf_dir):
    return points.grid_idw(points.drop_classes(cloud(spark, sf_dir), 7, 18), 1.0, 1.5).withColumn("value", F.round("value", 6))


@query(PTS + CELLS.format(src="(SELECT * FROM p WHERE cls = 2)") + f" SELECT row, col, {IDW.format(v='z', f='')} AS value, count(*) AS n FROM k GROUP BY 1, 2")
def dtm_ground(spark, sf_dir):
    return points.grid_idw(points.ground_only(cloud(spark, sf_dir)), 1.0, 1.5).withColumn("value", F.round("value", 6))


@query(PTS + CELLS.format(src="(SELECT * FROM p WHERE cls = 2)") + """, g AS (SELECT row, col, coalesce(avg(z) FILTER (dist = 0), sum(z / dist) FILTER (dist > 0) / nullif(sum(1 / dist) FILTER (dist > 0), 0)) AS value FROM k GROUP BY 1, 2),
st AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d),
f AS (SELECT row + a.d AS row, col + b.d AS col, value, 1 / pow(sqrt(a.d * a.d + b.d * b.d), 1.5) AS w FROM g, st a, st b WHERE a.d <> 0 OR b.d <> 0)
SELECT row, col, round(value, 7) AS value, false AS filled FROM g UNION ALL
SELECT row, col, round(sum(value * w) / sum(w), 7), true FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.row = f.row AND g.col = f.col) GROUP BY 1, 2""")
def dtm_fill(spark, sf_dir):
    grid = points.grid_idw_filled(points.ground_only(cloud(spark, sf_dir)), 1.0, 1.5, size=2, fill_power=1.5)
    return grid.select("row", "col", rounded("value", 7).alias("value"), "filled")


@query(PTS + CELLS.format(src="(SELECT *, cls NOT IN (7, 18) AND (nr = 1 OR rn = 1) AS s, cls = 2 AS g FROM p WHERE (cls NOT IN (7, 18) AND (nr = 1 OR rn = 1)) OR cls = 2)")
       + f" SELECT row, col, {IDW.format(v='z', f=' AND s')} AS dsm, {IDW.format(v='z', f=' AND g')} AS dtm, {IDW.format(v='intensity', f=' AND s')} AS intensity FROM k GROUP BY 1, 2")
def products_one_pass(spark, sf_dir):
    out = points.grid_products(cloud(spark, sf_dir, returns=True), points.products(), 1.0, 1.5)
    return out.select("row", "col", *[F.round(c, 6).alias(c) for c in ("dsm", "dtm", "intensity")])


@query(PTS + """, e AS (SELECT min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM p),
t AS (SELECT e.*, i, j, CAST(greatest(ceil((d - b) / 25), 1) AS BIGINT) AS nr FROM e, generate_series(0, CAST(greatest(ceil((c - a) / 25), 1) AS BIGINT) - 1) x(i), generate_series(0, CAST(greatest(ceil((d - b) / 25), 1) AS BIGINT) - 1) y(j)),
u AS (SELECT CAST(i * nr + j + 1 AS BIGINT) AS tile, floor((a + i * 25) / 2) * 2 AS x0, floor((b + j * 25) / 2) * 2 AS y0, ceil(least(a + (i + 1) * 25, c) / 2) * 2 AS x1, ceil(least(b + (j + 1) * 25, d) / 2) * 2 AS y1 FROM t)
SELECT tile, x0, y0, x1, y1, floor((x0 - 5) / 2) * 2 AS bx0, floor((y0 - 5) / 2) * 2 AS by0, ceil((x1 + 5) / 2) * 2 AS bx1, ceil((y1 + 5) / 2) * 2 AS by1 FROM u""")
def tile_grid(spark, sf_dir):
    return points.tile_lattice(points.bounds(cloud(spark, sf_dir)), 25.0, 2.0, 5.0)


@query(PTS + """, t AS (SELECT DISTINCT CAST(floor(l_partkey / 50) AS BIGINT) + k AS tile FROM lineitem, (SELECT unnest([0, 3]) AS k)), c AS (SELECT tile, count(*) AS n FROM p WHERE cls = 2 GROUP BY 1)
SELECT tile, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(n, 0) = 0 AS empty FROM t LEFT JOIN c USING (tile)""")
def tile_counts_empty(spark, sf_dir):
    pts = cloud(spark, sf_dir)
    tiles = pts.select(F.explode(F.array(F.col("tile"), F.col("tile") + 3)).alias("tile")).distinct()
    return points.tile_counts(tiles, points.ground_only(pts).groupBy("tile").agg(F.count(F.lit(1)).alias("n")))


@query(PTS + """, t AS (SELECT *, unnest(generate_series(CAST(floor((x - 0 + -2.5) / 20) AS BIGINT), CAST(floor((x - 0 + 2.5) / 20) AS BIGINT))) AS tile_col FROM p),
u AS (SELECT *, unnest(generate_series(CAST(floor((y - 0 + -2.5) / 20) AS BIGINT), CAST(floor((y - 0 + 2.5) / 20) AS BIGINT))) AS tile_row FROM t) SELECT tile_col, tile_row, count(*) AS n, max(z) AS high FROM u GROUP BY 1, 2""")
def pts_tile_halo(spark, sf_dir):
    return points.to_tiles(cloud(spark, sf_dir), 20.0, 2.5).groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("high"))


@query(PTS + """, u AS (SELECT DISTINCT tile, x, y FROM p), g AS (SELECT tile, x AS gx, y AS gy, z AS gz FROM p WHERE cls = 2),
b AS (SELECT tile, x, y, min(struct_pack(d2 := (x - gx) * (x - gx) + (y - gy) * (y - gy), gz := gz)) AS best FROM u JOIN g USING (tile) GROUP BY 1, 2, 3)
SELECT x, y, z, round(z - best.gz, 6) AS hag FROM p LEFT JOIN b USING (tile, x, y)""")
def hag_nearest(spark, sf_dir):
    return points.height_above_ground(cloud(spark, sf_dir).select("x", "y", "z", "cls", "tile")).select("x", "y", "z", F.round("hag", 6).alias("hag"))


@query(PTS + """, u AS (SELECT DISTINCT tile, x, y FROM p), g AS (SELECT tile, x AS gx, y AS gy, z AS gz FROM p WHERE cls = 2),
b AS (SELECT tile, x, y, min(struct_pack(d2 := (x - gx) * (x - gx) + (y - gy) * (y - gy), gz := gz)) AS best FROM u JOIN g USING (tile) GROUP BY 1, 2, 3),
h AS (SELECT p.*, coalesce(z - best.gz > 12, false) AS high FROM p LEFT JOIN b USING (tile, x, y))
SELECT CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col, max(z) AS value, count(*) AS n FROM h WHERE NOT high AND cls NOT IN (7, 11, 18) GROUP BY 1, 2""")
def dsm_hag(spark, sf_dir):
    marked = points.mark_high(points.height_above_ground(cloud(spark, sf_dir).select("x", "y", "z", "cls", "tile")), 12.0)
    return points.grid_max(points.drop_classes(marked, points.LOW_NOISE, points.HIGH_NOISE, points.ROAD), 1.0)


# --- rasters -------------------------------------------------------------------------------------------------------------

@query(IMG + " SELECT row, col, arg_max(value, source) AS value, max(source) AS \"from\" FROM r WHERE label <> 0 OR value > 0 GROUP BY 1, 2")
def raster_mosaic_last(spark, sf_dir):
    img = images(spark, sf_dir).withColumn("value", F.when((F.col("label") != 0) | (F.col("value") > 0), F.col("value")))
    return raster.mosaic(img, "source")


@query(IMG + " SELECT row, col, arg_min(value, source) AS value, min(source) AS \"from\" FROM r WHERE value > 0 GROUP BY 1, 2")
def merge_first_wins(spark, sf_dir):
    return raster.mosaic(images(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0, F.col("value"))), "source", last_wins=False)


@query(IMG + " SELECT part, row, col FROM (SELECT CAST(source % 150 AS BIGINT) AS part, row, col, count(DISTINCT source) AS n FROM r WHERE value > -0.1 GROUP BY 1, 2, 3) JOIN (SELECT CAST(vec_id % 150 AS BIGINT) AS part, count(*) AS n FROM embeddings GROUP BY 1) USING (part, n)")
def common_mask(spark, sf_dir):
    img = images(spark, sf_dir).withColumn("value", F.when(F.col("value") > -0.1, F.col("value"))).withColumn("part", F.col("source") % 150)
    return raster.common_cells(img, by=["part"])


@query(IMG + """ SELECT a.label, round(quantile_cont(a.value - b.value, 0.5), 6) AS median, count(*) AS n FROM r a JOIN r b ON a.row = b.row AND a.col = b.col AND b.source = 0 AND a.source <> 0 GROUP BY 1""")
def masked_median(spark, sf_dir):
    img = images(spark, sf_dir)
    base = img.where("source = 0").select("row", "col", F.col("value"))
    return raster.masked_median(img.where("source != 0"), base, by=["label"]).select("label", F.round("median", 6).alias("median"), "n")


@query(IMG + """, d AS (SELECT a.source, quantile_cont(a.value * 40 - b.value * 40, 0.5) AS m, count(*) AS n FROM r a JOIN r b ON a.row = b.row AND a.col = b.col AND b.source = 0 WHERE a.row <> a.source % 8 GROUP BY 1)
SELECT source, CASE WHEN n >= 50 AND abs(m) <= 3 THEN 'true' WHEN n >= 50 AND abs(m - 5) <= 3 THEN 'false' ELSE 'error' END AS shift FROM d""")
def datum_state(spark, sf_dir):
    img = images(spark, sf_dir).withColumn("value", F.col("value") * 40)
    base, own = img.where("source = 0").select("row", "col", "value"), img.where("row != source % 8")
    d = raster.masked_median(own, base, by=["source"])
    return d.select("source", raster.datum_state(F.col("median"), F.col("n"), F.lit(5.0), least=50).alias("shift"))


@query(IMG + " SELECT source, CAST(f AS INT) AS level, CAST(row // f AS BIGINT) AS row, CAST(col // f AS BIGINT) AS col, round(avg(value), 6) AS value, count(*) AS n FROM r, (SELECT unnest([2, 4, 8]) AS f) WHERE value > -0.2 GROUP BY ALL")
def overview_avg(spark, sf_dir):
    img = images(spark, sf_dir).withColumn("value", F.when(F.col("value") > -0.2, F.col("value")))
    return raster.overviews(img, (2, 4, 8)).withColumn("value", F.round("value", 6))


@query(IMG + " SELECT source, CAST(floor(row / 1.6) AS BIGINT) AS row, CAST(floor(col / 1.6) AS BIGINT) AS col, round(avg(value), 6) AS value FROM r GROUP BY 1, 2, 3")
def decimated_mean(spark, sf_dir):
    return raster.decimated(images(spark, sf_dir), 8, 8, 5).withColumn("value", F.round("value", 6))


@query(IMG + " SELECT source, CAST(row // 3 AS BIGINT) AS row, CAST(col // 3 AS BIGINT) AS col, value FROM r WHERE row % 3 = 0 AND col % 3 = 0 AND row < 6 AND col < 6")
def decimated_pick(spark, sf_dir):
    return raster.strided(images(spark, sf_dir), 8, 8, 3).select("source", "row", "col", "value")


@query(IMG + """, g AS (SELECT source, row, col,
  CASE WHEN lag(value) OVER x IS NULL THEN lead(value) OVER x - value WHEN lead(value) OVER x IS NULL THEN value - lag(value) OVER x ELSE (lead(value) OVER x - lag(value) OVER x) / 2 END AS gx,
  CASE WHEN lag(value) OVER y IS NULL THEN lead(value) OVER y - value WHEN lead(value) OVER y IS NULL THEN value - lag(value) OVER y ELSE (lead(value) OVER y - lag(value) OVER y) / 2 END AS gy
  FROM r WINDOW x AS (PARTITION BY source, row ORDER BY col), y AS (PARTITION BY source, col ORDER BY row))
SELECT source, row, col, round(least(greatest(sin(pi() / 4) * sin(pi() / 2 - atan(sqrt(gx * gx + gy * gy))) + cos(pi() / 4) * cos(pi() / 2 - atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - pi() / 2 - atan2(-gx, gy)), 0), 1), 6) AS shade FROM g""")
def hillshade(spark, sf_dir):
    return raster.hillshade(images(spark, sf_dir), 1.0, 1.0).withColumn("shade", F.round("shade", 6))


@query(IMG + """, t AS (SELECT i AS row, j AS col, (i + 0.5) / 2 - 0.5 AS sr, (j + 0.5) / 2 - 0.5 AS sc FROM range(16) a(i), range(16) b(j)),
w AS (SELECT t.row, t.col, CAST(floor(sr) AS BIGINT) + a AS srow, CAST(floor(sc) AS BIGINT) + b AS scol, (1 - abs(sr - (floor(sr) + a))) * (1 - abs(sc - (floor(sc) + b))) AS w FROM t, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
SELECT r.source, w.row, w.col, round(sum(r.value * w) / sum(w), 6) AS value FROM w JOIN r ON r.row = w.srow AND r.col = w.scol WHERE w > 0 GROUP BY ALL""")
def warp_bilinear(spark, sf_dir):
    t = spark.range(256).select(F.floor(F.col("id") / 16).cast("bigint").alias("row"), (F.col("id") % 16).alias("col"))
    out = raster.warp(images(spark, sf_dir), t, (F.col("row") + 0.5) / 2 - 0.5, (F.col("col") + 0.5) / 2 - 0.5)
    return out.withColumn("value", F.round("value", 6))


@query(IMG + """, t AS (SELECT i AS row, j AS col, CAST(floor((i + 0.5) * 8 / 5 - 0.5 + 0.5) AS BIGINT) AS srow, CAST(floor((j + 0.5) * 8 / 5 - 0.5 + 0.5) AS BIGINT) AS scol FROM range(5) a(i), range(5) b(j))
SELECT r.source, t.row, t.col, r.value + 10 AS value FROM t JOIN r ON r.row = srow AND r.col = scol""")
def warp_nearest_shifted(spark, sf_dir):
    t = spark.range(25).select(F.floor(F.col("id") / 5).cast("bigint").alias("row"), (F.col("id") % 5).alias("col"))
    return raster.warp(images(spark, sf_dir), t, (F.col("row") + 0.5) * 8 / 5 - 0.5, (F.col("col") + 0.5) * 8 / 5 - 0.5, "nearest", shift=F.lit(10.0))


_K = {"cubic": "CASE WHEN {x} <= 1 THEN 1.5 * {x} * {x} * {x} - 2.5 * {x} * {x} + 1 WHEN {x} < 2 THEN -0.5 * {x} * {x} * {x} + 2.5 * {x} * {x} - 4 * {x} + 2 ELSE 0 END",
      "spline": "CASE WHEN {x} <= 1 THEN {x} * {x} * {x} / 2 - {x} * {x} + 2.0 / 3 WHEN {x} < 2 THEN (2 - {x}) * (2 - {x}) * (2 - {x}) / 6 ELSE 0 END"}


@query(IMG + """, t AS (SELECT i AS row, j AS col, (i + 0.5) / 1.6 - 0.5 AS sr, (j + 0.5) / 1.6 - 0.5 AS sc FROM range(13) a(i), range(13) b(j)),
w AS (SELECT t.row, t.col, CAST(floor(sr) AS BIGINT) + a AS srow, CAST(floor(sc) AS BIGINT) + b AS scol, abs(sr - (floor(sr) + a)) AS u, abs(sc - (floor(sc) + b)) AS v FROM t, (SELECT unnest([-1, 0, 1, 2]) AS a), (SELECT unnest([-1, 0, 1, 2]) AS b)),
k AS (SELECT row, col, srow, scol, """ + f"({_K['cubic'].format(x='u')}) * ({_K['cubic'].format(x='v')}) AS c, ({_K['spline'].format(x='u')}) * ({_K['spline'].format(x='v')}) AS s" + """ FROM w)
SELECT r.source, k.row, k.col, round(sum(r.value * c) / sum(c), 6) AS cubic, round(sum(r.value * s) / sum(s), 6) AS cubic_spline FROM k JOIN r ON r.row = k.srow AND r.col = k.scol GROUP BY ALL""")
def warp_cubic(spark, sf_dir):
    t = spark.range(169).select(F.floor(F.col("id") / 13).cast("bigint").alias("row"), (F.col("id") % 13).alias("col"))
    own = lambda kind: raster.warp(images(spark, sf_dir), t, (F.col("row") + 0.5) / 1.6 - 0.5, (F.col("col") + 0.5) / 1.6 - 0.5, kind).withColumnRenamed("value", kind)
    return own("cubic").join(own("cubic_spline"), ["source", "row", "col"]).select("source", "row", "col", F.round("cubic", 6).alias("cubic"), F.round("cubic_spline", 6).alias("cubic_spline"))


@query(IMG + """, m AS (SELECT label, row, col, arg_max(value, source) AS value FROM r WHERE value > -0.1 GROUP BY 1, 2, 3),
w AS (SELECT t.row, t.col, CAST(floor(sr) AS BIGINT) + a AS srow, CAST(floor(sc) AS BIGINT) + b AS scol, (1 - abs(sr - (floor(sr) + a))) * (1 - abs(sc - (floor(sc) + b))) AS w FROM (SELECT i AS row, j AS col, (i + 0.5) / 2 - 0.5 AS sr, (j + 0.5) / 2 - 0.5 AS sc FROM range(16) c(i), range(16) d(j)) t, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
g AS (SELECT label, w.row, w.col, sum(value * w) / sum(w) + CASE WHEN label % 2 = 0 THEN 5 ELSE 0 END AS value FROM w JOIN m ON m.row = w.srow AND m.col = w.scol WHERE w > 0 GROUP BY 1, 2, 3)
SELECT label, CAST(f AS INT) AS level, CAST(row // f AS BIGINT) AS row, CAST(col // f AS BIGINT) AS col, round(avg(value), 6) AS value, 2010.0 AS epoch FROM g, (SELECT unnest([1, 2, 4]) AS f) GROUP BY ALL""")
def finalize_chain(spark, sf_dir):
    tiles = images(spark, sf_dir).withColumn("value", F.when(F.col("value") > -0.1, F.col("value")))
    t = spark.range(256).select(F.floor(F.col("id") / 16).cast("bigint").alias("row"), (F.col("id") % 16).alias("col"))
    decisions = tiles.select("label").distinct().withColumn("state", F.when(F.col("label") % 2 == 0, "true").otherwise("false"))
    out = products.finalize(tiles, t, (F.col("row") + 0.5) / 2 - 0.5, (F.col("col") + 0.5) / 2 - 0.5, ["label"], "source", decisions, F.lit(5.0), levels=(2, 4))
    return out.withColumn("value", F.round("value", 6))


@query(IMG + """, p AS (SELECT source % 60 AS project, CASE WHEN source % 7 = 0 THEN 'dtm_fill' WHEN source % 7 < 3 THEN 'dtm' WHEN source % 7 < 5 THEN 'dsm' ELSE 'intensity' END AS product, value FROM r),
s AS (SELECT project, product, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, count(*) AS n FROM p GROUP BY 1, 2), k AS (SELECT * FROM s WHERE product <> 'dtm' OR project NOT IN (SELECT project FROM s WHERE product = 'dtm_fill'))
SELECT CAST(project AS BIGINT) AS project, product, n, round(CASE WHEN product = 'intensity' THEN lo ELSE min(lo) FILTER (product <> 'intensity') OVER (PARTITION BY project) END, 6) AS clim_lo, round(CASE WHEN product = 'intensity' THEN hi ELSE max(hi) FILTER (product <> 'intensity') OVER (PARTITION BY project) END, 6) AS clim_hi FROM k""")
def preview_panels(spark, sf_dir):
    k = F.col("source") % 7
    own = images(spark, sf_dir).select((F.col("source") % 60).alias("project"), F.when(k == 0, "dtm_fill").when(k < 3, "dtm").when(k < 5, "dsm").otherwise("intensity").alias("product"), "value")
    return products.preview(own).select("project", "product", "n", F.round("clim_lo", 6).alias("clim_lo"), F.round("clim_hi", 6).alias("clim_hi"))


@query(IMG + """, v AS (SELECT DISTINCT source, row, col FROM r WHERE value > 0), s AS (SELECT source, row AS r0, col AS c0, row AS r1, col + 1 AS c1 FROM v UNION ALL SELECT source, row + 1, col, row + 1, col + 1 FROM v UNION ALL SELECT source, row, col, row + 1, col FROM v UNION ALL SELECT source, row, col + 1, row + 1, col + 1 FROM v)
SELECT source, r0, c0, r1, c1 FROM s GROUP BY ALL HAVING count(*) = 1""")
def footprint_edges(spark, sf_dir):
    return raster.footprint_edges(images(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0, F.col("value"))))


@query(IMG + " SELECT source, round(quantile_cont(value, 0.02), 6) AS lo, round(quantile_cont(value, 0.98), 6) AS hi, count(*) AS n FROM r GROUP BY 1")
def stretch_params(spark, sf_dir):
    return raster.stretch(images(spark, sf_dir)).select("source", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


DN = """WITH v AS (SELECT event_type AS source, user_id AS row, CAST(datediff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS col, avg(value) AS value FROM events GROUP BY ALL)"""


def intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("row"), day.alias("col")).agg(F.avg("value").alias("value"))


@query(DN + """, b AS (SELECT a.source, a.value AS x, f.value AS y FROM v a JOIN v f USING (row, col) WHERE f.source = (SELECT min(event_type) FROM events) AND a.source <> f.source),
q AS (SELECT source, count(*) AS n, quantile_cont(x, [""" + ", ".join(str(q) for q in merge.QUANTILES) + "]) AS xs, quantile_cont(y, [" + ", ".join(str(q) for q in merge.QUANTILES) + """]) AS ys FROM b GROUP BY 1),
u AS (SELECT source, n, unnest(xs) AS x, unnest(ys) AS y FROM q) SELECT source, n, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM u GROUP BY 1, 2""")
def overlap_fit(spark, sf_dir):
    v = intensities(spark, sf_dir)
    first = v.agg(F.min("source").alias("first"))
    base = v.join(F.broadcast(first), F.col("source") == F.col("first")).select("row", "col", "value")
    others = v.join(F.broadcast(first), F.col("source") != F.col("first")).drop("first")
    fit = merge.overlap_fit(base, others, by=["source"])
    return fit.select("source", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query(DN + " SELECT source, row, col, round(least(greatest(value * 600 + 500, 1000), 60000), 4) AS value FROM v")
def intensity_clamp(spark, sf_dir):
    return intensities(spark, sf_dir).withColumn("value", F.round(merge.clamped_line(F.col("value"), F.lit(600.0), F.lit(500.0)), 4))


@query("SELECT event_type AS source, avg(CAST(value = 10 AS INT)) AS saturated FROM (SELECT event_type, round(least(value, 10), 3) AS value FROM events) GROUP BY 1")
def saturated_share(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.round(F.least("value", F.lit(10.0)), 3).alias("value"))
    return merge.saturated_share(e, 10.0)


def _merge_sql(sources: int = 5, least: int = 100) -> str:
    qs = "[" + ", ".join(str(q) for q in merge.QUANTILES) + "]"
    steps = ["w AS (SELECT *, dense_rank() OVER (ORDER BY source) AS k FROM v)",
             "r AS (SELECT k, CASE WHEN hi > lo THEN lo ELSE least END AS lo, CASE WHEN hi > lo THEN hi ELSE least + 1 END AS hi FROM (SELECT k, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, min(value) AS least FROM w GROUP BY 1))",
             "st AS (SELECT k, 59000 / (hi - lo) AS gain, 1000 - 59000 / (hi - lo) * lo AS shift FROM r)",
             "c1 AS (SELECT row, col, value * gain + shift AS value FROM w JOIN st USING (k) WHERE k = 1)"]
    for k in range(2, sources + 1):
        steps += [f"q{k} AS (SELECT count(*) AS n, quantile_cont(w.value, {qs}) AS xs, quantile_cont(c.value, {qs}) AS ys FROM w JOIN c{k - 1} c USING (row, col) WHERE k = {k})",
                  f"f{k} AS (SELECT n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS shift FROM (SELECT n, unnest(xs) AS x, unnest(ys) AS y FROM q{k}) GROUP BY n)",
                  f"p{k} AS (SELECT CASE WHEN n >= {least} AND slope > 0 THEN slope ELSE gain END AS gain, CASE WHEN n >= {least} AND slope > 0 THEN f.shift ELSE st.shift END AS shift FROM st LEFT JOIN f{k} f ON true WHERE k = {k})",
                  f"c{k} AS (SELECT row, col, value FROM c{k - 1} UNION ALL SELECT row, col, value * gain + shift FROM w, p{k} WHERE k = {k} AND NOT EXISTS (SELECT 1 FROM c{k - 1} c WHERE c.row = w.row AND c.col = w.col))"]
    return DN + ", " + ", ".join(steps) + f" SELECT row, col, round(least(greatest(value, 1000), 60000), 3) AS value FROM c{sources}"


@query(_merge_sql())
def merge_normalized(spark, sf_dir):
    v = intensities(spark, sf_dir)
    order = sorted(r[0] for r in v.select("source").distinct().collect())
    return merge.normalize(v, order, min_overlap=100)[1].withColumn("value", F.round("value", 3))


# --- catalog -------------------------------------------------------------------------------------------------------------

DRIFT = "CASE {k} % 5 WHEN 0 THEN {n} WHEN 1 THEN lower({n}) WHEN 2 THEN 'USGS_LPC_' || {n} || '_LAS_2019' WHEN 3 THEN 'USGS_LPC_' || replace({n}, '_', '-') ELSE 'other' || {k} END"


@query("""WITH s AS (SELECT replace(c_name, '#', '_') AS workunit FROM customer), e AS (SELECT """ + DRIFT.format(k="c_custkey", n="replace(c_name, '#', '_')") + """ AS name, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 100 END AS n FROM customer
  UNION ALL SELECT lower(replace(c_name, '#', '-')), 500 FROM customer WHERE c_custkey % 3 = 0),
e2 AS (SELECT name, max(coalesce(n, 0)) AS n FROM e GROUP BY 1),
f AS (SELECT workunit, unnest([1, 2, 3, 4]) AS tier FROM s), g AS (SELECT name, n, unnest([1, 2, 3, 4]) AS tier FROM e2),
ks AS (SELECT workunit, tier, CASE tier WHEN 1 THEN workunit WHEN 2 THEN lower(workunit) WHEN 3 THEN lower(regexp_replace(regexp_replace(workunit, '^USGS_LPC_', ''), '_LAS_[0-9]{4}$', '')) ELSE lower(replace(regexp_replace(regexp_replace(workunit, '^USGS_LPC_', ''), '_LAS_[0-9]{4}$', ''), '-', '_')) END AS key FROM f),
ke AS (SELECT name, n, tier, CASE tier WHEN 1 THEN name WHEN 2 THEN lower(name) WHEN 3 THEN lower(regexp_replace(regexp_replace(name, '^USGS_LPC_', ''), '_LAS_[0-9]{4}$', '')) ELSE lower(replace(regexp_replace(regexp_replace(name, '^USGS_LPC_', ''), '_LAS_[0-9]{4}$', ''), '-', '_')) END AS key FROM g),
h AS (SELECT workunit, tier, name, n, row_number() OVER (PARTITION BY workunit ORDER BY tier, n DESC, name) AS i FROM ks JOIN ke USING (tier, key)) SELECT workunit, tier, name AS resource FROM h WHERE i = 1""")
def ept_resolve(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("_")).alias("workunit"))
    k, n = F.col("c_custkey"), F.col("workunit")
    wrapped = lambda x: F.concat(F.lit("USGS_LPC_"), x)
    name = F.when(k % 5 == 0, n).when(k % 5 == 1, F.lower(n)).when(k % 5 == 2, F.concat(wrapped(n), F.lit("_LAS_2019"))).when(k % 5 == 3, wrapped(F.translate(n, "_", "-"))).otherwise(F.concat(F.lit("other"), k.cast("string")))
    ept = c.select(name.alias("name"), F.when(k % 13 != 0, k % 100).alias("count")).unionByName(c.where(k % 3 == 0).select(F.lower(F.translate(n, "_", "-")).alias("name"), F.lit(500).cast("bigint").alias("count")))
    return catalog.resolve_names(c, ept).select("workunit", "tier", "resource")


@query(ANCHOR + " SELECT aoi, workunit, anchor, dt_years, same_geoid FROM rel")
def anchor_metrics(spark, sf_dir):
    return catalog.relative_metrics(surveys(spark, sf_dir), ["aoi"]).select("aoi", "workunit", "anchor", "dt_years", "same_geoid")


@query(ANCHOR + " SELECT aoi, workunit FROM an")
def pick_anchor(spark, sf_dir):
    return catalog.pick_anchor(surveys(spark, sf_dir), ["aoi"]).select("aoi", "workunit")


@query(ANCHOR + """ SELECT aoi, workunit, CAST(row_number() OVER (PARTITION BY aoi ORDER BY anchor DESC, NOT coalesce(category = 'Meets', false), coalesce(TRY_CAST(nullif(regexp_extract(ql, '^QL ([0-3])$', 1), '') AS INT), 9), coalesce(abs(dt_years), 999), overlap DESC NULLS LAST, workunit) AS INT) AS priority FROM rel""")
def rank_surveys(spark, sf_dir):
    related = catalog.relative_metrics(surveys(spark, sf_dir), ["aoi"])
    return catalog.rank_collections(related, ["aoi"]).select("aoi", "workunit", "priority")


@query(SRV + """ SELECT aoi, workunit, CAST(row_number() OVER (PARTITION BY aoi ORDER BY ql NULLS LAST, "end" DESC NULLS LAST, workunit) AS INT) AS place FROM m""")
def survey_order(spark, sf_dir):
    return catalog.survey_places(surveys(spark, sf_dir), ["aoi"]).select("aoi", "workunit", "place")


@query(SRV + """, c AS (SELECT *, count(*) OVER (PARTITION BY aoi) AS n_candidates, max("end" IS NOT NULL) OVER (PARTITION BY aoi) AS anyd FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY "end" DESC NULLS LAST, overlap DESC NULLS LAST, workunit) AS i FROM c WHERE "end" IS NOT NULL OR NOT anyd) SELECT aoi, workunit, n_candidates, "end" IS NULL AS undated FROM d WHERE i = 1""")
def latest_survey(spark, sf_dir):
    return catalog.select_latest(surveys(spark, sf_dir), ["aoi"]).select("aoi", "workunit", "n_candidates", "undated")


EPOCHS = SRV + """, l AS (SELECT *, CASE WHEN mid IS NOT NULL THEN coalesce(CAST(floor((mid - lag(mid) OVER w) / 86400000000) > 5 AS INT), 1) END AS fresh FROM m WINDOW w AS (PARTITION BY aoi, mid IS NULL ORDER BY mid, workunit)),
n AS (SELECT *, CASE WHEN mid IS NOT NULL THEN sum(fresh) OVER (PARTITION BY aoi, mid IS NULL ORDER BY mid, workunit) END AS epoch_no FROM l),
y AS (SELECT *, min(year(make_timestamp(mid))) OVER (PARTITION BY aoi, epoch_no) AS y0, max(year(make_timestamp(mid))) OVER (PARTITION BY aoi, epoch_no) AS y1 FROM n),
ep AS (SELECT *, CASE WHEN epoch_no IS NULL THEN 'undated' WHEN y0 = y1 THEN CAST(y0 AS VARCHAR) ELSE y0 || '-' || y1 END AS epoch FROM y)"""


@query(EPOCHS + " SELECT aoi, workunit, CAST(epoch_no AS BIGINT) AS epoch_no, epoch FROM ep")
def epoch_clusters(spark, sf_dir):
    return catalog.assign_epochs(surveys(spark, sf_dir), ["aoi"], ["workunit"], gap_days=5).select("aoi", "workunit", "epoch_no", "epoch")


@query("""WITH l AS (SELECT user_id, event_id, ts, coalesce(CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 86400000000) > 0 AS INT), 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM l) SELECT user_id, CAST(no AS BIGINT) AS epoch_no, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY 1, 2""")
def epoch_clusters_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("start"), F.col("ts").alias("end"))
    return catalog.assign_epochs(e, ["user_id"], ["event_id"], gap_days=0).groupBy("user_id", "epoch_no").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_ts"), F.max("end").alias("last_ts"))


AREA = ", ar AS (SELECT i AS aoi, i % 10 AS ax0, i % 7 AS ay0, i % 10 + 8 AS ax1, i % 7 + 8 AS ay1 FROM range(25) t(i))"


@query(SRV + AREA + " SELECT aoi, workunit, greatest(least(xmax, ax1) - greatest(xmin, ax0), 0) * greatest(least(ymax, ay1) - greatest(ymin, ay0), 0) / 64.0 AS share FROM m JOIN ar USING (aoi) WHERE xmin <= ax1 AND ax0 <= xmax AND ymin <= ay1 AND ay0 <= ymax")
def coverage_boxes(spark, sf_dir):
    return catalog.coverage(surveys(spark, sf_dir), areas(spark), ["aoi"]).select("aoi", "workunit", "share")


@query(SRV + AREA + """, u AS (SELECT aoi, ax0 + i AS x, ay0 + j AS y FROM ar, range(8) a(i), range(8) b(j))
SELECT aoi, count(*) FILTER (EXISTS (SELECT 1 FROM m WHERE m.aoi = u.aoi AND m.xmin <= u.x AND m.xmax >= u.x + 1 AND m.ymin <= u.y AND m.ymax >= u.y + 1)) / 64.0 AS covered_frac FROM u GROUP BY aoi""")
def union_coverage(spark, sf_dir):
    return catalog.union_coverage(surveys(spark, sf_dir), areas(spark), ["aoi"])


@query("""WITH RECURSIVE """ + SRV[5:] + AREA + """, u AS (SELECT aoi, ax0 + i AS x, ay0 + j AS y FROM ar, range(8) a(i), range(8) b(j)),
g AS (SELECT aoi, x, y, x * 100 + y AS id FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.aoi = u.aoi AND m.xmin <= u.x AND m.xmin + 1 + m.workunit_id % 2 >= u.x + 1 AND m.ymin <= u.y AND m.ymin + 1 >= u.y + 1)),
c AS (SELECT aoi, x, y, id FROM g UNION SELECT g.aoi, g.x, g.y, c.id FROM c JOIN g ON g.aoi = c.aoi AND abs(g.x - c.x) + abs(g.y - c.y) = 1),
l AS (SELECT aoi, x, y, min(id) AS part FROM c GROUP BY 1, 2, 3)
SELECT aoi, count(*) / 64.0 AS gap_frac, CAST(min(x) AS DOUBLE) AS xmin, CAST(min(y) AS DOUBLE) AS ymin, CAST(max(x) + 1 AS DOUBLE) AS xmax, CAST(max(y) + 1 AS DOUBLE) AS ymax FROM l GROUP BY aoi, part""")
def gap_boxes(spark, sf_dir):
    small = surveys(spark, sf_dir).withColumns({"xmax": F.col("xmin") + 1 + F.col("workunit_id") % 2, "ymax": F.col("ymin") + 1})
    return catalog.coverage_gaps(small, areas(spark), ["aoi"]).select("aoi", F.round("gap_frac", 6).alias("gap_frac"), "xmin", "ymin", "xmax", "ymax")


@query(ANCHOR + """, l AS (SELECT *, CASE WHEN mid IS NOT NULL THEN coalesce(CAST(floor((mid - lag(mid) OVER w) / 86400000000) > 5 AS INT), 1) END AS fresh FROM rel WINDOW w AS (PARTITION BY aoi, mid IS NULL ORDER BY mid, workunit)),
n AS (SELECT *, CASE WHEN mid IS NOT NULL THEN sum(fresh) OVER (PARTITION BY aoi, mid IS NULL ORDER BY mid, workunit) END AS epoch_no FROM l),
y AS (SELECT *, min(year(make_timestamp(mid))) OVER (PARTITION BY aoi, epoch_no) AS y0, max(year(make_timestamp(mid))) OVER (PARTITION BY aoi, epoch_no) AS y1 FROM n),
ep AS (SELECT *, CASE WHEN epoch_no IS NULL THEN 'undated' WHEN y0 = y1 THEN CAST(y0 AS VARCHAR) ELSE y0 || '-' || y1 END AS epoch FROM y),
g AS (SELECT aoi, epoch, count(*) AS n, min(abs(dt_years)) AS least_dt, bool_or(anchor) AS has_anchor FROM ep WHERE overlap >= 0.2 GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY aoi ORDER BY has_anchor DESC NULLS LAST, least_dt NULLS LAST, epoch) AS INT) AS place FROM g""")
def epoch_summary(spark, sf_dir):
    related = catalog.relative_metrics(surveys(spark, sf_dir), ["aoi"])
    kept, _ = catalog.min_overlap(catalog.assign_epochs(related, ["aoi"], ["workunit"], gap_days=5), 0.2)
    return catalog.epoch_summary(kept, ["aoi"])


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveys as polygons: boxes without their north-eastern degree, every sixth with a second part."""
    k, x, y = F.col("workunit_id"), F.col("xmin"), F.col("ymin")
    w, h = 1 + k % 3, 1 + k % 2
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    notched = F.array(point(x, y), point(x + w, y), point(x + w, y + h - 1), point(x + w - 1, y + h - 1), point(x + w - 1, y + h), point(x, y + h))
    first = F.when((w > 1) & (h > 1), F.array(F.array(notched))).otherwise(polygons.box_parts(x, y, x + w, y + h))
    return surveys(spark, sf_dir).withColumn("parts", F.when(k % 6 == 0, F.concat(first, polygons.box_parts(x + 6, y, x + 7, y + 1))).otherwise(first))


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources: suppliers as boxes of 3 x 3 degrees with a hole in the middle."""
    k = F.col("s_suppkey")
    x, y = (k * 5 % 19).cast("double"), (k * 3 % 14).cast("double")
    ring = F.concat(polygons.box_parts(x, y, x + 3, y + 3)[0], polygons.box_parts(x + 1, y + 1, x + 2, y + 2)[0])
    return read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.array(ring).alias("parts"))


#: Squares of one degree of each area, with their true size but for a constant.
DEGREES = SRV + AREA + """, k AS (SELECT sqrt((1 / 298.257223563) * (2 - 1 / 298.257223563)) AS e),
q AS (SELECT y, (SELECT (1 - e * e) * (s / (1 - e * e * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) FROM k) AS q FROM (SELECT y, sin(radians(y)) AS s FROM range(30) t(y))),
u AS (SELECT aoi, ax0 + i AS x, ay0 + j AS y, b.q - a.q AS size FROM ar, range(8) c(i), range(8) d(j), q a, q b WHERE a.y = ay0 + j AND b.y = ay0 + j + 1),
sc AS (SELECT DISTINCT m.aoi, workunit, u.x, u.y, size FROM m JOIN u ON m.aoi = u.aoi AND ((u.x >= xmin AND u.x < xmin + 1 + workunit_id % 3 AND u.y >= ymin AND u.y < ymin + 1 + workunit_id % 2
  AND NOT (workunit_id % 3 > 0 AND workunit_id % 2 > 0 AND u.x = xmin + workunit_id % 3 AND u.y = ymin + workunit_id % 2)) OR (workunit_id % 6 = 0 AND u.x = xmin + 6 AND u.y = ymin))),
tot AS (SELECT aoi, sum(size) AS total FROM u GROUP BY 1),
rc AS (SELECT s_name AS name, s_suppkey * 5 % 19 + i AS x, s_suppkey * 3 % 14 + j AS y FROM supplier, range(3) a(i), range(3) b(j) WHERE NOT (i = 1 AND j = 1))"""


@query(DEGREES + " SELECT aoi, workunit, round(sum(size) / any_value(total), 6) AS aoi_overlap_frac FROM sc JOIN tot USING (aoi) GROUP BY 1, 2")
def survey_inventory(spark, sf_dir):
    own = shapes(spark, sf_dir)
    pieces = polygons.overlay(_square_areas(spark), own, ["aoi"])
    found = polygons.inventory(pieces, own, ["aoi"], resources=False)
    return found.select("aoi", "workunit", F.round("aoi_overlap_frac", 6).alias("aoi_overlap_frac"))


@query(DEGREES + """, cv AS (SELECT *, EXISTS (SELECT 1 FROM rc WHERE rc.x = sc.x AND rc.y = sc.y) AS held FROM sc), nm AS (SELECT aoi, workunit, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM sc JOIN rc USING (x, y) GROUP BY 1, 2)
SELECT aoi, workunit, coalesce(any_value(names), '') AS ept_names, round(coalesce(sum(size) FILTER (held), 0) / sum(size), 6) AS ept_coverage_frac FROM cv LEFT JOIN nm USING (aoi, workunit) GROUP BY 1, 2""")
def ept_coverage(spark, sf_dir):
    own = shapes(spark, sf_dir)
    pieces = polygons.overlay(_square_areas(spark), own, ["aoi"], resources=builds(spark, sf_dir))
    found = polygons.inventory(pieces, own, ["aoi"], joined=",")
    return found.select("aoi", "workunit", "ept_names", F.round("ept_coverage_frac", 6).alias("ept_coverage_frac"))


def _square_areas(spark: SparkSession) -> DataFrame:
    return areas(spark).select("aoi", polygons.box_parts(*[F.col(c) for c in catalog.BOX]).alias("parts"))


@query("WITH RECURSIVE " + DEGREES[5:] + """, g AS (SELECT aoi, x, y, size, x * 100 + y AS id FROM u WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.aoi = u.aoi AND sc.x = u.x AND sc.y = u.y)),
c AS (SELECT aoi, x, y, id FROM g UNION SELECT g.aoi, g.x, g.y, c.id FROM c JOIN g ON g.aoi = c.aoi AND abs(g.x - c.x) + abs(g.y - c.y) = 1),
l AS (SELECT aoi, x, y, min(id) AS part FROM c GROUP BY 1, 2, 3)
SELECT aoi, round(sum(size) / any_value(total), 6) AS gap_frac, CAST(min(x) AS DOUBLE) AS west, CAST(max(x) + 1 AS DOUBLE) AS east FROM l JOIN g USING (aoi, x, y) JOIN tot USING (aoi) GROUP BY aoi, part""")
def gap_polygons(spark, sf_dir):
    pieces = polygons.overlay(_square_areas(spark), shapes(spark, sf_dir), ["aoi"])
    degree = polygons.equal_area_metres()
    return polygons.gaps(pieces, ["aoi"]).select("aoi", F.round("gap_frac", 6).alias("gap_frac"), F.round(F.col("xmin") / degree, 6).alias("west"), F.round(F.col("xmax") / degree, 6).alias("east"))


# --- staging, audits, batches --------------------------------------------------------------------------------------------

@query("""WITH t AS (SELECT s_suppkey, (s_suppkey * 7) % 40 AS workunit_id FROM supplier), w AS (SELECT c_custkey % 30 AS workunit_id, arg_max(c_name, c_custkey) AS workunit FROM customer GROUP BY 1) SELECT s_suppkey, t.workunit_id, workunit FROM t LEFT JOIN w USING (workunit_id)""")
def attach_ids(spark, sf_dir):
    tiles = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 40).alias("workunit_id"))
    w = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 30).alias("workunit_id"), F.col("c_name").alias("workunit"), F.col("c_custkey").alias("ord"))
    return staging.attach_ids(tiles, w).select("s_suppkey", "workunit_id", "workunit")


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '13S' ELSE '11S' END || substr('JKLMNPQRABI', CAST(p_partkey % 11 + 1 AS INT), 1) || substr('ABCDEFGHJKLMNPQRSTUVWIO', CAST(p_partkey % 23 + 1 AS INT), 1) || lpad(CAST(p_partkey * 10 % 1000 AS VARCHAR), 3, '0') || lpad(CAST(p_partkey * 30 % 1000 AS VARCHAR), 3, '0') AS id FROM part),
b AS (SELECT *, instr('JKLMNPQR', substr(id, 4, 1)) AS c, instr('ABCDEFGHJKLMNPQRSTUV', substr(id, 5, 1)) - 1 AS r, CAST(substr(id, 6, 3) AS INT) * 100 AS e, CAST(substr(id, 9, 3) AS INT) * 100 AS n FROM t),
g AS (SELECT *, c > 0 AND r >= 0 AND substr(id, 1, 2) = '11' AS good FROM b)
SELECT p_partkey, CAST(CASE WHEN good THEN c * 100000 + e END AS DOUBLE) AS xmin, CAST(CASE WHEN good THEN r * 100000 + n + 2000000 * round((3994056 - r * 100000) / 2000000) END AS DOUBLE) AS ymin FROM g""")
def grid_id_decode(spark, sf_dir):
    k = F.col("p_partkey")
    letter = lambda s, m: F.substring(F.lit(s), k.cast("int") % m + 1, F.lit(1))
    ident = F.concat(F.when(k % 10 == 0, "13S").otherwise("11S"), letter("JKLMNPQRABI", 11), letter("ABCDEFGHJKLMNPQRSTUVWIO", 23), F.lpad((k * 10 % 1000).cast("string"), 3, "0"), F.lpad((k * 30 % 1000).cast("string"), 3, "0"))
    return staging.tile_footprints(read(spark, sf_dir, "part").select("p_partkey", ident.alias("grid_id")), 11).select("p_partkey", "xmin", "ymin")


@query("""WITH t AS (SELECT c_custkey % 500 AS xmin, c_custkey % 300 AS ymin FROM customer), b AS (SELECT s_suppkey AS id, s_suppkey * 3 % 490 AS x, s_suppkey * 5 % 290 AS y FROM supplier)
SELECT id, count(*) AS n FROM b JOIN t ON t.xmin <= b.x + 15 AND b.x <= t.xmin + 1 AND t.ymin <= b.y + 15 AND b.y <= t.ymin + 1 GROUP BY 1""")
def bbox_tile_count(spark, sf_dir):
    k = F.col("c_custkey")
    tiles = read(spark, sf_dir, "customer").select((k % 500).alias("xmin"), (k % 300).alias("ymin"), (k % 500 + 1).alias("xmax"), (k % 300 + 1).alias("ymax"))
    s = F.col("s_suppkey")
    boxes = read(spark, sf_dir, "supplier").select(s.alias("id"), (s * 3 % 490).alias("xmin"), (s * 5 % 290).alias("ymin"), (s * 3 % 490 + 15).alias("xmax"), (s * 5 % 290 + 15).alias("ymax"))
    return staging.tiles_in_boxes(tiles, boxes, ["id"], 16.0)


@query("""WITH a AS (SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), t AS (SELECT id, CASE WHEN id % 9 <> 0 THEN n END AS tesm, CASE WHEN id % 8 <> 0 THEN CASE id % 4 WHEN 0 THEN n WHEN 1 THEN n + 1 WHEN 2 THEN 0 ELSE n // 2 END END AS links FROM a)
SELECT id, CASE WHEN tesm IS NULL THEN 'tesm-unavailable' WHEN links IS NULL THEN 'links-unavailable' WHEN tesm = 0 AND links = 0 THEN 'no-tiles' WHEN tesm = 0 THEN 'tesm-missing' WHEN tesm < links * 0.95 THEN 'tesm-incomplete' WHEN links < tesm * 0.95 THEN 'links-behind-tesm' ELSE 'consistent' END AS status FROM t""")
def reconcile(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    a = read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))
    i, n = F.col("id"), F.col("n")
    links = F.when(i % 4 == 0, n).when(i % 4 == 1, n + 1).when(i % 4 == 2, 0).otherwise(F.floor(n / 2))
    return a.select("id", staging.reconcile(F.when(i % 9 != 0, n), F.when(i % 8 != 0, links)).alias("status"))


@query(SRV + """, l AS (SELECT workunit, unnest(['start', 'end', 'category', 'geoid', 'ql']) AS "check", unnest([start IS NULL, "end" IS NULL, category IS NULL, geoid IS NULL, ql IS NULL]) AS missing FROM m)
SELECT "check", count(*) FILTER (missing) AS count, count(*) AS total, array_to_string((list_sort(list(workunit) FILTER (missing)))[1:8], ',') AS examples FROM l GROUP BY 1 HAVING count(*) FILTER (missing) > 0""")
def audit_nulls(spark, sf_dir):
    return staging.null_audit(surveys(spark, sf_dir), ["start", "end", "category", "geoid", "ql", "not_there"], "workunit")


@query(SRV + " SELECT coalesce(geoid, '') AS value, count(*) AS n FROM m GROUP BY 1")
def audit_values(spark, sf_dir):
    return staging.value_counts(surveys(spark, sf_dir), "geoid")


@query(SRV + """, l AS (SELECT unnest(['low quality', 'undated', 'unknown geoid']) AS "check", unnest(['blocker', 'warning', 'info']) AS severity, unnest([coalesce(ql IN ('QL 3', 'QL 4'), false), start IS NULL, geoid IS NULL]) AS bad FROM m)
SELECT *, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'blocker' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, count DESC, "check") AS INT) AS place FROM (SELECT "check", severity, count(*) FILTER (bad) AS count, count(*) AS total, count(*) FILTER (bad) / count(*) AS fraction FROM l GROUP BY 1, 2 HAVING count(*) FILTER (bad) > 0)""")
def audit_findings(spark, sf_dir):
    rules = [("low quality", "blocker", F.col("ql").isin("QL 3", "QL 4")), ("undated", "warning", F.col("start").isNull()), ("unknown geoid", "info", F.col("geoid").isNull())]
    return staging.by_severity(staging.findings(surveys(spark, sf_dir), rules, "workunit"))


@query(DEGREES + """, tl AS (SELECT a AS aoi, x, y FROM range(25) z(a), range(18) c(x), range(15) d(y)), ar2 AS (SELECT aoi, x, y FROM u WHERE NOT (x = aoi % 10 + 2 AND y = aoi % 7 + 3))
SELECT tl.aoi, tl.x * 20 + tl.y AS tile, 1.0 AS share FROM tl JOIN ar2 USING (aoi, x, y) WHERE EXISTS (SELECT 1 FROM rc WHERE rc.x = tl.x AND rc.y = tl.y)""")
def tile_select(spark, sf_dir):
    k = F.col("id")
    tiles = spark.range(25 * 270).select((k % 25).alias("aoi"), F.floor(k / 25).alias("t")).select("aoi", (F.floor(F.col("t") / 15)).alias("xmin"), (F.col("t") % 15).alias("ymin"))
    tiles = tiles.select("aoi", (F.col("xmin") * 20 + F.col("ymin")).alias("tile"), "xmin", "ymin", (F.col("xmin") + 1).alias("xmax"), (F.col("ymin") + 1).alias("ymax"))
    hole = polygons.box_parts(F.col("xmin") + 2, F.col("ymin") + 3, F.col("xmin") + 3, F.col("ymin") + 4)
    own = areas(spark).select("aoi", F.array(F.concat(polygons.box_parts(*[F.col(c) for c in catalog.BOX])[0], hole[0])).alias("parts"))
    return staging.select_tiles(tiles, own, ["aoi"], resources=builds(spark, sf_dir)).select("aoi", "tile", F.round("share", 6).alias("share"))


@query("""WITH w AS (SELECT unnest(['WU_' || k, 'XX_' || k]) AS workunit FROM (SELECT c_custkey AS k FROM customer)), s AS (SELECT 'WU_' || o_custkey AS workunit, min(o_orderdate) AS start, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT workunit, n FROM s WHERE CAST(substr(workunit, 4) AS BIGINT) % 3 <> 0), l AS (SELECT workunit, CASE WHEN CAST(substr(workunit, 4) AS BIGINT) % 5 <> 0 THEN n + CAST(substr(workunit, 4) AS BIGINT) % 2 * 3 END AS links FROM s WHERE CAST(substr(workunit, 4) AS BIGINT) % 4 <> 0),
j AS (SELECT w.workunit, s.start, s.workunit IS NOT NULL AS known, t.workunit IS NOT NULL OR l.workunit IS NOT NULL AS asked, coalesce(t.n, 0) AS tesm, links, CASE WHEN s.workunit IS NOT NULL AND CAST(substr(w.workunit, 4) AS BIGINT) % 2 = 0 THEN lower(w.workunit) END AS resource FROM w LEFT JOIN s USING (workunit) LEFT JOIN t USING (workunit) LEFT JOIN l USING (workunit))
SELECT workunit, start, CASE WHEN NOT known THEN 'no such workunit' END AS record_error, resource, CASE WHEN resource IS NULL THEN 'no resource resolves to this workunit' END AS resource_error,
  CASE WHEN asked THEN CASE WHEN links IS NULL THEN 'links-unavailable' WHEN tesm = 0 AND links = 0 THEN 'no-tiles' WHEN tesm = 0 THEN 'tesm-missing' WHEN tesm < links * 0.95 THEN 'tesm-incomplete' WHEN links < tesm * 0.95 THEN 'links-behind-tesm' ELSE 'consistent' END END AS status, 'out/lpc_cache/' || workunit AS files FROM j""")
def site_manifest(spark, sf_dir):
    k = F.col("workunit_id")
    own = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("workunit_id")).agg(F.min("o_orderdate").alias("start"), F.count(F.lit(1)).alias("n")).withColumn("workunit", F.concat(F.lit("WU_"), k.cast("string")))
    wanted = read(spark, sf_dir, "customer").select(F.explode(F.array(*[F.concat(F.lit(p), F.col("c_custkey").cast("string")) for p in ("WU_", "XX_")])).alias("workunit"))
    resolved = catalog.resolve_names(own, own.where(k % 2 == 0).select(F.lower("workunit").alias("name"), "n"), count="n")
    links = own.where(k % 4 != 0).select("workunit", F.when(k % 5 != 0, F.col("n") + k % 2 * 3).alias("n"))
    out = staging.site_manifest(wanted, own.select("workunit", "start"), "out/", resolved, own.where(k % 3 != 0).select("workunit", "n"), links)
    return out.select("workunit", "record.start", "record_error", "resource", "resource_error", "status", "files")


@query(SRV + """, c AS (SELECT *, count(*) OVER (PARTITION BY aoi) AS n_candidates, max("end" IS NOT NULL) OVER (PARTITION BY aoi) AS anyd FROM m WHERE workunit_id % 3 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY "end" DESC NULLS LAST, overlap DESC NULLS LAST, workunit) AS i FROM c WHERE "end" IS NOT NULL OR NOT anyd) SELECT aoi, workunit, 'USGS_LPC_' || workunit || '_LAS_2020' AS resource, CAST(3 AS INT) AS tier, n_candidates FROM d WHERE i = 1""")
def project_latest(spark, sf_dir):
    own = surveys(spark, sf_dir)
    named = own.where("workunit_id % 3 = 0").select(F.concat(F.lit("USGS_LPC_"), "workunit", F.lit("_LAS_2020")).alias("name"), F.col("workunit_id").alias("count"))
    return catalog.choose(own, named, "latest", ["aoi"]).select("aoi", "workunit", "resource", "tier", "n_candidates")


@query("""WITH t AS (SELECT o_custkey AS project, o_orderstatus AS s, CASE WHEN o_custkey % 10 = 0 THEN 'Cannot resume: resolution changed' END AS error FROM orders), c AS (SELECT project, count(*) FILTER (s = 'F') AS ok, count(*) FILTER (s = 'P') AS failed, min(error) AS error FROM t GROUP BY 1)
SELECT project, CASE WHEN error IS NOT NULL THEN 'failed: ' || error WHEN failed > 0 THEN 'failed: ' || failed || ' tiles' ELSE 'completed' END AS state, CASE WHEN error IS NOT NULL THEN 'start it anew in another folder' WHEN failed > 0 THEN 'run it again to resume' WHEN ok = 0 THEN 'no data' END AS note FROM c""")
def project_outcomes(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "empty").otherwise("failed")
    return batch.project_outcomes(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), state.alias("state"), F.when(F.col("o_custkey") % 10 == 0, "Cannot resume: resolution changed").alias("error")))


@query("""SELECT c_mktsegment AS area, strftime(min(CASE WHEN c_custkey % 3 <> 0 THEN make_date(2000 + CAST(c_custkey % 20 AS INT), 1, 1) END), '%Y-%m-%d') AS first_start, strftime(max(CASE WHEN c_custkey % 3 <> 0 THEN make_date(2001 + CAST(c_custkey % 20 AS INT), 1, 1) END), '%Y-%m-%d') AS last_end, count(*) AS n_projects, CASE WHEN c_mktsegment > 'C' THEN CAST(sum(c_custkey % 50) AS DOUBLE) END AS tiles FROM customer GROUP BY 1""")
def preview_footer(spark, sf_dir):
    k = F.col("c_custkey")
    year = lambda n: F.when(k % 3 != 0, F.make_date((k % 20 + n).cast("int"), F.lit(1), F.lit(1)))
    own = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("area"), year(2000).alias("start"), year(2001).alias("end"), F.when((F.col("c_mktsegment") > "C") | (k % 2 == 0), k % 50).alias("tiles"))
    return products.footer(own, ["area"]).withColumns({"first_start": F.col("first_start").cast("string"), "last_end": F.col("last_end").cast("string"), "tiles": F.col("tiles").cast("double")})


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return batch.pending(read(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""WITH old AS (SELECT c_custkey AS project, c_mktsegment AS grid, 'old' AS state, c_custkey AS ord FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey AS project, c_mktsegment AS grid, 'new' AS state, row_number() OVER (ORDER BY c_custkey) AS ord FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment = 'BUILDING'),
k AS (SELECT * FROM old WHERE grid IN (SELECT grid FROM new))
SELECT project, grid, state, ord FROM k WHERE project NOT IN (SELECT project FROM new) UNION ALL SELECT n.project, n.grid, n.state, coalesce(k.ord, (SELECT coalesce(max(ord), 0) FROM k) + n.ord) FROM new n LEFT JOIN k USING (project)""")
def status_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("grid"))
    old = c.where("project % 2 = 0").select("project", "grid", F.lit("old").alias("state"), F.col("project").alias("ord"))
    picked = c.where("project % 3 = 0 AND grid = 'BUILDING'")
    new = picked.select("project", "grid", F.lit("new").alias("state"), F.row_number().over(Window.partitionBy("grid").orderBy("project")).cast("bigint").alias("ord"))
    return batch.carry_forward(old, new, "project", ["grid"]).select("project", "grid", "state", "ord")


@query("""SELECT o_orderpriority AS product, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS empty, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus <> 'O') AS data_total FROM orders GROUP BY 1""")
def tile_tally(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "empty").otherwise("failed")
    return batch.outcome_tally(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("product"), state.alias("state")), ["product"])


# --- reports -------------------------------------------------------------------------------------------------------------

PATTERNS = {"mail": [r"([a-z0-9.]+@[a-z]+\.[a-z]+)"], "number": [r"(\d+\.\d+)", r"(\d{3,})", r"(\d+)"], "license": [r"(?i)(mit license|apache license)", r"(?i)(cc by)"]}
METRICS = """WITH f AS (SELECT source, doc_id, unnest(['mail', 'number', 'license']) AS metric, unnest([nullif(regexp_extract(text, '([a-z0-9.]+@[a-z]+\\.[a-z]+)', 1), ''),
  coalesce(nullif(regexp_extract(text, '(\\d+\\.\\d+)', 1), ''), nullif(regexp_extract(text, '(\\d{3,})', 1), ''), nullif(regexp_extract(text, '(\\d+)', 1), '')),
  coalesce(nullif(regexp_extract(text, '(?i)(mit license|apache license)', 1), ''), nullif(regexp_extract(text, '(?i)(cc by)', 1), ''))]) AS value FROM documents), g AS (SELECT * FROM f WHERE value IS NOT NULL)"""


@query(METRICS + " SELECT source, metric, arg_min(value, doc_id) AS value, min(doc_id) AS \"from\", count(*) AS n_files FROM g GROUP BY 1, 2")
def first_match_metrics(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return reports.first_of_files(reports.metrics(docs, PATTERNS), ["source"], "doc_id")


SOURCES = [f"src{k}" for k in range(20)]


@query(METRICS + " SELECT metric, " + ", ".join(f"max(value) FILTER (source = '{x}') AS {x}" for x in SOURCES) + " FROM (SELECT source, metric, arg_min(value, doc_id) AS value FROM g GROUP BY 1, 2) GROUP BY metric HAVING count(*) FILTER (source IN (" + ", ".join(f"'{x}'" for x in SOURCES) + ")) > 0")
def metric_pivot(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    found = reports.first_of_files(reports.metrics(docs, PATTERNS), ["source"], "doc_id")
    return reports.compare(found, "metric", "source", SOURCES)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
v AS (SELECT *, nullif(regexp_extract(line, '([0-9]+)', 1), '') AS v FROM l),
w AS (SELECT *, coalesce(lead(v, 1) OVER x, lead(v, 2) OVER x, lead(v, 3) OVER x) AS found FROM v WINDOW x AS (PARTITION BY doc_id ORDER BY no)) SELECT doc_id, no, found FROM w WHERE contains(line, ',')""")
def lookahead_value(spark, sf_dir):
    value = F.nullif(F.regexp_extract("line", "([0-9]+)", 1), F.lit(""))
    return reports.look_ahead(lines(spark, sf_dir), ["doc_id"], "no", F.contains(F.col("line"), F.lit(",")), value).select("doc_id", "no", "found")


@query("""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1), '\\s+', ' ', 'g')), '') AS h1 FROM pages""")
def fgdc_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.tag(F.col("html"), "title").alias("title"), text.tag(F.col("html"), "h1").alias("h1"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS endpoint, CASE WHEN p = '' THEN '' ELSE p || '/' END AS prefix, ends_with(lower(url), '.html') OR ends_with(lower(url), '/') AS wanted FROM (SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), '/+$', '') AS p FROM pages)""")
def url_prefixes(spark, sf_dir):
    e, p = text.endpoint_and_prefix(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", e.alias("endpoint"), p.alias("prefix"), text.has_suffix(F.col("url"), [".html", "/"]).alias("wanted"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate + to_days(CAST(o_orderkey % 120 AS INT)) AS DATE) AS r FROM orders) SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS iso, CASE WHEN o_orderkey % 10 <> 0 THEN r <= d + 45 END AS consistent, substr(sha256(strftime(d, '%Y%m%d')), 1, 16) AS mark FROM d""")
def report_dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    o = read(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), F.date_add(d, (F.col("o_orderkey") % 120).cast("int")).alias("r"))
    digits = F.date_format("d", "yyyyMMdd")
    end = F.when(F.col("o_orderkey") % 10 != 0, F.col("r"))
    return o.select("o_orderkey", text.iso_date(digits).alias("iso"), reports.window_check(F.col("d"), end, F.col("d"), F.col("d")).alias("consistent"), text.fingerprint(digits).alias("mark"))


# Reports made of an order's key, so that SQL can say what is in them without reading them. Every third file of a customer has other labels.
def vendor_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cm = F.concat((k % 40 + 1).cast("string"), F.lit("."), (k % 10).cast("string"))
    m = F.concat(F.lit("0."), F.lpad((k % 1000).cast("string"), 3, "0"))
    n = (k % 90 + 10).cast("string")
    geiger = F.concat(F.lit("Summary\nNVA of Point Cloud   "), n, F.lit("  "), m, F.lit("  0.100\nVVA of DEM "), n, F.lit(" 0.9 0.107\nAggregate Nominal Pulse Density (pls/m2)  "), cm, F.lit("\nNVA of Bare Earth 1 0.5 0.5"))
    table = F.concat(F.lit("  NVA   0.196 m  "), m, F.lit("  "), n, F.lit("\n  VVA  0.3 m  0.147  20 \nRMSEr\n target 0.2\n measured "), m, F.lit(" m\nACCr\nx\ny\n0.19 m\nDensity   9.66 pts / m2\n  Aggregate  1,200  3,400  "), cm, F.lit("/0.5"))
    focus = F.concat(F.lit("Nonvegetated Vertical Accuracy (Ground LAS)\nnothing\nRMSE  "), cm, F.lit(" cm 10 cm\nDensity 8 pts/m2 8 pts/m2 "), cm, F.lit(" pts/m2\nrelative vertical accuracy of swaths ( 0.011 meters)"))
    text = F.when(k % 3 == 0, geiger).when(k % 3 == 1, table).otherwise(focus)
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), k.alias("path"), text.alias("text"))


VENDOR = """WITH o AS (SELECT o_custkey AS project, o_orderkey AS path, o_orderkey % 3 AS kind, (o_orderkey % 40 + 1) + (o_orderkey % 10) / 10.0 AS cm, (o_orderkey % 1000) / 1000.0 AS m, CAST(o_orderkey % 90 + 10 AS DOUBLE) AS n FROM orders),
f AS (SELECT project, path, unnest(CASE kind WHEN 0 THEN ['n_nva', 'nva_rmsez_m', 'nva_95pct_m', 'n_vva', 'vva_95th_m', 'anpd_ppsm'] WHEN 1 THEN ['nva_95pct_m', 'n_nva', 'vva_95th_m', 'n_vva', 'horizontal_rmser_m', 'horizontal_acc95_m', 'measured_density_ppsm', 'first_return_density_ppsm'] ELSE ['nva_rmsez_pointcloud_vendor_m', 'measured_density_ppsm', 'swath_relative_dz_mean_m'] END) AS metric,
  CAST(unnest(CASE kind WHEN 0 THEN [n, m, 0.1, n, 0.107, cm] WHEN 1 THEN [m, n, 0.147, 20, m, 0.19, 9.66, cm] ELSE [round(cm / 100, 4), cm, 0.011] END) AS DOUBLE) AS value FROM o)"""


@query(VENDOR + " SELECT project, metric, arg_min(value, path) AS value, min(path) AS \"from\" FROM f GROUP BY 1, 2")
def vendor_metrics(spark, sf_dir):
    return vendor.project_metrics(vendor.metric_rows(vendor_reports(spark, sf_dir), ["project"], lines=False), ["project"])


@query(VENDOR + " SELECT project, path, metric, CASE metric WHEN 'anpd_ppsm' THEN 'Aggregate Nominal Pulse Density (pls/m2) ' || cm WHEN 'n_vva' THEN CASE kind WHEN 0 THEN 'VVA of DEM ' || CAST(n AS INT) || ' 0.9 0.107' ELSE 'VVA 0.3 m 0.147 20' END ELSE 'relative vertical accuracy of swaths ( 0.011 meters)' END AS line FROM f JOIN o USING (project, path) WHERE metric IN ('anpd_ppsm', 'n_vva', 'swath_relative_dz_mean_m')")
def vendor_evidence(spark, sf_dir):
    rows = vendor.metric_rows(vendor_reports(spark, sf_dir), ["project"])
    return rows.where(F.col("metric").isin("anpd_ppsm", "n_vva", "swath_relative_dz_mean_m")).select("project", "path", "metric", "line")


@query("""SELECT o_orderkey AS id, 'QL ' || o_orderkey % 3 AS quality_level, CAST(NULL AS VARCHAR) AS p_method, 'GEOID ' || (o_orderkey % 20) AS geoid, '6' || (o_orderkey % 900 + 100) AS horizontal_epsg, CASE WHEN o_orderkey % 2 = 0 THEN 'EXPECTED TO MEET' END AS verdict FROM orders""")
def report_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("USGS Data Validation Report\nQuality Level: QL"), F.lit("\u00a0"), (k % 3).cast("string"), F.lit("\nGeoid Model:  GEOID "), (k % 20).cast("string"), F.lit("  \nHorizontal EPSG Code: 6"), (k % 900 + 100).cast("string"), F.when(k % 2 == 0, "\nthe delivered data is EXPECTED TO\n  MEET 3D Elevation Program").otherwise(""))
    v = vendor.validation(F.col("text"))
    own = read(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")).where(vendor.kind(F.col("text")) == "validation")
    return own.select("id", *[(F.replace(v[c], F.lit("\u00a0"), F.lit(" ")) if c == "quality_level" else v[c]).alias(c) for c in ("quality_level", "p_method", "geoid", "horizontal_epsg", "verdict")])


@query("""SELECT o_orderkey AS id, '2020-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-15' AS collection_start, 'Acme ' || (o_orderkey % 7) AS primary_contractor,
  CASE WHEN o_orderkey % 2 = 1 THEN round((o_orderkey % 50) / 100.0, 4) END AS nva_rmsez_pointcloud_m, round((o_orderkey % 50 + 1) / 100.0, 4) AS nva_95_pointcloud_m, round((o_orderkey % 50 + 2) / 100.0, 4) AS vva_95th_dem_m FROM orders""")
def report_project(spark, sf_dir):
    k = F.col("o_orderkey")
    num = lambda d: (k % 50 + d).cast("string")
    start = F.concat(F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-15-2020"))
    old = F.concat(F.lit("Non-Vegetated Vertical Accuracy\n  19.6 "), num(1), F.lit(" N/A 7\n Vegetated Vertical Accuracy\n 30 3 30 "), num(2))
    new = F.concat(F.lit(" 10 "), num(0), F.lit(" 19.6 "), num(1), F.lit(" 30 5\n 10 1 N/A 2 30 "), num(2), F.lit("\n"))
    text = F.concat(F.lit("Work Unit Definition\nPrimary Contractor: Acme "), (k % 7).cast("string"), F.lit("  \nCollection Start Date: "), start, F.lit("\nVertical Accuracy Results\n"), F.when(k % 2 == 0, old).otherwise(new))
    own = read(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")).where(vendor.kind(F.col("text")) == "project")
    p = vendor.project(F.col("text"))
    return own.select("id", *[p[c].alias(c) for c in ("collection_start", "primary_contractor", "nva_rmsez_pointcloud_m", "nva_95_pointcloud_m", "vva_95th_dem_m")])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS acquisition_start, 'about ' || (o_orderkey % 9) || ' cm' || CASE WHEN o_orderkey % 4 = 0 THEN ' ___' ELSE '' END AS vertical_accuracy_statement, o_orderkey % 4 = 0 AS unfilled_template_fields,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderkey % 100 <= 45 END AS consistent FROM orders""")
def report_fgdc(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    stamp = lambda d: F.date_format(d, "yyyyMMdd")
    begin = F.when(k % 5 != 0, F.concat(F.lit("<begdate> "), stamp(day), F.lit(" </begdate>"))).otherwise("")
    xml = F.concat(F.lit("<metadata>"), begin, F.lit("<enddate>"), stamp(F.date_add(day, (k % 100).cast("int"))), F.lit("</enddate><vertaccr>about\n  "), (k % 9).cast("string"), F.lit(" cm"), F.when(k % 4 == 0, " ___").otherwise(""), F.lit("</vertaccr></metadata>"))
    orders = read(spark, sf_dir, "orders")
    parsed = orders.select(k.alias("id"), xml.alias("xml")).select("id", *[c.alias(n) for n, c in vendor.fgdc(F.col("xml")).items()])
    dates = orders.select(k.alias("id"), day.alias("collect_start"), F.when(k % 3 != 0, day).alias("collect_end"))
    out = vendor.dates_consistent(parsed, dates, ["id"])
    return out.select("id", "acquisition_start", "vertical_accuracy_statement", "unfilled_template_fields", F.col("acquisition_dates_consistent").alias("consistent"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k / step) % len(values) + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("WU_"), F.lpad(k.cast("string"), 6, "0")).alias("workunit"), pick(("6340", "102247", "6341", "8693", "999999"), 3).alias("horiz_crs"), pick(("GEOID18", "NOT_A_GEOID", "Unknown", None, "12B", "GEOID12A", "geoid 09"), 2).alias("geoid"),
        pick(("Linear-mode lidar", "Ifsar", "Sonar", " linear-mode lidar "), 5).alias("p_method"), F.when(k % 9 != 0, "l").alias("lpc_link"), F.when(k % 2 == 0, "QL 1").alias("ql"))


@query("""WITH k AS (SELECT c_custkey AS k, 'WU_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS workunit, ['6340', '102247', '6341', '8693', '999999'][c_custkey // 3 % 5 + 1] AS crs, ['GEOID18', 'NOT_A_GEOID', 'Unknown', NULL, '12B', 'GEOID12A', 'geoid 09'][c_custkey // 2 % 7 + 1] AS geoid,
  ['Linear-mode lidar', 'Ifsar', 'Sonar', ' linear-mode lidar '][c_custkey // 5 % 4 + 1] AS p_method FROM customer),
f AS (SELECT 'horiz_crs.esri_authority_code' AS "check", 'blocker' AS severity, crs AS example FROM k WHERE crs = '102247' UNION ALL SELECT 'horiz_crs.non_nad83_datum', 'unsupported', crs FROM k WHERE crs = '8693' UNION ALL SELECT 'horiz_crs.unparseable', 'blocker', crs FROM k WHERE crs = '999999'
 UNION ALL SELECT 'geoid.unrecognized_model', 'blocker', geoid FROM k WHERE geoid = 'NOT_A_GEOID' UNION ALL SELECT 'geoid.undeclared', 'degraded', coalesce(geoid, '(null)') FROM k WHERE geoid = 'Unknown' OR geoid IS NULL
 UNION ALL SELECT 'p_method.not_lidar', 'unsupported', p_method FROM k WHERE p_method = 'Ifsar' UNION ALL SELECT 'p_method.unrecognized', 'info', p_method FROM k WHERE p_method = 'Sonar'
 UNION ALL SELECT 'metadata.missing_lpc_link', 'degraded', workunit FROM k WHERE k % 9 = 0 UNION ALL SELECT 'metadata.missing_ql', 'info', workunit FROM k WHERE k % 2 <> 0),
v AS (SELECT "check", severity, example, count(*) AS n FROM f GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY n DESC, example) AS i FROM v),
g AS (SELECT "check", severity, CAST(sum(n) AS BIGINT) AS count, array_to_string((list(example ORDER BY i))[1:8], ',') AS examples FROM e GROUP BY 1, 2)
SELECT *, (SELECT count(*) FROM customer) AS total, round(count / (SELECT count(*) FROM customer), 4) AS fraction, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'blocker' THEN 1 WHEN 'unsupported' THEN 2 WHEN 'degraded' THEN 3 ELSE 4 END, count DESC, "check") AS INT) AS place FROM g""")
def conformance_audit(spark, sf_dir):
    known = spark.createDataFrame([("6340", "supported"), ("6341", "supported"), ("102247", "esri"), ("8693", "other_datum")], "code string, class string")
    return conformance.audit(attributes(spark, sf_dir), known).withColumn("examples", F.array_join("examples", ","))


# --- geodesy -------------------------------------------------------------------------------------------------------------

PLACE = "WITH c AS (SELECT c_custkey AS id, CAST(c_custkey % 360 - 180 AS DOUBLE) + 0.25 AS lon, CAST(c_custkey % 160 - 80 AS DOUBLE) + 0.5 AS lat FROM customer)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), ((k % 360 - 180).cast("double") + 0.25).alias("lon"), ((k % 160 - 80).cast("double") + 0.5).alias("lat"))


@query(PLACE + " SELECT id, round(6378137 * radians(lon), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y, lon AS lon2, lat AS lat2 FROM c")
def mercator_xy(spark, sf_dir):
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.web_mercator_inverse(F.col("x"), F.col("y"))
    return places(spark, sf_dir).select("id", x.alias("x"), y.alias("y")).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon2"), F.round(lat, 6).alias("lat2"))


@query(PLACE + """, k AS (SELECT *, CAST(floor((lon + 180) / 6) + 1 AS INT) AS zone, 1 / 298.257223563 AS f FROM c),
n AS (SELECT *, f / (2 - f) AS n, sqrt(f * (2 - f)) AS e, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam FROM k),
t AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t, 0.9996 * 6378137 / (1 + n) * (1 + pow(n, 2) / 4 + pow(n, 4) / 64) AS a,
  n / 2 - 2 * pow(n, 2) / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1, 13 * pow(n, 2) / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2, 61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4 FROM n),
x AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS et FROM t)
SELECT id, zone, round(500000 + a * (et + a1 * cos(2 * xi) * sinh(2 * et) + a2 * cos(4 * xi) * sinh(4 * et) + a3 * cos(6 * xi) * sinh(6 * et) + a4 * cos(8 * xi) * sinh(8 * et)), 3) AS x,
  round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + a * (xi + a1 * sin(2 * xi) * cosh(2 * et) + a2 * sin(4 * xi) * cosh(4 * et) + a3 * sin(6 * xi) * cosh(6 * et) + a4 * sin(8 * xi) * cosh(8 * et)), 3) AS y FROM x""")
def utm_xy(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("zone", geo.utm_zone(F.col("lon")))
    x, y = geo.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return p.select("id", "zone", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(PLACE + """, q AS (SELECT id, lon, lat, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e2 FROM c),
b AS (SELECT *, sin(radians(lat)) AS s0, sin(radians(lat + 1)) AS s1, sqrt(e2) AS e FROM q)
SELECT id, round(pow(6378137, 2) / 2 * radians(2) * (1 - e2) * ((s1 / (1 - e2 * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) - (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e))) / 1000000, 4) AS km2 FROM b""")
def equal_area(spark, sf_dir):
    lon, lat = F.col("lon"), F.col("lat")
    corner = lambda dx, dy: F.struct(*[c.alias(n) for n, c in zip("xy", geo.equal_area(lon + dx, lat + dy))])
    ring = F.array(corner(0, 0), corner(2, 0), corner(2, 1), corner(0, 1))
    return places(spark, sf_dir).select("id", F.round(geo.ring_area(ring) / 1e6, 4).alias("km2"))


@query(PLACE + ", r AS (SELECT id, CASE " + " ".join(f"WHEN lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n} THEN '{r}'" for r, w, s, e, n in geodesy.REGIONS) + """ END AS region FROM c)
SELECT id, region, CASE WHEN id % 3 = 0 THEN CASE region WHEN 'conus' THEN 'us_noaa_g2018u0.tif' WHEN 'prvi' THEN 'us_noaa_g2018p0.tif' END WHEN id % 3 = 1 THEN CASE region WHEN 'conus' THEN 'us_noaa_g2012bu0.tif' WHEN 'ak' THEN 'us_noaa_g2012ba0.tif' WHEN 'prvi' THEN 'us_noaa_g2012bp0.tif' WHEN 'hi' THEN 'us_noaa_g2012bh0.tif' WHEN 'guam' THEN 'us_noaa_g2012bg0.tif' WHEN 'samoa' THEN 'us_noaa_g2012bs0.tif' END END AS grids FROM r""")
def geoid_grids(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("region", geo.first_region(F.col("lon"), F.col("lat"), geodesy.REGIONS))
    model = F.when(F.col("id") % 3 == 0, "GEOID18").when(F.col("id") % 3 == 1, "GEOID12B")
    return p.select("id", "region", F.array_join(geodesy.region_grids(model, F.col("region"), fail=False), ",").alias("grids"))


DECLARED = ["GEOID18", "geoid 18", "12B", "GEOID12A", "12A", "unknown", "Geoid12", "GEOID09", "GEOID06", "GEOID03", "GEOID99", "GEOID29", " ", "N/A", "09"]
PRVI_IDS = 12


@query(f"""WITH p AS (SELECT c_custkey AS id, CAST(c_custkey % 360 - 180 AS DOUBLE) + 0.25 AS lon, CAST(c_custkey % 160 - 80 AS DOUBLE) + 0.5 AS lat FROM customer),
q AS (SELECT id, CASE WHEN id % {PRVI_IDS} = 0 THEN -66.5 WHEN id % {PRVI_IDS} = 1 THEN -149.5 WHEN id % {PRVI_IDS} < 6 THEN -115.2 ELSE lon END AS lon, CASE WHEN id % {PRVI_IDS} = 0 THEN 18.2 WHEN id % {PRVI_IDS} = 1 THEN 60.5 WHEN id % {PRVI_IDS} < 6 THEN 36.1 ELSE lat END AS lat FROM p),
r AS (SELECT id, CASE WHEN id % 16 = 15 THEN NULL ELSE {DECLARED}[CAST(id % 16 AS INT) + 1] END AS g, CASE """ + " ".join(f"WHEN lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n} THEN '{r}'" for r, w, s, e, n in geodesy.REGIONS) + f""" END AS region FROM q),
k AS (SELECT *, CASE upper(replace(g, ' ', '')) WHEN '12A' THEN 'GEOID12A' WHEN '12B' THEN 'GEOID12B' ELSE upper(replace(g, ' ', '')) END AS key FROM r),
m AS (SELECT *, CASE WHEN key = 'GEOID12A' THEN 'GEOID12B' ELSE key END AS model FROM k),
g AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{r}', '{','.join(files)}')" for m, regions in geodesy.GEOID_GRIDS.items() for r, files in regions.items())}) t(model, region, grids))
SELECT id, coalesce(key IN ('', 'UNKNOWN', 'N/A', 'NA', 'NONE'), true) AS undeclared, CASE WHEN ok THEN model END AS model, CASE WHEN ok AND key = 'GEOID12A' THEN key END AS substituted_for, CASE WHEN ok THEN grids END AS grids
FROM (SELECT m.*, g.grids, coalesce(g.grids IS NOT NULL AND NOT (key = 'GEOID12A' AND m.region = 'prvi'), false) AS ok FROM m LEFT JOIN g ON g.model = m.model AND g.region = m.region)""")
def geoid_declared(spark, sf_dir):
    i = F.col("id")
    at = lambda a, b, c, d: F.when(i % PRVI_IDS == 0, a).when(i % PRVI_IDS == 1, b).when(i % PRVI_IDS < 6, c).otherwise(d)
    p = places(spark, sf_dir).withColumns({"lon": at(-66.5, -149.5, -115.2, F.col("lon")), "lat": at(18.2, 60.5, 36.1, F.col("lat"))})
    declared = F.get(F.array(*[F.lit(x) for x in DECLARED]), (i % 16).cast("int"))
    found = p.withColumn("g", geodesy.declared_geoid(declared, geo.first_region(F.col("lon"), F.col("lat"), geodesy.REGIONS)))
    return found.select("id", F.col("g").isNull().alias("undeclared"), "g.model", "g.substituted_for", F.array_join("g.grids", ",").alias("grids"))


@query(PLACE + " SELECT id, CASE " + " ".join(f"WHEN lon BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n} THEN '{r}'" for r, w, s, e, n in geodesy.REGIONS) + " END AS region FROM c")
def aoi_region(spark, sf_dir):
    return places(spark, sf_dir).select("id", geo.first_region(F.col("lon"), F.col("lat"), geodesy.REGIONS).alias("region"))


@query(PLACE + """, s AS (SELECT id, lon, lat, CASE id % 3 WHEN 0 THEN ['a.tif'] WHEN 1 THEN ['b.tif', 'c.tif'] END AS want FROM c),
o AS (SELECT id, r AS rank, CASE r WHEN 1 THEN ['a.tif'] WHEN 2 THEN ['b.tif', 'c.tif'] ELSE ['b.tif'] END AS have, NOT (r = 1 AND id % 7 = 0) AS there, CASE r WHEN 1 THEN 10.0 WHEN 2 THEN CASE WHEN id % 5 = 0 THEN 13.0 ELSE 11.0 END ELSE 10.5 END AS shift, r = 1 AS everywhere FROM c, range(1, 4) t(r) WHERE NOT (r = 2 AND id % 11 = 0)),
j AS (SELECT s.*, rank, there, everywhere, shift, want IS NULL OR list_has_all(have, want) AS fits, arg_min(shift, rank) OVER (PARTITION BY s.id) AS base FROM s JOIN o ON o.id = s.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fits DESC, rank) AS i FROM j)
SELECT id, CAST(CASE WHEN fits THEN rank END AS DOUBLE) AS rank, CASE WHEN NOT fits THEN 'no operation' WHEN NOT there THEN 'grids missing' WHEN NOT (everywhere OR (lat BETWEEN -60 AND 60 AND (lon >= 150 OR lon + 0.5 <= -30))) THEN 'area outside' WHEN abs(shift - base) > 2 THEN 'not sane' ELSE 'ok' END AS state FROM k WHERE i = 1""")
def vertical_preflight(spark, sf_dir):
    i, lon, lat = F.col("id"), F.col("lon"), F.col("lat")
    names = lambda *x: F.array(*[F.lit(f"{n}.tif") for n in x])
    own = places(spark, sf_dir)
    wanted = own.select("id", F.when(i % 3 == 0, names("a")).when(i % 3 == 1, names("b", "c")).alias("grids"), lon.alias("west"), lat.alias("south"), (lon + 0.5).alias("east"), lat.alias("north"))
    rank = F.col("rank")
    ops = own.select("id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("rank")).where(~((rank == 2) & (i % 11 == 0)))
    ops = ops.select("id", "rank", F.when(rank == 1, names("a")).when(rank == 2, names("b", "c")).otherwise(names("b")).alias("grids"), (~((rank == 1) & (i % 7 == 0))).alias("there"),
                     F.when(rank == 1, 10.0).when(rank == 2, F.when(i % 5 == 0, 13.0).otherwise(11.0)).otherwise(10.5).alias("shift"),
                     *[F.when(rank == 1, float(a)).otherwise(float(b)).alias(c) for c, a, b in (("west", -180, 150), ("south", -90, -60), ("east", 180, -30), ("north", 90, 60))])
    return preflight.choose_operations(wanted, ops, ["id"]).select("id", rank.cast("double").alias("rank"), "state")


@query(PLACE + " SELECT id, round(0.1 + 10 * 0.001 + (1 + 1e-9) * (lon * 1e4 - 2e-8 * lat * 1e4 + 3e-8 * 5e3), 4) AS x, round(0.2 + (1 + 1e-9) * (2e-8 * lon * 1e4 + lat * 1e4 - 1e-8 * 5e3), 4) AS y, round(0.3 + (1 + 1e-9) * (1e-8 * lat * 1e4 - 3e-8 * lon * 1e4 + 5e3), 4) AS z FROM c")
def helmert_xyz(spark, sf_dir):
    xyz = geo.helmert(F.col("lon") * 1e4, F.col("lat") * 1e4, F.lit(5e3), F.lit(10.0), {"tx": 0.1, "ty": 0.2, "tz": 0.3, "rx": 1e-8, "ry": 3e-8, "rz": 2e-8, "s": 1e-9}, {"tx": 0.001})
    return places(spark, sf_dir).select("id", *[F.round(c, 4).alias(n) for n, c in zip("xyz", xyz)])


@query("""WITH l AS (SELECT user_id, event_id, ts, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 21600000000 AS INT), 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM l) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY user_id, no""")
def epoch_sessions(spark, sf_dir):
    return epochs.epoch_sessions(read(spark, sf_dir, "events"), "user_id", "ts", "6 hours", "1 day")


@query("SELECT event_type AS tile, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tile_arrivals(spark, sf_dir):
    return epochs.tile_arrivals(read(spark, sf_dir, "events").withColumnRenamed("event_type", "tile"), "tile", "ts", "1 day", "1 day")


def _ground_sql(window: int = 8, slope: float = 0.2, threshold: float = 0.45, scalar: float = 1.2) -> str:
    """The openings as window functions, one step after the other."""
    steps = ["s0 AS (SELECT tile, CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col, min(z) AS low, min(z) AS o, false AS flag FROM p GROUP BY 1, 2, 3)"]
    for w in range(1, window + 1):
        before = f"s{w - 1}"
        for k, (f, part, order) in enumerate((("min", "row", "col"), ("min", "col", "row"), ("max", "row", "col"), ("max", "col", "row"))):
            v = "o" if k == 0 else "v"
            steps.append(f"s{w}_{k} AS (SELECT tile, row, col, low, o, flag, {f}({v}) OVER (PARTITION BY tile, {part} ORDER BY {order} RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS v FROM {before})")
            before = f"s{w}_{k}"
        steps.append(f"s{w} AS (SELECT tile, row, col, low, v AS o, flag OR o - v > {slope} * {w} AS flag FROM {before})")
    steps.append(f"""g AS (SELECT tile, row, col, low AS z FROM s{window} WHERE NOT flag), st AS (SELECT unnest(generate_series({-window}, {window})) AS d),
nr AS (SELECT tile, row + a.d AS row, col + b.d AS col, z, 1 / CAST(a.d * a.d + b.d * b.d AS DOUBLE) AS w FROM g, st a, st b WHERE a.d <> 0 OR b.d <> 0),
dem AS (SELECT tile, row, col, z FROM g UNION ALL SELECT nr.tile, nr.row, nr.col, sum(z * w) / sum(w) FROM nr JOIN s{window} f ON f.tile = nr.tile AND f.row = nr.row AND f.col = nr.col AND f.flag GROUP BY 1, 2, 3),
sl AS (SELECT *, (lead(z) OVER x - lag(z) OVER x) / 2 AS dx, (lead(z) OVER y - lag(z) OVER y) / 2 AS dy FROM dem WINDOW x AS (PARTITION BY tile, row ORDER BY col), y AS (PARTITION BY tile, col ORDER BY row)),
c AS (SELECT p.tile, CAST(CASE WHEN coalesce(abs(p.z - sl.z) <= {threshold} + sqrt(pow(coalesce(dx, 0), 2) + pow(coalesce(dy, 0), 2)) * {scalar}, false) THEN 2 ELSE 1 END AS INT) AS cls FROM p LEFT JOIN sl ON sl.tile = p.tile AND sl.row = CAST(floor(y) AS BIGINT) AND sl.col = CAST(floor(x) AS BIGINT))
SELECT tile, cls, count(*) AS n FROM c GROUP BY 1, 2""")
    return PTS + ", " + ", ".join(steps)


@query(_ground_sql())
def ground_classes(spark, sf_dir):
    return points.classify_ground(cloud(spark, sf_dir).select("tile", "x", "y", "z", "cls")).groupBy("tile", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, round(year(d) + date_diff('day', make_date(year(d), 1, 1), d) / CAST(date_diff('day', make_date(year(d), 1, 1), make_date(year(d) + 1, 1, 1)) AS DOUBLE), 9) AS epoch,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '+proj=pipeline +step +proj=vgridshift +grids=g' || (o_orderkey % 3) || '.tif +step +proj=utm' END AS pipeline FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def epochs_and_grids(spark, sf_dir):
    k = F.col("o_orderkey")
    before = F.when(k % 4 == 0, F.lit("+proj=utm")).otherwise(F.lit("+proj=pipeline +step +proj=vgridshift +grids=old.tif +step +proj=utm"))
    after = geodesy.swap_vertical_grids(before, F.concat(F.lit("g"), (k % 3).cast("string"), F.lit(".tif")), fail=False)
    return read(spark, sf_dir, "orders").select(k, F.round(geodesy.decimal_year(F.col("o_orderdate").cast("date")), 9).alias("epoch"), after.alias("pipeline"))


#: Declared systems, what each rests on by the definitions' registry (null: nothing that is supported), and the definitions themselves.
SYSTEMS = {26910: 4269, 26923: 4269, 3740: 4152, 3717: 4759, 6339: 6318, 4269: 4269, 6318: 6318, 6783: 6783, 7131: 6318, 6521: 6318, 32610: None, 4326: None, 6322: None, 6634: None, 999999: None}
STATE_PLANE = 'PROJCRS["{name}",BASEGEOGCRS["{base}",DATUM["{base}",ELLIPSOID["GRS 1980",6378137,298.257222101]]{ident}],CONVERSION["plane",METHOD["Lambert Conic Conformal (2SP)"]],CS[Cartesian,2],AXIS["easting",east],AXIS["northing",north]]'
REGISTRY = [
    (7131, STATE_PLANE.format(name="San Francisco", base="NAD83(2011)", ident=',ID["EPSG",6318]')), (6521, STATE_PLANE.format(name="Nevada East (ftUS)", base="NAD83(2011)", ident="")),
    (6634, STATE_PLANE.format(name="UTM zone 2S", base="NAD83(PA11)", ident=',ID["EPSG",6322]')), (32610, crs.utm(32610, "WGS 84 (G1674)")), (999999, "no definition"),
]


@query(PLACE + f""", s AS (SELECT unnest({list(range(len(SYSTEMS)))}) AS k, unnest({[str(v or 'error') for v in SYSTEMS.values()]}) AS base)
SELECT id, CASE WHEN id % 2 = 0 THEN lon >= 170 OR lon <= -150 ELSE lon BETWEEN -120 AND -60 END AS inside, base FROM c LEFT JOIN s ON k = id % {len(SYSTEMS) + 1}""")
def areas_of_use(spark, sf_dir):
    i = F.col("id")
    west, east = F.when(i % 2 == 0, 170.0).otherwise(-120.0), F.when(i % 2 == 0, -150.0).otherwise(-60.0)
    code = F.get(F.array(*[F.lit(x) for x in SYSTEMS]), (i % (len(SYSTEMS) + 1)).cast("int")).cast("long")
    registry = crs.bases(spark.createDataFrame(REGISTRY, "code long, wkt string"))
    p = places(spark, sf_dir).withColumn("code", code).join(F.broadcast(registry.withColumnRenamed("base", "registered")), "code", "left")
    return p.select("id", geodesy.lon_in(F.col("lon"), west, east).alias("inside"), geodesy.geographic_base(F.col("code"), F.col("registered")).alias("base"))


# --- files ---------------------------------------------------------------------------------------------------------------

def _image_grid(spark, sf_dir):
    """All images on one grid, a hundred to a row of images, and the grid."""
    n = images(spark, sf_dir).select(F.max("source")).first()[0] + 1
    whole = images(spark, sf_dir).select((F.floor(F.col("source") / 100) * 8 + F.col("row")).alias("row"), (F.col("source") % 100 * 8 + F.col("col")).alias("col"), "value")
    return whole, geotiff.Grid(800, -(-n // 100) * 8, 500_000.0, 4_000_000.0, 2.0, -9999.0, "float64", 32611)


GRID_SQL = """WITH e AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding) AS v FROM embeddings),
g AS (SELECT vec_id // 100 * 8 + i // 8 AS row, vec_id % 100 * 8 + i % 8 AS col, CAST(v AS DOUBLE) AS value FROM e)"""


@query(GRID_SQL + " SELECT row, col, value FROM g WHERE row BETWEEN 3 AND 20 AND col BETWEEN 100 AND 350")
def raster_windows(spark, sf_dir):
    """A window of a GeoTIFF file that the sink has written."""
    geotiff.register(spark)
    whole, grid = _image_grid(spark, sf_dir)
    path = new_path(spark, "images") + ".tif"
    geotiff.write(whole, path, grid, block=64)
    return spark.read.format("geotiff").load(path).where("row BETWEEN 3 AND 20 AND col BETWEEN 100 AND 350").select("row", "col", "value")


@query(GRID_SQL + """, l AS (SELECT unnest([2, 4]) AS level),
o AS (SELECT level, row // level AS row, col // level AS col, avg(value) AS value FROM g, l GROUP BY ALL)
SELECT CAST(level AS INT) AS level, row, col, round(value, 9) AS value FROM o""")
def raster_levels(spark, sf_dir):
    """The overviews of a GeoTIFF file that the sink has written with them."""
    geotiff.register(spark)
    whole, grid = _image_grid(spark, sf_dir)
    base = written(whole.withColumn("source", F.lit(1)), "image-grid")
    path = new_path(spark, "images") + ".tif"
    geotiff.write(base.select(F.lit(1).alias("level"), "row", "col", "value").unionByName(raster.overviews(base, (2, 4)).select("level", "row", "col", "value")), path, grid, block=64)
    read_level = lambda k: spark.read.format("geotiff").option("level", k).load(path).select(F.lit(k).alias("level"), "row", "col", F.round("value", 9).alias("value"))
    return read_level(2).unionByName(read_level(4))


@query(SRV + " SELECT aoi, workunit, xmin, ymin, xmax, ymax FROM sv WHERE xmin <= 7 AND xmax >= 3.5 AND ymin <= 6 AND ymax >= 4")
def geopackage_box(spark, sf_dir):
    """Surveys in a box, from a GeoPackage file that the sink has written: the box goes to its R-tree."""
    geopackage.register(spark)
    s = surveys(spark, sf_dir).withColumn("parts", polygons.box_parts(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
    path = new_path(spark, "surveys") + ".gpkg"
    geopackage.write(s.select("aoi", "workunit", "parts"), path, "surveys")
    return readers.in_box(spark.read.format("geopackage").load(path), 3.5, 4.0, 7.0, 6.0).select("aoi", "workunit", "xmin", "ymin", "xmax", "ymax")


@query(PTS + " SELECT round(x, 2) AS x, round(y, 2) AS y, round(z, 3) AS z, cls, rn FROM p WHERE x BETWEEN 20 AND 90 AND y BETWEEN 2 AND 60 AND x < 40000 AND y < 40000 AND z < 20000")
def octree_box(spark, sf_dir):
    """Points in a box, from an octree that the sink has written: nodes elsewhere are not read."""
    octree.register(spark)
    folder = new_path(spark, "octree")
    octree.write(cloud(spark, sf_dir).withColumn("z", F.round("z", 3)), folder, (0.0, 0.0, -20_000.0, 40_000.0, 40_000.0, 20_000.0), depths=7)
    found = spark.read.format("octree").load(folder).where("x BETWEEN 20 AND 90 AND y BETWEEN 2 AND 60")
    return found.select(F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("z", 3).alias("z"), F.col("cls").cast("int").alias("cls"), F.col("rn").cast("int").alias("rn"))


@query(IMG + """, f AS (SELECT DISTINCT source % 5 AS source, source // 5 % 20 * 8 + row AS row, source // 100 * 8 + col AS col FROM r WHERE value > -0.05),
k AS (SELECT source, row + a AS row, col + b AS col, count(*) AS n, min(a = b) AS slant, max(a = b) AS other FROM f, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b) GROUP BY ALL),
v AS (SELECT source, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND slant = other THEN 2 ELSE 0 END) AS corners FROM k GROUP BY 1)
SELECT source, CAST(corners AS BIGINT) AS corners, count(*) AS cells FROM f JOIN v USING (source) GROUP BY ALL""")
def footprint_rings(spark, sf_dir):
    """Corners and cells of all rims: a lattice corner with one or three cells around it is one, with two that only touch there two."""
    k = F.col("source")
    cells = images(spark, sf_dir).where("value > -0.05").select((k % 5).alias("source"), (F.floor(k / 5) % 20 * 8 + F.col("row")).alias("row"), (F.floor(k / 100) * 8 + F.col("col")).alias("col"), "value")
    found = footprints.rings(cells)
    return found.groupBy("source").agg(F.sum(F.size("points")).cast("bigint").alias("corners"), F.sum(footprints.twice_area(F.col("points")) / 2).cast("bigint").alias("cells"))


@query(PLACE + " SELECT id, CASE WHEN lon BETWEEN -130 AND -60 AND lat BETWEEN 20 AND 60 THEN round(0.25 * lat - 0.125 * lon - 40, 3) END AS undulation FROM c")
def geoid_heights(spark, sf_dir):
    """The geoid's height at places, from two grids of a plane that the query writes, so that every value between is known."""
    import numpy as np

    paths = []
    for west, n in ((-130.0, 101), (-96.0, 73)):
        lat, lon = np.meshgrid(20 + np.arange(81) * 0.5, west + np.arange(n) * 0.5, indexing="ij")
        paths.append(new_path(spark, "geoid") + ".gtx")
        gtx.write(paths[-1], 20.0, west, 0.5, 0.5, 0.25 * lat - 0.125 * lon - 40)
    values, grids = gtx.read(spark, paths)
    return gtx.with_undulation(places(spark, sf_dir), values, grids).select("id", F.round("undulation", 3).alias("undulation"))


#: From degrees on one realization to UTM on another: a transformation with rates, between geocentric coordinates.
TO_UTM = ("+proj=pipeline +step +proj=unitconvert +xy_in=deg +xy_out=rad +step +proj=cart +ellps=GRS80 +step +proj=helmert +x=1 +y=-1.9 +z=-0.5 +rx=0.02 +ry=0 +rz=0.01 +s=0.0004"
          " +dx=0.001 +dy=0 +dz=-0.001 +drx=0 +dry=-0.0007 +drz=0 +ds=0 +t_epoch=2010 +convention=position_vector +step +inv +proj=cart +ellps=WGS84 +step +proj=utm +zone=31 +ellps=WGS84")


@query(PLACE + " SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, 100.0 AS height FROM c WHERE abs(lon - 3) < 30")
def operation_round_trip(spark, sf_dir):
    """Places after an operation with its epoch pinned, and back."""
    steps = operations.parse(operations.pinned(TO_UTM, 2015.5, ["+proj=helmert", "+proj=utm"]))
    p = places(spark, sf_dir).where("abs(lon - 3) < 30").withColumn("p", operations.apply(steps, F.col("lon"), F.col("lat"), F.lit(100.0)))
    back = p.withColumn("b", operations.apply(operations.inverted(steps), F.col("p.x"), F.col("p.y"), F.col("p.z")))
    return back.select("id", F.round("b.x", 6).alias("lon"), F.round("b.y", 6).alias("lat"), F.round("b.z", 3).alias("height"))


@query(SRV + """, e AS (SELECT aoi, workunit, (xmax - xmin) * (ymax - ymin) AS area FROM sv)
SELECT aoi, workunit, CAST(row_number() OVER (PARTITION BY aoi ORDER BY area DESC, workunit) AS INT) AS draw FROM e""")
def draw_order(spark, sf_dir):
    s = surveys(spark, sf_dir).withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))
    return catalog.draw_order(s, ["aoi"]).select("aoi", "workunit", "draw")


@query(GRID_SQL + """, s AS (SELECT 0 AS rank, * FROM g WHERE col < 450 UNION ALL SELECT 1, row, col, value + 1 FROM g WHERE col >= 200 UNION ALL SELECT 2, row, col, value + 2 FROM g)
SELECT row, col, arg_min(value, rank) AS value, CAST(min(rank) AS INT) AS "from" FROM s WHERE row BETWEEN 2 AND 60 AND col BETWEEN 150 AND 700 GROUP BY 1, 2""")
def merge_view_window(spark, sf_dir):
    """A window of a merge of three files, of which blocks that earlier ones hide are not opened."""
    geotiff.register(spark)
    whole, grid = _image_grid(spark, sf_dir)
    base, folder = written(whole, "image-grid"), new_path(spark, "merge").removeprefix("file://")
    parts = [base.where("col < 450"), base.where("col >= 200").withColumn("value", F.col("value") + 1), base.withColumn("value", F.col("value") + 2)]
    for k, part in enumerate(parts):
        geotiff.write(part, f"{folder}/{k}.tif", grid, block=64)
    merge_view.create(spark, [f"{folder}/{k}.tif" for k in range(3)], f"{folder}/view.json")
    return merge_view.read(spark, f"{folder}/view.json", row_min=2, row_max=60, col_min=150, col_max=700)


@query(PLACE + f""", q AS (SELECT id, CAST({geo.F_WGS84!r} AS DOUBLE) * (2 - CAST({geo.F_WGS84!r} AS DOUBLE)) AS e2 FROM c)
SELECT id, round(pow(CAST({geo.A} AS DOUBLE), 2) / 2 * radians(1 + id % 150) * (1 - e2) * (1 / (1 - e2) - ln((1 - sqrt(e2)) / (1 + sqrt(e2))) / (2 * sqrt(e2))) / 1e6, 1) AS km2 FROM q""")
def geodesic_area(spark, sf_dir):
    """Triangles of a pole and two places on the equator, whose sides, two meridians and the equator, are geodesics, anywhere around the globe."""
    width, lon = 1 + F.col("id") % 150, F.col("lon")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    pole = F.when(F.col("id") % 2 == 0, 90.0).otherwise(-90.0)
    ring = F.array(point(lon, F.lit(0.0)), point(lon + width / 2, F.lit(0.0)), point(lon + width, F.lit(0.0)), point(lon, pole))
    return places(spark, sf_dir).select("id", F.round(geodesic.polygon_area(F.array(F.array(ring))) / 1e6, 1).alias("km2"))
