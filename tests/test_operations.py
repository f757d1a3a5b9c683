"""Operations as pipelines, and geoid grids."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.functions import geo, operations
from stratagrid.sources import gtx

DEG = "+step +proj=unitconvert +xy_in=deg +xy_out=rad "
FRAME = "+step +proj=helmert +x=1.0053 +y=-1.9092 +z=-0.5416 +rx=0.0267814 +ry=-0.0004203 +rz=0.0109321 +s=0.00037 +dx=0.0008 +dy=-0.0006 +dz=-0.0014 +drx=6.67e-05 +dry=-0.0007574 +drz=-5.13e-05 +ds=-7e-05 +t_epoch=2010 +convention=coordinate_frame "
TO_UTM = "+proj=pipeline " + DEG + "+step +proj=cart +ellps=GRS80 " + FRAME + "+step +inv +proj=cart +ellps=WGS84 +step +proj=utm +zone=11 +ellps=WGS84"


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(k, rng.uniform(-120, -114), rng.uniform(-70, 75), rng.uniform(-50, 4000)) for k in range(300)], "id long, x double, y double, z double")


def back_and_forth(df, text):
    steps = operations.parse(text)
    there = df.withColumn("p", operations.apply(steps, F.col("x"), F.col("y"), F.col("z"), epoch=F.lit(2024.5)))
    back = operations.apply(operations.inverted(steps), F.col("p.x"), F.col("p.y"), F.col("p.z"), epoch=F.lit(2024.5))
    return there.withColumn("b", back).collect()


@pytest.mark.parametrize("text", [
    TO_UTM, "+proj=pipeline " + DEG + "+step +proj=utm +zone=11 +south", "+proj=pipeline " + DEG + "+step +proj=webmerc", "+proj=pipeline +step +proj=axisswap +order=2,-1 +step +proj=unitconvert +xy_in=us-ft +xy_out=m +z_in=ft +z_out=m",
    "+proj=pipeline " + DEG + "+step +proj=cart +ellps=WGS84", "+proj=pipeline " + DEG + "+step +proj=tmerc +lon_0=-117 +k=0.9999 +x_0=200000 +ellps=GRS80 +step +proj=axisswap +order=3,1,2",
])
def test_inverse_undoes_forward(places, text):
    for r in back_and_forth(places, text):
        assert abs(r["b"]["x"] - r["x"]) < 1e-8 and abs(r["b"]["y"] - r["y"]) < 1e-8 and abs(r["b"]["z"] - r["z"]) < 1e-3


def test_known_values(spark, places):
    # the library's own projections
    x, y = geo.utm(F.col("x"), F.col("y"), F.lit(11))
    p = operations.apply("+proj=pipeline " + DEG + "+step +proj=utm +zone=11 +ellps=WGS84", F.col("x"), F.col("y"))
    south = F.when(F.col("y") < 0, geo.UTM_SOUTH).otherwise(0.0)
    assert places.select(F.max(F.abs(p["x"] - x) + F.abs(p["y"] + south - y)).alias("d")).first()["d"] < 1e-3
    m = operations.apply("+proj=pipeline " + DEG + "+step +proj=webmerc", F.col("x"), F.col("y"))
    assert places.select(F.max(F.abs(m["x"] - geo.web_mercator(F.col("x"), F.col("y"))[0]) + F.abs(m["y"] - geo.web_mercator(F.col("x"), F.col("y"))[1]))).first()[0] < 1e-3
    # rates: 0.0008 m a year along x, at the pole of nothing else
    moved = "+proj=helmert +x=1 +dx=0.5 +t_epoch=2010"
    one = spark.range(1).select(operations.apply(moved, F.lit(10.0), F.lit(20.0), F.lit(30.0), epoch=F.lit(2014.0)).alias("p")).first()["p"]
    assert tuple(one) == (13.0, 20.0, 30.0)
    east = spark.range(1).select(operations.apply("+proj=pipeline " + DEG + "+step +proj=cart +ellps=WGS84", F.lit(90.0), F.lit(0.0), F.lit(100.0)).alias("p")).first()["p"]
    assert abs(east["x"]) < 1e-6 and abs(east["y"] - 6378237.0) < 1e-6 and abs(east["z"]) < 1e-6


def test_pinned_epochs(places):
    text = operations.pinned(TO_UTM, 2010.0, ["+proj=helmert", "+proj=utm"])
    assert text.startswith("+proj=pipeline +step +proj=set +v_4=2010 ") and text.endswith("+step +proj=set +v_4=2010") and operations.pinned(text, 2010.0) == text
    at = lambda t, e: places.orderBy("id").select(operations.apply(t, F.col("x"), F.col("y"), F.col("z"), epoch=None if e is None else F.lit(e)).alias("p")).first()["p"]
    # the epoch of the text counts, not that of the points; 14.5 years later the plate has moved a quarter of a metre or so
    assert at(text, 2024.5) == at(text, None) == at(TO_UTM, 2010.0)
    later, first = at(TO_UTM, 2024.5), at(TO_UTM, 2010.0)
    assert 0.1 < math.hypot(later["x"] - first["x"], later["y"] - first["y"]) < 0.6
    with pytest.raises(ValueError, match="lacks"):
        operations.pinned(TO_UTM, 2010.0, ["+proj=helmert", "vgridshift"])
    with pytest.raises(ValueError, match="t_epoch"):
        operations.pinned("+proj=helmert +x=1 +dx=0.5", 2010.0)


def test_refused():
    x = F.lit(1.0)
    for text, what in (("", "empty"), ("+proj=pipeline", "no steps"), ("+step +proj=utm", "behind"), ("+proj=pipeline +step +zone=3", "without"), ("+proj=lcc +lat_1=3", "not supported"), ("+proj=utm +zone=61", "no UTM zone"), ("+proj=vgridshift +grids=g.gtx", "undulation"), ("+proj=helmert +rx=1", "convention"), ("+proj=helmert +x=1 +dx=1 +t_epoch=2010", "epoch"), ("+proj=unitconvert +xy_in=mile", "no unit"), ("+proj=axisswap +order=1,1", "axes"), ("+proj=cart +ellps=moon", "ellipsoid")):
        with pytest.raises(ValueError, match=what):
            operations.apply(text, x, x, x)


def test_geoid_grids(spark, tmp_path):
    """Values between the four around a point, from a set of tiles, the first that holds the point."""
    n = 600
    lat, lon = np.meshgrid(30 + np.arange(n) * 0.01, -120 + np.arange(40) * 0.01, indexing="ij")
    west = -30 + 0.5 * (lat - 30) - 2 * (lon + 120)
    west[:3, :3] = np.nan
    gtx.write(f"{tmp_path}/w.gtx", 30.0, 240.0, 0.01, 0.01, west)
    gtx.write(f"{tmp_path}/e.gtx", 30.0, -119.8, 0.01, 0.01, np.full((n, 60), 7.0))
    values, grids = gtx.read(spark, [f"{tmp_path}/w.gtx", f"{tmp_path}/e.gtx"])
    assert values.count() == n * 40 - 9 + n * 60 and grids[0].west == -120
    rows = [(0, -119.9, 33.333), (1, -119.7031, 32.0), (2, -119.3, 32.0), (3, -119.99, 30.01), (4, -100.0, 32.0), (5, -119.61, 35.99), (6, None, 32.0), (7, -119.9, 33.333), (8, 240.1, 33.333)]
    points = spark.createDataFrame(rows, "id long, lon double, lat double")
    got = {r["id"]: r["undulation"] for r in gtx.with_undulation(points, values, grids).collect()}
    plane = lambda x, y: -30 + 0.5 * (y - 30) - 2 * (x + 120)
    want = {0: plane(-119.9, 33.333), 1: plane(-119.7031, 32.0), 2: 7.0, 3: None, 4: None, 5: plane(-119.61, 35.99), 6: None, 7: plane(-119.9, 33.333), 8: plane(-119.9, 33.333)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-4), (k, got, want)
    step = operations.apply("+proj=pipeline " + DEG + "+step +inv +proj=vgridshift +grids=w.gtx,e.gtx", F.col("lon"), F.col("lat"), F.lit(700.0), undulation=F.col("undulation"))
    heights = {r["id"]: r["p"]["z"] for r in gtx.with_undulation(points, values, grids).select("id", step.alias("p")).collect()}
    assert abs(heights[0] - 700 - want[0]) < 1e-4 and heights[4] is None
    (tmp_path / "bad.gtx").write_bytes((tmp_path / "w.gtx").read_bytes()[:-4])
    with pytest.raises(ValueError, match="not whole"):
        gtx.header(f"{tmp_path}/bad.gtx")
