"""Geodesic areas, selectors, checks before work, functions on tiles."""

import math

import pytest
from pyspark.sql import functions as F

from stratagrid.functions import geodesic
from stratagrid.operators import catalog, points
from stratagrid.plans import batch

#: (latitude, longitude): a coarse outline of Antarctica, whose area is published with a well-known library (13,662,703,680,020.1 m2).
ANTARCTICA = [(-63.1, -58), (-72.9, -74), (-71.9, -102), (-74.9, -102), (-74.3, -131), (-77.5, -163), (-77.4, 163), (-71.7, 172), (-65.9, 140), (-65.7, 113), (-66.6, 88), (-66.9, 59), (-69.8, 25), (-70.0, -4), (-71.0, -14), (-77.3, -33), (-77.9, -46), (-74.7, -61)]


def test_known_areas():
    lat, lon = zip(*ANTARCTICA)
    assert geodesic.ring_area(lon, lat) == pytest.approx(13662703680020.1, rel=1e-6)
    assert geodesic.ring_area(lon[::-1], lat[::-1]) == pytest.approx(13662703680020.1, rel=1e-6)
    # an eighth of the globe: its sides are two meridians and the equator
    globe = 510065621724088.44
    assert geodesic.ring_area([0, 90, 0], [0, 0, 90]) == pytest.approx(globe / 8, rel=1e-8)
    assert geodesic.ring_area([-180, -90, 0, 90], [0, 0, 0, 0]) == pytest.approx(globe / 2, rel=1e-8)
    # the same box anywhere around the globe, over the antimeridian too
    box = lambda w: geodesic.ring_area([w, w + 1, w + 1, w], [40, 40, 41, 41])
    assert box(179.5) == pytest.approx(box(10), rel=1e-9) == pytest.approx(box(-180.5), rel=1e-9)
    assert geodesic.ring_area([10, 11, 11, 10, 10], [40, 40, 41, 41, 40]) == pytest.approx(box(10), rel=1e-12)
    # the side along 40 degrees north bows towards the pole, so less is left above it than above the parallel, and the upper one gives back a little less
    q = geodesic._authalic
    import numpy as np

    parallel = math.radians(1) * geodesic.A**2 / 2 * float(q(np.array(math.radians(41))) - q(np.array(math.radians(40))))
    assert 0 < abs(box(10) / parallel - 1) < 1e-3
    assert geodesic.ring_area([1, 2], [1, 2]) == 0.0
    with pytest.raises(ValueError, match="opposite"):
        geodesic.ring_area([0, 179.7, 90], [0.2, 0.1, 45])


def test_area_of_parts(spark):
    ring = lambda w, s, e, n: [{"x": float(x), "y": float(y)} for x, y in ((w, s), (e, s), (e, n), (w, n))]
    rows = [(1, [[ring(0, 0, 2, 2), ring(0.5, 0.5, 1, 1)], [ring(5, 5, 6, 6)]]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "id int, parts array<array<array<struct<x: double, y: double>>>>")
    got = {r["id"]: r for r in df.withColumn("m2", geodesic.polygon_area(F.col("parts"))).withColumn("note", geodesic.size_note(F.col("m2"))).collect()}
    one = lambda w, s, e, n: geodesic.ring_area([w, e, e, w], [s, s, n, n])
    assert got[1]["m2"] == pytest.approx(one(0, 0, 2, 2) - one(0.5, 0.5, 1, 1) + one(5, 5, 6, 6)) and got[2]["m2"] is None and got[3]["m2"] == 0
    assert "very large" in got[1]["note"] and got[3]["note"] is None


def test_selectors_and_checks(spark):
    assert batch.local_project("auto") is None and batch.local_project(" WU_1 ") == "WU_1"
    for bad in ("latest", "a,b", "all", "", "x/y", "auto,a"):
        with pytest.raises(ValueError):
            batch.local_project(bad)

    def fails():
        raise OSError("no network")

    assert batch.prefetched(lambda: 7, "auto") == 7
    with pytest.warns(UserWarning, match="no network"):
        assert batch.prefetched(fails, "list") is None
    with pytest.raises(OSError):
        batch.prefetched(fails, "latest")
    done = []
    with pytest.raises(ValueError, match="a resolution above 0; a folder .no network."):
        batch.validated({"a resolution above 0": lambda: False, "a name": lambda: True, "a folder": fails}, lambda: done.append(1))
    assert not done and batch.validated({"a name": lambda: True}, lambda: 3) == 3


def test_functions_on_tiles(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("tile"), F.col("id").cast("double").alias("z"))
    got = points.on_tiles(df, lambda pdf: pdf.groupby("tile", as_index=False)["z"].median(), "tile long, z double")
    assert {r["tile"]: r["z"] for r in got.collect()} == {k: sum(sorted(range(k, 300, 3))[49:51]) / 2 for k in range(3)}
    with pytest.raises(ValueError, match="more than 99"):
        points.on_tiles(df, lambda pdf: pdf, "tile long, z double", most=99)


def test_catalog_counts(spark):
    s = spark.createDataFrame([(1, "a", 1, 5.0), (1, "b", 1, 9.0), (1, "c", 2, None), (2, "d", 7, 1.0)], "aoi int, workunit string, epoch int, area double")
    assert {r["aoi"]: r["n_epochs"] for r in catalog.distinct_epochs(s, ["aoi"]).collect()} == {1: 2, 2: 1}
    assert {r["workunit"]: r["draw"] for r in catalog.draw_order(s, ["aoi"]).collect()} == {"c": 1, "b": 2, "a": 3, "d": 1}
    gaps = spark.createDataFrame([(1, 0.25), (1, 0.5), (2, 0.1)], "aoi int, gap_frac double")
    assert {r["aoi"]: (r["open_frac"], r["n_gaps"]) for r in catalog.open_share(gaps, ["aoi"]).collect()} == {1: (0.75, 2), 2: (0.1, 1)}
