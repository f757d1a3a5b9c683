"""Goldens, brute force and plans of the library's own operators."""

import math
import random
import struct
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.functions import geo, geodesy, text
from stratagrid.operators import catalog, conformance, merge, points, polygons, preflight, products, raster, reports, staging, vendor
from stratagrid.plans import batch
from stratagrid.sources import las, readers, writers
from stratagrid.streaming import epochs

POINT = "x double, y double, z double, cls int, rn int, nr int, intensity double, tile long"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def tile(spark):
    rng = random.Random(42)
    rows = []
    for k in range(200):
        x, y, z = round(rng.uniform(0, 20), 2), round(rng.uniform(0, 20), 2), round(100 + rng.uniform(0, 3), 2)
        cls, rn, nr = rng.choice([1, 2]), 1, 1
        if k < 20:
            rn, nr, cls, z = 2, 2, 2, 99.5
        elif k < 25:
            cls, z = 7, 50.0
        elif k < 30:
            cls, z = 18, 400.0
        elif k < 33:
            cls, z = 1, 150.0
        rows.append((x, y, z, cls, rn, nr, float(rng.randint(100, 1999)), 0))
    return rows, spark.createDataFrame(rows, POINT)


def test_lattice_goldens(spark):
    x = F.lit(10)
    assert one(spark, geo.nearest_floor(x, 4), geo.nearest_ceil(x, 4)) == (8, 12)
    got = one(spark, *[f(F.lit(v), 2) for f, v in ((geo.nearest_floor, 363111), (geo.nearest_floor, 4290903), (geo.nearest_ceil, 374892), (geo.nearest_ceil, 4298725))])
    assert tuple(got) == (363110, 4290902, 374892, 4298726)


def brute_idw(rows, radius, keep, value):
    out = {}
    for p in rows:
        if keep(p):
            for col in range(int(p[0]) - 3, int(p[0]) + 4):
                for row in range(int(p[1]) - 3, int(p[1]) + 4):
                    d = math.hypot(p[0] - col - 0.5, p[1] - row - 0.5)
                    if d <= radius:
                        out.setdefault((row, col), []).append((d, p[value]))
    return {k: np.average([v for _, v in x], weights=[1 / d for d, _ in x]) for k, x in out.items() if min(d for d, _ in x) > 0}


def test_idw_against_brute_force(tile):
    rows, df = tile
    got = {(r["row"], r["col"]): r["value"] for r in points.grid_idw(points.ground_only(df), 1.0, 1.5).collect()}
    want = brute_idw(rows, 1.5, lambda p: p[3] == 2, 2)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and len(got) >= len(want)


def test_one_pass_equals_single_products(tile):
    _, df = tile
    together = points.grid_products(df, points.products(), 1.0, 1.5)
    for p in points.products():
        alone = {(r["row"], r["col"]): r["value"] for r in points.grid_idw(df.where(p.where), 1.0, 1.5, value=p.value).collect()}
        both = {(r["row"], r["col"]): r[p.name] for r in together.collect() if r[p.name] is not None}
        assert alone.keys() == both.keys() and all(abs(alone[k] - both[k]) < 1e-9 for k in alone)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tile, tmp_path):
    _, df = tile
    path = str(tmp_path / "points")
    writers.write_points(df, path)
    read = spark.read.parquet(path)
    grids = plan(points.grid_products(read, points.products(), 1.0))
    assert grids.count("FileScan") == 1 and grids.count("Exchange hashpartitioning") == 1
    assert "Join" not in grids and "PushedFilters: [IsNotNull" in plan(points.ground_only(read).select("x")) or "EqualTo(cls,2)" in plan(points.ground_only(read).select("x"))
    boxes = spark.createDataFrame([(1, 0, 0, 5, 5)], "id int, xmin int, ymin int, xmax int, ymax int")
    joined = plan(staging.tiles_in_boxes(boxes.drop("id"), boxes, ["id"], 4.0))
    assert "NestedLoop" not in joined and "Cartesian" not in joined
    assert "NestedLoop" not in plan(points.height_above_ground(read))


def test_filters(tile):
    rows, df = tile
    assert points.drop_classes(df, 7, 18).count() == 190
    assert df.where(points.return_group(("first", "only"))).count() == 180
    with pytest.raises(ValueError):
        points.return_group(("second",))
    marked = points.mark_high_z(df, 0.98)
    z = np.array([r[2] for r in rows])
    high = (z - z.mean()) / z.std() > NormalDist().inv_cdf(0.98)
    assert marked.where("cls = 18").count() == sum(h or r[3] == 18 for h, r in zip(high, rows))
    flat = df.withColumn("z", F.lit(1.0))
    assert points.mark_high_z(flat, 0.5).where("cls = 18").count() == 5
    assert points.drop_classes(df.withColumn("cls", F.lit(None).cast("int")), 7).count() == 200


def test_height_above_ground(tile):
    rows, df = tile
    ground = [r for r in rows if r[3] == 2]
    got = {(r["x"], r["y"], r["z"]): r["hag"] for r in points.height_above_ground(df, bucket=0.5).collect()}
    for r in rows:
        _, gz = min(((r[0] - g[0]) ** 2 + (r[1] - g[1]) ** 2, g[2]) for g in ground)
        assert abs(got[r[:3]] - (r[2] - gz)) < 1e-9
    none = points.height_above_ground(df.where("cls = 1")).select("hag").distinct().collect()
    assert [r[0] for r in none] == [None]


def long(spark, array, source="a"):
    rows = [(source, int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(array) if not np.isnan(v)]
    return spark.createDataFrame(rows, "source string, row long, col long, value double")


def test_merge_priority(spark):
    a, b = np.full((4, 32), np.nan), np.full((4, 32), np.nan)
    a[:, :20], b[:, 12:] = 100, 200
    both = long(spark, a, "a").unionByName(long(spark, b, "b"))
    got = {(r["row"], r["col"]): r["value"] for r in raster.mosaic(both, "source", last_wins=False).collect()}
    assert all(v == (100 if c < 20 else 200) for (_, c), v in got.items()) and len(got) == 128
    with pytest.raises(ValueError):
        merge.check_grids(spark.createDataFrame([("a", 0.0, 0.0, 1.0, 4, 4, "c"), ("b", 1.0, 0.0, 1.0, 4, 4, "c")], "source string, origin_x double, origin_y double, res double, width int, height int, crs string"))


def test_intensity_ramp(spark):
    g = np.tile(np.linspace(0, 1, 64), (64, 1))
    a, b = 10000 + g * 30000, 45000 + g * 10000
    a[:, 40:], b[:, :24] = np.nan, np.nan
    both = long(spark, np.round(a), "a").unionByName(long(spark, np.round(b), "b"))
    fits, out = merge.normalize(both, ["a", "b"], min_overlap=100)
    assert [f[3] for f in fits] == ["global-stretch", "overlap-refined"]
    values = {(r["row"], r["col"]): r["value"] for r in out.collect()}
    assert len(values) == 64 * 64 and all(1000 <= v <= 60000 for v in values.values())
    gain, offset = fits[0][1:3]
    for at in (0.4, 0.5, 0.6):
        left, right = (10000 + at * 30000) * gain + offset, (45000 + at * 10000) * fits[1][1] + fits[1][2]
        assert abs(left - right) < 0.02 * 59000
    assert merge.normalize(both, ["a"])[0] == [("a", 1.0, 0.0, "raw")]


def test_hillshade_against_numpy(spark):
    z = np.random.default_rng(1).normal(0, 1, (9, 7))
    gy, gx = np.gradient(z, 2.0, 3.0)
    slope, aspect = np.pi / 2 - np.arctan(np.hypot(gx, gy)), np.arctan2(-gx, gy)
    az, alt = np.radians(360 - 315 + 90), np.radians(45)
    want = np.clip(np.sin(alt) * np.sin(slope) + np.cos(alt) * np.cos(slope) * np.cos(az - np.pi / 2 - aspect), 0, 1)
    for r in raster.hillshade(long(spark, z), 3.0, 2.0).collect():
        assert abs(r["shade"] - want[r["row"], r["col"]]) < 1e-9


def test_window_fill(spark):
    z = np.full((9, 9), np.nan)
    z[4, 4], z[4, 6] = 10.0, 20.0
    got = {(r["row"], r["col"]): (r["value"], r["filled"]) for r in raster.window_fill(long(spark, z), 2).collect()}
    assert got[4, 5] == (15.0, True) and got[4, 4] == (10.0, False) and (0, 0) not in got


def test_window_fill_over_blocks_and_rasters(spark, monkeypatch):
    """Cells near a block's edge, below zero too, are filled from both sides, and each raster from its own cells."""
    rng = random.Random(8)
    cells = {(s, rng.randint(-300, 300), rng.randint(-20, 20)): rng.uniform(0, 9) for s in "ab" for _ in range(900)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, row long, col long, value double").repartition(3)
    want = {k: (v, False) for k, v in cells.items()}
    around = {(s, r + a, c + b) for s, r, c in cells for a in range(-2, 3) for b in range(-2, 3)} - cells.keys()
    for s, r, c in around:
        near = [(cells[s, r + a, c + b], math.hypot(a, b) ** -1.5) for a in range(-2, 3) for b in range(-2, 3) if (s, r + a, c + b) in cells]
        want[s, r, c] = (sum(v * w for v, w in near) / sum(w for _, w in near), True)
    for block in (256, 7):
        monkeypatch.setattr(raster, "BLOCK", block)
        got = {(r["source"], r["row"], r["col"]): (r["value"], r["filled"]) for r in raster.window_fill(df, 2, 1.5, by=["source"]).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert {(r["source"], r["row"], r["col"]): r["value"] for r in raster.mosaic(df, "row", by=["source"]).collect()} == cells


def test_area_of_a_long_ring(spark):
    n = 1_000_100
    ring = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.cos(k * (2 * math.pi / n)).alias("x"), F.sin(k * (2 * math.pi / n)).alias("y")))
    assert abs(one(spark, geo.ring_area(ring))[0] - math.pi) < 1e-6


def test_datum_state(spark):
    for median, n, want in ((0.4, 500, "true"), (-30.2, 500, "false"), (-10.0, 500, "error"), (8.0, 500, "error"), (0.4, 10, "error"), (None, 500, "error")):
        assert one(spark, raster.datum_state(F.lit(median).cast("double"), F.lit(n), F.lit(-31.0)))[0] == want
    with pytest.raises(Exception, match="datum"):
        one(spark, raster.datum_state(F.lit(-10.0), F.lit(500), F.lit(-31.0), fail=True))


def test_footprint(spark):
    z = np.full((100, 100), np.nan)
    z[:, :50] = 1.0
    assert raster.footprint_area(long(spark, z), 0.5).first()["area"] == 1250
    assert raster.footprint_edges(long(spark, z)).count() == 300


def test_overview_keeps_place(spark):
    i, j = np.mgrid[:128, :128]
    z = np.exp(-((i - 54.3) ** 2 + (j - 85.45) ** 2) / 72)
    for level in (2, 4, 8):
        o = raster.overviews(long(spark, z), (level,)).agg((F.sum((F.col("row") + 0.5) * F.col("value")) / F.sum("value")).alias("r"), (F.sum((F.col("col") + 0.5) * F.col("value")) / F.sum("value")).alias("c")).first()
        assert abs(o["r"] * level - 54.8) < 0.25 and abs(o["c"] * level - 85.95) < 0.25


def test_names(spark):
    surveys = spark.createDataFrame([("CO_West_2019",), ("AZ_Flag",), ("NM_x-y",), ("none",), (None,)], "workunit string")
    ept = spark.createDataFrame([("CO_West_2019", 5), ("co_west_2019", 500), ("USGS_LPC_az_flag_LAS_2018", 9), ("USGS_LPC_AZ_FLAG_LAS_2018", None), ("usgs_lpc_none", 1), ("NM_X_Y", 3)], "name string, count long")
    got = {r["workunit"]: (r["tier"], r["resource"]) for r in catalog.resolve_names(surveys, ept).collect()}
    assert got == {"CO_West_2019": (1, "CO_West_2019"), "AZ_Flag": (3, "USGS_LPC_az_flag_LAS_2018"), "NM_x-y": (4, "NM_X_Y")}


SURVEYS = "aoi int, workunit string, start timestamp_ntz, end timestamp_ntz, ql string, overlap double, category string, geoid string"


def test_ranking(spark):
    from datetime import datetime as d

    rows = [(1, "A", d(2019, 1, 1), d(2019, 2, 1), "QL 2", 0.9, "Meets", "g"), (1, "B", d(2023, 1, 1), d(2023, 2, 1), "QL 1", 0.5, "Meets", None), (1, "C", d(2021, 1, 1), d(2021, 2, 1), "QL 0", 0.7, None, "g"),
            (2, "U", None, None, None, 0.9, None, None), (2, "V", None, None, None, 0.95, None, None)]
    df = spark.createDataFrame(rows, SURVEYS)
    latest = {r["aoi"]: (r["workunit"], r["undated"], r["n_candidates"]) for r in catalog.select_latest(df, ["aoi"]).collect()}
    assert latest == {1: ("B", False, 3), 2: ("V", True, 2)}
    related = catalog.relative_metrics(df, ["aoi"])
    ranked = [r["workunit"] for r in catalog.rank_collections(related, ["aoi"]).where("aoi = 1").orderBy("priority").collect()]
    assert ranked == ["A", "B", "C"]
    assert not related.where("workunit = 'B'").first()["same_geoid"]
    ep = {r["workunit"]: r["epoch"] for r in catalog.assign_epochs(df, ["aoi"], ["workunit"]).collect()}
    assert ep == {"A": "2019", "C": "2021", "B": "2023", "U": "undated", "V": "undated"}


def test_coverage_and_gaps(spark):
    area = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "aoi int, xmin double, ymin double, xmax double, ymax double")
    boxes = spark.createDataFrame([(1, "A", -1.0, -1.0, 0.5, 2.0), (1, "B", 0.75, 0.0, 0.8, 1.0)], "aoi int, workunit string, xmin double, ymin double, xmax double, ymax double")
    assert {r["workunit"]: round(r["share"], 9) for r in catalog.coverage(boxes, area, ["aoi"]).collect()} == {"A": 0.5, "B": 0.05}
    assert round(catalog.union_coverage(boxes, area, ["aoi"]).first()["covered_frac"], 9) == 0.55
    gaps = catalog.coverage_gaps(boxes, area, ["aoi"]).orderBy("xmin").collect()
    assert [round(g["gap_frac"], 9) for g in gaps] == [0.25, 0.2]
    assert round(catalog.coverage_gaps(boxes.limit(0), area, ["aoi"]).first()["gap_frac"], 9) == 1
    with pytest.raises(Exception, match="extent"):
        catalog.coverage(boxes, area.withColumn("xmax", F.col("xmin")), ["aoi"]).collect()


def test_coverage_takes_no_resources(spark):
    area = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "aoi int, xmin double, ymin double, xmax double, ymax double")
    with pytest.raises(TypeError):
        catalog.coverage(area, area, ["aoi"], resources=area)


def test_equal_area_share(spark):
    north, whole = one(spark, geo.box_area_m2(F.lit(-150.0), F.lit(65.0), F.lit(-140.0), F.lit(70.0)), geo.box_area_m2(F.lit(-150.0), F.lit(60.0), F.lit(-140.0), F.lit(70.0)))
    assert abs(north / whole - 0.453) < 0.005


def test_grid_squares(spark):
    for ident, zone, east, north in (("11SMA000000", 11, 400000, 4000000), ("11SMB000000", 11, 400000, 4100000), ("11SNA000000", 11, 500000, 4000000), ("11SNV000000", 11, 500000, 3900000), ("11SPV000000", 11, 600000, 3900000)):
        assert tuple(one(spark, *geo.grid_square(F.lit(ident), zone))) == (east, north)
    assert tuple(one(spark, *geo.grid_square(F.lit("MA870940"), 11, F.lit(4e6)))) == (487000, 4094000)
    assert abs(one(spark, geo.band_northing(F.lit("L")))[0] - 8668648) < 50_000 and abs(one(spark, geo.band_northing(F.lit("S")))[0] - 3994056) < 50_000
    assert one(spark, geo.utm_label(F.lit(32611)))[0] == "11N"


def test_utm_known_point(spark):
    # the false origin, and a quadrant's length along the central meridian
    e, n = one(spark, *geo.utm(F.lit(-117.0), F.lit(0.0), F.lit(11)))
    assert abs(e - 500000) < 1e-6 and abs(n) < 1e-6
    _, n = one(spark, *geo.utm(F.lit(-117.0), F.lit(90.0), F.lit(11)))
    assert abs(n / 0.9996 - 10001965.729) < 0.01


def test_reconcile(spark):
    for t, n, want in ((0, 10626, "tesm-missing"), (195, 195, "consistent"), (500, None, "links-unavailable"), (5000, 200, "links-behind-tesm"), (None, 3, "tesm-unavailable"), (0, 0, "no-tiles"), (90, 100, "tesm-incomplete")):
        assert one(spark, staging.reconcile(F.lit(t).cast("long"), F.lit(n).cast("long")))[0] == want


def test_reports(spark):
    df = spark.createDataFrame([("w", 1, "x"), ("w", 2, "RMSEr"), ("w", 3, "about"), ("w", 4, "0.19 m"), ("w", 5, "RMSEr"), ("v", 1, "RMSEr")], "wu string, no long, line string")
    value = F.nullif(F.regexp_extract("line", r"(\d+\.\d+) m$", 1), F.lit(""))
    got = reports.look_ahead(df, ["wu"], "no", F.col("line") == "RMSEr", value).orderBy("wu", "no").collect()
    assert [(r["wu"], r["found"]) for r in got] == [("v", None), ("w", "0.19"), ("w", None)]
    xml = "<a><begdate>\n 20230618 </begdate></a>"
    assert one(spark, text.tag(F.lit(xml), "begdate"), text.iso_date(text.tag(F.lit(xml), "begdate")), text.tag(F.lit(xml), "nope")) == ("20230618", "2023-06-18", None)
    assert one(spark, text.metres(F.lit(10.7), F.lit("cm")))[0] == 0.107
    assert one(spark, text.grid_names(F.lit("+grids=a.tif,b.tif +x +grids=a.tif")))[0] == ["a.tif", "b.tif"]


def test_batch():
    assert batch.parse_products("all") == list(batch.PRODUCTS) and batch.parse_products("intensity,dsm") == ["dsm", "intensity"] and batch.parse_products("dtm") == ["dtm", "dtm_fill"]
    for bad in ("", "bogus"):
        with pytest.raises(ValueError):
            batch.parse_products(bad)
    assert batch.surface_method("98-pct") == ("max", 0.98)
    for bad in ("100-pct", "max"):
        with pytest.raises(ValueError):
            batch.surface_method(bad)
    assert batch.check_resume({"a": 1}, {"a": 1, "b": 2}, ["a", "b"]) == ["b"]
    with pytest.raises(ValueError, match="resume"):
        batch.check_resume({"a": 1}, {"a": 2}, ["a"])
    assert batch.selector("latest") == ("latest", []) and batch.selector("X, Y") == ("list", ["X", "Y"])
    for bad in ("", "a/b", "all", "auto,X"):
        with pytest.raises(ValueError):
            batch.selector(bad)


def write_las(path, n, kind=6):
    length = {0: 20, 1: 28, 6: 30}[kind]
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HIIBHI", head, 94, 375, 375, 0, kind, length, n)
    struct.pack_into("<12d", head, 131, 0.01, 0.01, 0.01, 500000, 4000000, 0, 500100, 500000, 4000100, 4000000, 10, 0)
    rows = b""
    for k in range(n):
        r = bytearray(length)
        struct.pack_into("<iiiH", r, 0, k * 100, k * 50, k, 1000 + k)
        if kind >= 6:
            r[14], r[16] = 1 | 2 << 4, 2
            struct.pack_into("<Hd", r, 20, 11, 3e8 + k)
        else:
            r[14], r[15] = 1 | 2 << 3, 2
            struct.pack_into("<H", r, 18, 11)
        rows += bytes(r)
    path.write_bytes(bytes(head) + rows)


def test_las_source(spark, tmp_path):
    las.register(spark)
    write_las(tmp_path / "a.las", 10)
    write_las(tmp_path / "b.las", 7, 0)
    df = spark.read.format("las").option("part", "4").load(str(tmp_path))
    assert df.count() == 17
    r = df.where("file LIKE '%a.las' AND intensity = 1003").first()
    assert (r["x"], r["y"], round(r["z"], 6), r["rn"], r["nr"], r["cls"], r["source_id"], r["gps_time"]) == (500003.0, 4000001.5, 0.03, 1, 2, 2, 11, 3e8 + 3)
    assert df.where("file LIKE '%b.las' AND gps_time IS NULL").count() == 7
    far = spark.read.format("las").options(xmin="0", ymin="0", xmax="1", ymax="1").load(str(tmp_path))
    assert far.count() == 0
    (tmp_path / "c.laz").write_bytes((tmp_path / "a.las").read_bytes()[:104] + b"\x86" + (tmp_path / "a.las").read_bytes()[105:])
    with pytest.raises(Exception, match="compressed"):
        spark.read.format("las").load(str(tmp_path)).count()


def test_geojson_keeps_all_parts_and_holes(spark, tmp_path):
    square = lambda x, y, n: f"[[{x},{y}],[{x + n},{y}],[{x + n},{y + n}],[{x},{y + n}],[{x},{y}]]"
    multi = f'{{"type":"Feature","properties":{{"name":"m"}},"geometry":{{"type":"MultiPolygon","coordinates":[[{square(0, 0, 4)},{square(1, 1, 1)}],[{square(10, 20, 2)}]]}}}}'
    single = f'{{"type":"Feature","properties":{{"name":"s"}},"geometry":{{"type":"Polygon","coordinates":[{square(0, 0, 4)},{square(2, 2, 1)}]}}}}'
    none = '{"type":"Feature","properties":{"name":"z"},"geometry":null}'
    (tmp_path / "m.json").write_text(f'{{"type":"FeatureCollection","features":[{multi},{single},{none}]}}')
    g = readers.geojson(spark, str(tmp_path / "m.json"), ["name"])
    got = {r["name"]: r for r in g.collect()}
    areas = {r["name"]: r["a"] for r in g.select("name", F.transform("parts", lambda p: F.transform(p, geo.ring_area)).alias("a")).collect()}
    assert areas == {"m": [[16, 1], [4]], "s": [[16, 1]], "z": None}
    assert [tuple(got[n][c] for c in ("xmin", "ymin", "xmax", "ymax")) for n in "msz"] == [(0, 0, 12, 22), (0, 0, 4, 4), (None,) * 4]
    assert readers.in_box(g, 11, 21, 30, 30).count() == 1


def test_readers_and_writers(spark, tmp_path):
    df, there = readers.with_schema(spark.createDataFrame([("w",)], "Workunit string"), readers.SURVEY)
    assert there == ["workunit"] and df.first()["ql"] is None and len(df.columns) == 16
    (tmp_path / "a.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"n"},"geometry":{"type":"Polygon","coordinates":[[[0,1],[4,1],[4,3],[0,3],[0,1]]]}}]}')
    g = readers.geojson(spark, str(tmp_path / "a.json"), ["name"])
    r = g.select("name", "xmin", "ymin", "xmax", "ymax", geo.ring_area(F.col("ring")).alias("a")).first()
    assert tuple(r) == ("n", 0, 1, 4, 3, 8)
    (tmp_path / "links.txt").write_text(" a \n\n b\n")
    assert [x[0] for x in readers.link_list(spark, str(tmp_path / "links.txt")).collect()] == ["a", "b"]
    grids = spark.createDataFrame([(0, 0, 1.0, None), (0, 1, None, 2.0)], "row int, col int, dsm double, dtm double")
    writers.write_products(grids, str(tmp_path / "out"), ["dsm", "dtm"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    writers.write_inventory(spark.createDataFrame([(7, "k")], "size long, key string"), str(tmp_path / "inv"))
    assert spark.read.text(str(tmp_path / "inv")).first()[0] == "           7 k"
    writers.write_records(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "rec"))
    assert spark.read.text(str(tmp_path / "rec")).first()[0] == '{"b":1,"a":null}'
    xml = spark.createDataFrame([("<L><Contents><Key>a/b.pdf</Key><Size>5</Size></Contents><Contents><Key>c</Key><Size>6</Size></Contents></L>",)], "xml string")
    assert [tuple(r) for r in readers.bucket_listing(xml).collect()] == [("a/b.pdf", 5), ("c", 6)]


def test_stream_equals_table(spark, tmp_path):
    from datetime import datetime, timedelta

    rng = random.Random(1)
    rows = [(rng.randint(1, 3), datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 5000))) for _ in range(100)]
    df = spark.createDataFrame(rows, "key int, ts timestamp")
    path = str(tmp_path / "s")
    df.coalesce(1).write.parquet(path)
    want = sorted(map(tuple, epochs.epoch_sessions(df, "key", "ts", "2 hours", "1 day").collect()))
    stream = epochs.epoch_sessions(spark.readStream.schema(df.schema).parquet(path), "key", "ts", "2 hours", "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM sessions").collect())) == want


def test_ground_classification(spark):
    rows = []
    for i in range(30):
        for j in range(30):
            house = 10 <= i < 15 and 10 <= j < 15
            rows.append((i + 0.5, j + 0.5, 100 + 0.05 * i + (6.0 if house else 0.0), 0, 1, 1, 0.0, 0))
            if i % 7 == 0:
                rows.append((i + 0.4, j + 0.4, 103.0 + 0.05 * i, 0, 1, 1, 0.0, 0))
    out = points.classify_ground(spark.createDataFrame(rows, POINT)).collect()
    for r in out:
        ground = abs(r["z"] - 100 - 0.05 * (r["x"] - 0.5)) < 0.3
        assert r["cls"] == (2 if ground else 1), r
    assert len(out) == len(rows)


def test_geodesy(spark):
    assert one(spark, geodesy.nice_length(F.lit(2500.0)), geodesy.nice_length(F.lit(8000.0)), geodesy.nice_length(F.lit(0.6))) == (500, 2000, 0.1)
    with pytest.raises(Exception, match="vertical grid"):
        one(spark, geodesy.swap_vertical_grids(F.lit("+proj=utm"), F.lit("g.tif")))
    assert one(spark, geodesy.lon_in(F.lit(-179.0), F.lit(170.0), F.lit(-150.0)))[0]


SHAPE = "aoi int, workunit string, parts array<array<array<struct<x: double, y: double>>>>"


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def square(w, s, e, n):
    return ring((w, s), (e, s), (e, n), (w, n))


def test_polygon_coverage_goldens(spark):
    areas = spark.createDataFrame([(1, "", [[square(0, 0, 1, 1)]]), (2, "", [[square(-150, 60, -140, 70)]])], SHAPE)
    surveys = spark.createDataFrame([(1, "A", [[square(-1, -1, 0.5, 2)]]), (1, "B", [[square(-1, -1, 2, 2)]]), (1, "far", [[square(5, 5, 6, 6)]]), (2, "north", [[square(-151, 65, -139, 71)]]), (2, "null", None)], SHAPE)
    builds = spark.createDataFrame([("left", [[square(-1, -1, 0.5, 2)]]), ("far", [[square(9, 9, 10, 10)]])], "name string, parts array<array<array<struct<x: double, y: double>>>>")
    pieces = polygons.overlay(areas, surveys, ["aoi"], resources=builds)
    got = {r["workunit"]: r for r in polygons.inventory(pieces, surveys, ["aoi"]).collect()}
    assert got.keys() == {"A", "B", "north"}
    assert abs(got["A"]["aoi_overlap_frac"] - 0.5) < 1e-9 and abs(got["B"]["aoi_overlap_frac"] - 1) < 1e-9 and abs(got["north"]["aoi_overlap_frac"] - 0.453) < 0.005
    assert abs(got["A"]["ept_coverage_frac"] - 1) < 1e-9 and abs(got["B"]["ept_coverage_frac"] - 0.5) < 1e-9
    assert got["B"]["ept_names"] == ["left"] and got["north"]["ept_names"] == []
    assert [round(r["gap_frac"], 3) for r in polygons.gaps(pieces, ["aoi"]).collect()] == [round(1 - got["north"]["aoi_overlap_frac"], 3)]
    only_a = polygons.gaps(polygons.overlay(areas.where("aoi = 1"), surveys.where("workunit = 'A'"), ["aoi"]), ["aoi"]).collect()
    assert len(only_a) == 1 and abs(only_a[0]["gap_frac"] - 0.5) < 1e-9
    bare = polygons.gaps(polygons.overlay(areas.where("aoi = 1"), surveys.limit(0), ["aoi"]), ["aoi"]).collect()
    assert [r["gap_frac"] for r in bare] == [1.0]
    with pytest.raises(ValueError, match="without extent"):
        polygons.overlay(spark.createDataFrame([(1, "", [[ring((0.2, 0.2), (0.2, 0.2), (0.2, 0.2))]])], SHAPE), surveys, ["aoi"])


def inside(parts, x, y):
    """Even-odd rule, on arrays of points."""
    out = np.zeros(x.shape, bool)
    for r in (r for p in parts for r in p):
        for a, b in zip(r, r[1:] + r[:1]):
            if a["y"] != b["y"]:
                out ^= ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    return out


@pytest.mark.parametrize("per_strip, per_tile, per_cell", [(400, 2_000, 24), (12, 10, 24), (12, 30, 3)])
def test_polygon_coverage_against_a_fine_grid(spark, monkeypatch, per_strip, per_tile, per_cell):
    monkeypatch.setattr(polygons, "EDGES", per_strip)
    monkeypatch.setattr(polygons, "TILE_EDGES", per_tile)
    monkeypatch.setattr(polygons, "CELL_EDGES", per_cell)
    rng = random.Random(6)
    triangle = lambda size: ring(*[(x0 + rng.uniform(0, size), y0 + rng.uniform(0, size)) for x0, y0 in [(rng.uniform(-1, 9), rng.uniform(-1, 9))] for _ in range(3)])
    area = [[ring((0, 0), (10, 1), (9, 9), (4, 10), (1, 8)), square(4, 4, 5, 6)]]
    surveys = [(1, f"s{k}", [[triangle(4)], [triangle(3)]] if k % 3 else [[triangle(5)]]) for k in range(12)] + [(1, "s0", [[triangle(2)]])]
    builds = [(f"r{k}", [[triangle(5)]]) for k in range(6)]
    a, s = spark.createDataFrame([(1, "", area)], SHAPE), spark.createDataFrame([*surveys, surveys[1]], SHAPE)
    r = spark.createDataFrame(builds, "name string, parts array<array<array<struct<x: double, y: double>>>>")
    pieces = polygons.overlay(a, s, ["aoi"], resources=r, degrees=False)
    n = 800
    x, y = (m.ravel() for m in np.meshgrid((np.arange(n) + 0.5) / n * 12 - 1, (np.arange(n) + 0.5) / n * 12 - 1))
    own, held = inside(area, x, y), np.zeros(n * n, bool)
    for _, p in builds:
        held |= inside(p, x, y)
    masks = {}
    for _, name, p in surveys:
        masks[name] = masks.get(name, False) | inside(p, x, y)
    got = {v["workunit"]: v for v in polygons.inventory(pieces, s.dropDuplicates(["workunit"]), ["aoi"]).collect()}
    covered = np.zeros(n * n, bool)
    for name, mask in masks.items():
        mask = mask & own
        covered |= mask
        share = mask.sum() / own.sum()
        if share > 0.004:
            assert abs(got[name]["aoi_overlap_frac"] - share) < 0.003
            assert abs(got[name]["ept_coverage_frac"] - (mask & held).sum() / mask.sum()) < 0.03
            assert set(got[name]["ept_names"]) >= {b for b, p in builds if (inside(p, x, y) & mask).sum() > 20}
    assert abs(polygons.covered_share(pieces, ["aoi"]).first()["covered_frac"] - covered.sum() / own.sum()) < 0.002
    found = polygons.gaps(pieces, ["aoi"]).collect()
    assert abs(sum(g["gap_frac"] for g in found) - (own & ~covered).sum() / own.sum()) < 0.002
    # parts of the open squares that hang together by their sides
    left, sizes = (own & ~covered).reshape(n, n), []
    while left.any():
        grown, seed = np.zeros_like(left), tuple(np.argwhere(left)[0])
        grown[seed] = True
        while True:
            more = grown.copy()
            for _ in range(40):
                more[1:] |= more[:-1]
                more[:-1] |= more[1:]
                more[:, 1:] |= more[:, :-1]
                more[:, :-1] |= more[:, 1:]
                more &= left
            if (more == grown).all():
                break
            grown = more
        sizes.append(grown.sum() / own.sum())
        left &= ~grown
    big = lambda values: [round(float(v), 2) for v in sorted(values) if v > 0.004]
    assert len(big(sizes)) == len(big(g["gap_frac"] for g in found)) and np.allclose(big(sizes), big(g["gap_frac"] for g in found), atol=0.011)


@pytest.mark.parametrize("inner", ["\r", "\x85", "\u2028", "\x0c"])
def test_only_newlines_end_lines_of_reports(spark, inner):
    text = f"P Method: Lidar{inner}X\nQL: 2"
    assert one(spark, vendor._group(F.lit(text), r"^P Method:\s*(.+)$"), vendor._group(F.lit(text), r"^QL:\s*(.+)$")) == (f"Lidar{inner}X", "2")


def test_search(spark):
    areas = spark.createDataFrame([(1, "", [[square(0, 0, 1, 1)]])], SHAPE)
    rows = [(1, "WU_A", "2022-01-01", "2022-02-01", "QL 1", "Meets", "GEOID18", [[square(0, 0, 0.6, 1)]]), (1, "WU_B", "2016-01-01", "2016-02-01", "QL 2", "Meets", "GEOID12B", [[square(0, 0, 0.8, 1)]]), (1, "WU_C", None, None, None, None, None, [[square(0.99, 0, 2, 1)]])]
    surveys = spark.createDataFrame(rows, "aoi int, workunit string, start string, end string, ql string, category string, geoid string, parts array<array<array<struct<x: double, y: double>>>>").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    builds = spark.createDataFrame([("WU_A", 5, [[square(0, 0, 1, 1)]])], "name string, count long, parts array<array<array<struct<x: double, y: double>>>>")
    ranked, gaps, dropped = catalog.search(surveys, areas, ["aoi"], builds, 0.05)
    assert [r["workunit"] for r in ranked.orderBy("priority").collect()] == ["WU_B", "WU_A"]
    assert [round(r["gap_frac"], 6) for r in gaps.collect()] == [0.2] and [r["workunit"] for r in dropped.collect()] == ["WU_C"]
    assert {r["epoch"] for r in ranked.collect()} == {"2016", "2022"}
    assert [r["resource"] for r in catalog.with_resource(surveys, builds).collect()] == ["WU_A"]


def test_vendor_goldens(spark):
    def values(text):
        c = vendor.labelled(F.col("t"))
        row = spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in c.items()]).first()
        return {k: v for k, v in row.asDict().items() if v is not None}

    assert values("NVA of Point Cloud 129 0.051 0.100\nVVA of Bare Earth 101 0.05 0.107\nAggregate Nominal Pulse Density (pls/m2) 18.4\nAggregate Nominal Pulse Spacing (m) 0.23") == {
        "n_nva": 129, "nva_rmsez_m": 0.051, "nva_95pct_m": 0.1, "n_vva": 101, "vva_95th_m": 0.107, "anpd_ppsm": 18.4, "anps_m": 0.23}
    got = values("Raw NVA 0.196 m 0.9 3 of all\n  NVA  0.196 m   0.1656   20\n  VVA 0.294 m 0.1466 12\nRMSEr\n\n 0.1078 m\nACCr\n a\n b\n c 0.19 m\n Density   9.66 pts / m2 ")
    assert got == {"nva_95pct_m": 0.1656, "n_nva": 20, "vva_95th_m": 0.1466, "n_vva": 12, "horizontal_rmser_m": 0.1078, "horizontal_acc95_m": 0.19, "measured_density_ppsm": 9.66}
    assert values("  Aggregate 1,234 5,678 5.156/0.479\nNon-vegetated Vertical Accuracy (NVA) RMSE(z) 0.039/0.13\nNVA) at the 95% Confidence Level +/- 0.077/0.25")["first_return_density_ppsm"] == 5.156
    assert values("Nonvegetated Vertical Accuracy (DEM)\nx\nRMSE 5.1 cm 10 cm") == {"nva_rmsez_dem_vendor_m": 0.051}
    assert values("nothing") == {} and values("") == {}


def test_project_records(spark):
    rows = [("p", "b.pdf", "NVA of Point Cloud 1 0.2 0.3"), ("p", "a.pdf", "NVA of Point Cloud 2 0.5 0.6\n Aggregate 1 2 4.0/1"), ("p", "v.pdf", "Data Validation Report\nQuality Level: 1\nLidar Base Spec: 2.1"), ("q", "x.pdf", ""), ("q", "y.pdf", None)]
    got = {r["workunit"]: r for r in vendor.project_records(spark.createDataFrame(rows, "workunit string, path string, text string"), ["workunit"]).collect()}
    assert got["p"]["metrics"]["nva_rmsez_m"] == 0.5 and got["p"]["validation"]["lidar_base_spec"] == "2.1" and got["p"]["project_report"] is None
    assert got["p"]["first_return_mean_spacing_m"] == 0.5 and got["q"]["metrics"] is None and got["q"]["n_files"] == 2
    files = spark.createDataFrame([("p", "x/b_ClassifiedPointCloud.xml"), ("p", "x/a.xml"), ("q", "z.xml"), ("q", "y.xml")], "workunit string, path string")
    assert {r["workunit"]: r["path"] for r in vendor.pick_metadata(files, ["workunit"]).collect()} == {"p": "x/b_ClassifiedPointCloud.xml", "q": "y.xml"}


def test_conformance_goldens(spark):
    known = spark.createDataFrame([("6340", "supported"), ("102247", "esri"), ("8693", "other_datum")], "code string, class string")
    rows = [("WU_A", "102247", "GEOID18", "Ifsar", "l"), ("WU_B", "102247", "NOT_A_GEOID", "Ifsar", None), ("WU_C", "8693", None, "Sonar", None), ("WU_D", "999999", "Unknown", "linear-mode lidar", "l"), ("WU_E", "6340", "GEOID12A", None, "l")]
    found = {r["check"]: r for r in conformance.audit(spark.createDataFrame(rows, "workunit string, horiz_crs string, geoid string, p_method string, lpc_link string"), known).collect()}
    assert {k: (v["severity"], v["count"]) for k, v in found.items()} == {
        "horiz_crs.esri_authority_code": ("blocker", 2), "horiz_crs.non_nad83_datum": ("unsupported", 1), "horiz_crs.unparseable": ("blocker", 1), "geoid.unrecognized_model": ("blocker", 1),
        "geoid.undeclared": ("degraded", 2), "p_method.not_lidar": ("unsupported", 2), "p_method.unrecognized": ("info", 1), "metadata.missing_lpc_link": ("degraded", 2)}
    assert found["metadata.missing_lpc_link"]["examples"] == ["WU_B", "WU_C"] and found["horiz_crs.esri_authority_code"]["place"] == 1
    assert conformance.audit(spark.createDataFrame([], "workunit string, geoid string"), known).count() == 0


def test_grid_ids_of_other_zones(spark):
    ids = ["11SMA760990", "13SMA760990", "11SMI760990", "11SAA760990", "MA870940", "11IMA760990", None]
    got = [tuple(r) for r in staging.tile_footprints(spark.createDataFrame([(x,) for x in ids], "grid_id string"), 11).select("xmin", "ymin").collect()]
    assert got[0] == (476000.0, 4099000.0) and got[1:4] == [(None, None)] * 3 and got[5:] == [(None, None)] * 2
    east, north = geo.grid_square(F.lit("MA870940"), 11, F.lit(4_000_000.0))
    assert one(spark, east, north) == (487000.0, 4094000.0)


def test_high_z_keeps_points_without_a_group(spark):
    df = spark.createDataFrame([(1.0, None, 1), (2.0, 3, 1)], "z double, tile int, cls int")
    assert points.mark_high_z(df, 0.9).count() == 2 and points.mark_high_z(df, 0.9).columns == df.columns
    marked = points.mark_high(spark.createDataFrame([(1, 9.0), (2, 1.0), (1, None)], "cls int, hag double"), 5.0)
    assert sorted(r["cls"] for r in marked.collect()) == [1, 2, 18]


def test_nice_length(spark):
    assert [one(spark, geodesy.nice_length(F.lit(float(x))))[0] for x in (5, 7, 20, 30, 40)] == [1, 1, 5, 5, 10]


def test_ground_openings_of_blocks_equal_those_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(1, int(r), int(c), float(10 + rng.normal(0, 0.2) + 5 * (rng.random() < 0.2))) for r in range(60) for c in range(50) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "tile int, row long, col long, low double")
    flags = lambda: {(r["row"], r["col"]): r["flag"] for r in points._opened(cells, ["tile"], 3, 0.3).collect()}
    whole = flags()
    monkeypatch.setattr(points, "BLOCK", 7)
    assert flags() == whole and 0 < sum(whole.values()) < len(rows)


def test_normalize_fits_to_values_beyond_the_range(spark):
    a, b = np.full((1, 400), np.nan), np.full((1, 400), np.nan)
    a[0, :300] = np.arange(300.0)
    b[0, 100:] = np.arange(100.0, 400.0) * 2
    a[0, 290:300], b[0, 290:300] = 3000.0, 6000.0
    fits, out = merge.normalize(long(spark, a, "a").unionByName(long(spark, b, "b")), ["a", "b"], min_overlap=50)
    assert fits[1][3] == "overlap-refined" and abs(fits[1][1] / fits[0][1] - 0.5) < 1e-6
    assert {1000.0, 60000.0} >= {r["value"] for r in out.where("value <= 1000 OR value >= 60000").collect()}


def test_zones_of_tiles(spark):
    tiles = lambda *ids: spark.createDataFrame([(x,) for x in ids], "grid_id string")
    assert staging.one_zone(tiles("11SMA760990", "11TMA000000", "MA760990", None)) == (11, False)
    assert staging.one_zone(tiles("2LAA000000")) == (2, True) and staging.one_zone(tiles("x")) is None
    with pytest.raises(ValueError, match="several zones"):
        staging.one_zone(tiles("11SMA760990", "12SVA760990"))


def test_cubic_warps_keep_lines_and_constants(spark):
    z = np.add.outer(np.arange(12.0) * 3, np.arange(12.0) * 2)
    t = spark.range(36).select((F.floor(F.col("id") / 6) + 3).cast("bigint").alias("row"), (F.col("id") % 6 + 3).alias("col"))
    for kind in ("bilinear", "cubic", "cubic_spline"):
        got = raster.warp(long(spark, z), t, F.col("row") + 0.25, F.col("col") + 0.5, kind).collect()
        assert len(got) == 36 and all(abs(r["value"] - (3 * (r["row"] + 0.25) + 2 * (r["col"] + 0.5))) < 1e-9 for r in got), kind
    with pytest.raises(ValueError):
        raster.warp(long(spark, z), t, F.col("row"), F.col("col"), "lanczos")


def test_finalize_refuses_unclear_datums(spark):
    z = long(spark, np.full((4, 4), 700.0)).withColumn("tile", F.lit(1))
    t = spark.range(16).select(F.floor(F.col("id") / 4).cast("bigint").alias("row"), (F.col("id") % 4).alias("col"))
    state = lambda s: spark.createDataFrame([("a", s)], "source string, state string")
    run = lambda s: products.finalize(z, t, F.col("row"), F.col("col"), ["source"], "tile", state(s), F.lit(-31.0), levels=(2,))
    assert {r["value"] for r in run("true").collect()} == {669.0} and {r["value"] for r in run("false").collect()} == {700.0}
    assert run("true").count() == 20 and {r["epoch"] for r in run("true").collect()} == {2010.0}
    with pytest.raises(Exception, match="datum"):
        run("error")
    reference = long(spark, np.full((4, 4), 731.0)).select("row", "col", "value")
    assert products.datum_decisions(z, reference, F.lit(-31.0), ["source"], least=10).first()["state"] == "false"


def test_batch_helpers(spark):
    out = spark.createDataFrame([("a", "completed", None), ("b", "failed: 2 tiles", None)], "project string, state string, note string")
    with pytest.raises(RuntimeError, match="1 projects failed, among them b"):
        batch.finish(out)
    assert batch.finish(out.where("project = 'a'")) == 1
    assert batch.output_name("campus", 1.0) == "campus_1m" and batch.output_name("campus", 0.5, "WU_A") == "campus_0.5m_WU_A"
    assert (batch.span(1.5, 2.0, "m"), batch.span(2, 2), batch.span(None, 2)) == ("1.5-2 m", "2", "")


def test_box_after_projection(spark):
    box = [F.lit(x) for x in (-120.0, 35.0, -114.0, 36.0)]
    xmin, ymin, xmax, ymax = one(spark, *geo.projected_box(*box, lambda lon, lat: geo.utm(lon, lat, F.lit(11))))
    corners = [one(spark, *geo.utm(F.lit(x), F.lit(y), F.lit(11))) for x in (-120.0, -114.0) for y in (35.0, 36.0)]
    # the southern side bows: its middle lies further south than its corners
    assert xmin == min(c[0] for c in corners) and xmax == max(c[0] for c in corners) and ymin < min(c[1] for c in corners) - 1000 and ymax == max(c[1] for c in corners)


def test_grids_of_a_region(spark):
    get = lambda m, r, **k: one(spark, geodesy.region_grids(F.lit(m).cast("string"), F.lit(r).cast("string"), **k))[0]
    assert get("GEOID12B", "ak") == ["us_noaa_g2012ba0.tif"] and len(get("GEOID99", "conus")) == 8 and get(None, "ak") is None
    assert get("GEOID03", "ak", fail=False) is None
    with pytest.raises(Exception, match="no grid for GEOID03 in ak"):
        get("GEOID03", "ak")


def test_small_readers_and_writers(spark, tmp_path):
    spark.createDataFrame([("a", 0, 0, 0.0), ("a", 0, 1, 40.0), ("a", 5, 1, 50.0), ("a", 0, 2, float("nan"))], "source string, row long, col long, value double").write.parquet(f"{tmp_path}/cover")
    got = {(r["row"], r["col"]): r["value"] for r in readers.rasters(spark, f"{tmp_path}/cover", 0.0, (0, 0, 2, 2)).collect()}
    assert got == {(0, 0): None, (0, 1): 40.0, (0, 2): None}
    back = raster.to_sentinel(raster.from_sentinel(spark.createDataFrame([(1.0,), (-9999.0,), (float("nan"),)], "value double"), -9999.0), -9999.0)
    assert sorted(r["value"] for r in back.collect()) == [-9999.0, -9999.0, 1.0]
    (tmp_path / "w.csv").write_text("workunit,ql\nA,1\nB,\n")
    assert [tuple(r) for r in readers.csv_catalog(spark, f"{tmp_path}/w.csv").orderBy("workunit").collect()] == [("A", "1"), ("B", None)]
    (tmp_path / "r").mkdir()
    for name in ("a.xml", "x_ClassifiedPointCloud.xml"):
        (tmp_path / "r" / name).write_text("one\ntwo")
    assert [(r["text"], r["rank"]) for r in readers.report_texts(spark, f"{tmp_path}/r").orderBy("rank").collect()] == [("one\ntwo", 0), ("one\ntwo", 2)]
    runs = spark.createDataFrame([("p", "old", 1), ("p", "new", 2), ("q", "only", 0)], "project string, file string, mtime int")
    assert {tuple(r) for r in readers.newest(runs, ["project"], "file", "mtime").collect()} == {("p", "new"), ("q", "only")}
    surveys = spark.createDataFrame([("B", 2, None, ["x", "y"]), ("A", 1, None, []), ("C", None, None, None)], "workunit string, ql int, end date, ept_names array<string>")
    assert [r["workunit"] for r in catalog.sort_surveys(surveys).collect()] == ["A", "B", "C"]
    writers.write_surveys(surveys, spark.range(2), f"{tmp_path}/out")
    assert '{"workunit":"B","ql":2,"end":null,"ept_names":"x,y"}' in {r[0] for r in spark.read.text(f"{tmp_path}/out/surveys").collect()}
    placed = raster.on_grid(spark.createDataFrame([(10.5, 99.5), (12.0, 98.0)], "x double, y double"), 10.0, 100.0, 1.0).collect()
    assert [(r["row"], r["col"]) for r in placed] == [(0, 0), (2, 2)]
    assert one(spark, geodesy.geoid_shift(F.lit(700.0), F.lit(-31.0)), geodesy.geoid_shift(F.lit(700.0), F.lit(-31.0), False)) == (669.0, 731.0)
    wide = writers.buffered_area(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "xmin double, ymin double, xmax double, ymax double")).first()
    assert tuple(wide) == (-250.0, -250.0, 251.0, 251.0)


def test_vertical_preflight(spark):
    ops = [("a", 1, ["g18.tif"], True, -31.0, -130.0, 20.0, -60.0, 50.0), ("a", 2, ["g12.tif"], True, -31.5, -130.0, 20.0, -60.0, 50.0), ("a", 3, ["far.tif"], True, -40.0, -130.0, 20.0, -60.0, 50.0), ("c", 1, ["p.tif"], True, 1.0, 170.0, -60.0, -150.0, 60.0), ("d", 1, ["p.tif"], True, 1.0, 170.0, -60.0, -150.0, 60.0), ("e", 1, ["p.tif"], False, 1.0, -180.0, -90.0, 180.0, 90.0)]
    operations = spark.createDataFrame(ops, "s string, rank int, grids array<string>, there boolean, shift double, west double, south double, east double, north double")
    rows = lambda *x: spark.createDataFrame(list(x), "s string, grids array<string>, west double, south double, east double, north double")
    pick = lambda *x: tuple(preflight.choose_operations(rows(x), operations, ["s"]).select("rank", "state").first())
    box = (-115.5, 35.9, -114.9, 36.4)
    assert pick("a", None, *box) == (1, "ok") and pick("a", ["g12.tif"], *box) == (2, "ok")
    assert pick("a", ["far.tif"], *box) == (3, "not sane") and pick("a", ["none.tif"], *box) == (None, "no operation") and pick("b", None, *box) == (None, "no operation")
    assert pick("a", None, -140.0, 30.0, -120.0, 31.0) == (1, "area outside") and pick("e", None, *box) == (1, "grids missing")
    assert pick("c", None, 178.0, 0.0, -178.0, 1.0) == (1, "ok") and pick("d", None, -155.0, 0.0, 175.0, 1.0) == (1, "area outside")
    with pytest.raises(ValueError, match="no operation"):
        preflight.require(preflight.choose_operations(rows(("b", None, *box)), operations, ["s"]), ["s"])


def test_las_crs(tmp_path):
    write_las(tmp_path / "a.las", 1)
    assert las.crs(str(tmp_path / "a.las")) is None
    data = (tmp_path / "a.las").read_bytes()
    record = lambda user, number, body: struct.pack("<2x16sHH32x", user, number, len(body)) + body
    records = record(b"other", 1, b"xy") + record(b"LASF_Projection", 2112, b'PROJCS["x"]\0')
    head = bytearray(data[:375])
    struct.pack_into("<II", head, 96, 375 + len(records), 2)
    (tmp_path / "b.las").write_bytes(bytes(head) + records + data[375:])
    assert las.crs(str(tmp_path / "b.las")) == 'PROJCS["x"]'
    assert las.header(str(tmp_path / "b.las"))["n"] == 1
    (tmp_path / "c.las").write_bytes(b"nothing" * 40)
    with pytest.raises(ValueError):
        las.crs(str(tmp_path / "c.las"))
