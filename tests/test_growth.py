"""Operators whose work must not grow faster than what they are given."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid import queries
from stratagrid.functions import geodesic
from stratagrid.operators import footprints, points, polygons, raster, staging


def test_tiles_are_made_by_all_tasks(spark):
    """A lattice from one row of bounds: no row is exploded to all tiles, and every task makes its share."""
    extent = spark.createDataFrame([(3.0, 1.0, 130.0, 61.0)], "xmin double, ymin double, xmax double, ymax double")
    out = points.tile_lattice(extent, 25.0, 2.0, 5.0)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    parts = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == spark.sparkContext.defaultParallelism
    n_cols, n_rows, snap = 6, 3, lambda f, v: f(v / 2) * 2.0
    want = []
    for k in range(n_cols * n_rows):
        i, j = divmod(k, n_rows)
        x0, y0 = snap(math.floor, 3 + i * 25), snap(math.floor, 1 + j * 25)
        x1, y1 = snap(math.ceil, min(3 + (i + 1) * 25, 130)), snap(math.ceil, min(1 + (j + 1) * 25, 61))
        want.append((k + 1, x0, y0, x1, y1, snap(math.floor, x0 - 5), snap(math.floor, y0 - 5), snap(math.ceil, x1 + 5), snap(math.ceil, y1 + 5)))
    assert sorted(tuple(r) for r in out.collect()) == want
    assert points.tile_lattice(extent.where("xmin > 3"), 25.0, 2.0, 5.0).count() == 0
    assert [r["tile"] for r in points.tile_lattice(extent.select(*[F.lit(None).cast("double").alias(c) for c in extent.columns]), 25.0, 2.0, 5.0).collect()] == [1]
    with pytest.raises(ValueError, match="more than one row"):
        points.tile_lattice(extent.union(extent), 25.0, 2.0, 5.0)


def test_area_below_a_side_costs_the_same_however_long_it_is(spark):
    """Areas are told by a formula of each side, not by points along it, which were 707 square metres off in 116 square kilometres here. The area of a
    small ring that points 10 metres apart converge to, and batches of rings."""
    lon, lat = [46.824981846529674, 47.122615327200656, 46.875285588057736], [-78.3151658346008, -78.70885887678182, -78.70089285470503]
    area = geodesic.ring_area(lon, lat)
    assert area == pytest.approx(115_940_774.4, abs=1.0)
    assert geodesic.ring_area([*lon[::-1], lon[-1]], [*lat[::-1], lat[-1]]) == pytest.approx(area, abs=1.0)
    # one batch of many rings, of several lengths, closed or not, with holes, nothing or no shape at all
    box = lambda w, s, d: [(w, s), (w + d, s), (w + d, s + d), (w, s + d)]
    shapes = [(0, [[box(3, 40, 2), box(3.5, 40.5, 1)], [[*box(10, 0, 5), (10, 0)]]]), (1, None), (2, []), (3, [[box(170, -60, 20)]]), (4, [[box(1, 1, 1)[:2]]]), (5, [[], [box(7, 7, 1)]])] * 3
    df = spark.createDataFrame([(k, None if s is None else [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] for rings in s]) for k, s in shapes], "id int, parts array<array<array<struct<x:double,y:double>>>>").coalesce(1)
    alone = lambda ring: geodesic.ring_area([x for x, _ in ring], [y for _, y in ring])
    for r in df.select("id", geodesic.polygon_area(F.col("parts")).alias("m2")).collect():
        s = dict(shapes)[r["id"]]
        assert r["m2"] == (None if s is None else pytest.approx(sum(alone(rings[0]) - sum(map(alone, rings[1:])) for rings in s if rings), rel=1e-12))


def test_gaps_of_the_ground_are_filled_where_they_are_found(spark, monkeypatch):
    """No ground cell is made into a row for each cell that it may fill, and blocks' borders do not show, nor do points without a height."""
    rng = random.Random(3)
    rows = [(t, rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([rng.gauss(10, 0.2), rng.gauss(10, 0.2), rng.uniform(12, 40)]), k) for t in (1, 2) for k in range(1500)]
    rows += [(1, rng.uniform(0, 60), rng.uniform(0, 60), z, 1500 + k) for k, z in enumerate([None, float("nan")] * 5)]
    pts = spark.createDataFrame([(*r, 1) for r in rows], "tile int, x double, y double, z double, id int, cls int")
    out = points.classify_ground(pts, window=3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Generate ") <= 2
    whole = {(r["tile"], r["id"]): r["cls"] for r in out.collect()}
    monkeypatch.setattr(points, "BLOCK", 16)
    assert {(r["tile"], r["id"]): r["cls"] for r in points.classify_ground(pts, window=3).collect()} == whole
    assert set(whole.values()) == {1, 2} and all(whole[1, k] == 1 for k in range(1500, 1510))
    assert {(r["tile"], r["id"]): r["cls"] for r in points.classify_ground(pts.where("z IS NOT NULL AND NOT isnan(z)"), window=3).collect()} == {k: v for k, v in whole.items() if k[1] < 1500}


def test_small_groups_are_classified_whole_and_together(spark, monkeypatch):
    """Points are moved once, small groups share their arrays, and no border shows: whole groups, groups in blocks, dense and scattered cells give
    what the same steps on dictionaries give, with null groups and places and heights without end or number."""
    rng = random.Random(6)
    low = lambda: rng.choice([rng.gauss(10, 0.2), rng.gauss(10, 0.2), rng.uniform(11, 40)])
    rows = [(t, rng.uniform(0, 20), rng.uniform(0, 20), low()) for t in ("dense", "dense too") for _ in range(900)]
    rows += [(t, -5e6 + rng.uniform(0, 90), 7e9 + rng.uniform(0, 90), low()) for t in ("thin", "thinner", None) for _ in range(400)]
    rows += [("far", 1e15 * k, -1e15 * k, 1.0) for k in range(3)] + [("odd", float(k % 9), float(k // 9), low()) for k in range(70)]
    rows += [("odd", 3.5, 3.5, None), ("odd", None, 1.0, 1.0), ("odd", 4.5, 4.5, float("nan")), ("odd", 20.5, 20.5, None), ("odd", 2.5, 2.5, float("inf")), ("odd", 2.0, 30.0, float("inf"))]
    df = spark.createDataFrame([(k, *r, 7) for k, r in enumerate(rows)], "id int, tile string, x double, y double, z float, cls int")
    rows, window, want = [(r["tile"], r["x"], r["y"], r["z"]) for r in df.orderBy("id").collect()], 3, {}
    for t in {r[0] for r in rows}:
        cells = {}
        for x, y, z in (r[1:] for r in rows if r[0] == t and None not in r and not math.isnan(r[3])):
            cells[math.floor(y), math.floor(x)] = min(z, cells.get((math.floor(y), math.floor(x)), math.inf))
        now, flags = cells, set()
        for w in range(1, window + 1):
            made = now
            for pick in (min, max):
                for a, b in ((0, 1), (1, 0)):
                    made = {c: pick(made[n] for s in range(-w, w + 1) if (n := (c[0] + a * s, c[1] + b * s)) in made) for c in made}
            flags |= {c for c in made if now[c] - made[c] > 0.2 * w}
            now = made
        dem = {c: z for c, z in cells.items() if c not in flags}
        around = {c: [(cells[n], 1 / (i * i + j * j)) for i in range(-window, window + 1) for j in range(-window, window + 1) if (n := (c[0] + i, c[1] + j)) in dem] for c in flags}
        dem |= {c: sum(z * w for z, w in held) / sum(w for _, w in held) for c, held in around.items() if held}
        slope = {c: [0.0, 0.0] for c in dem}
        for a in (0, 1):
            lines = {}
            for c in sorted(dem):
                lines.setdefault(c[a], []).append(c)
            for line in lines.values():
                for before, c, after in zip(line, line[1:], line[2:]):
                    slope[c][a] = (dem[after] - dem[before]) / 2
        for k, (own, x, y, z) in enumerate(rows):
            c = None if own != t or None in (own, x, y, z) else (math.floor(y), math.floor(x))
            if own == t:
                want[k] = 2 if c in dem and abs(z - dem[c]) <= 0.45 + 1.2 * math.hypot(*slope[c]) else 1
    classes = lambda: {r["id"]: r["cls"] for r in points.classify_ground(df, window=window).collect()}
    assert classes() == want and set(want.values()) == {1, 2}
    plan = points.classify_ground(df, window=window)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    for name, value in (("BATCH", 700), ("DENSE", 0), ("DENSE", 1 << 40), ("WHOLE", 800), ("BLOCK", 16), ("WHOLE", 0)):
        if name == "DENSE" and value:
            df = df.where("tile <> 'far' OR tile IS NULL")
            want = {r["id"]: want[r["id"]] for r in df.collect()}
        monkeypatch.setattr(points, name, value)
        assert classes() == want, name
    alone = df.where("tile = 'dense'")
    assert {r["id"]: r["cls"] for r in points.classify_ground(alone.drop("tile"), window=window, by=[]).collect()} == {r["id"]: want[r["id"]] for r in alone.collect()}


def test_filling_a_grid_does_not_write_it(spark, tmp_path, monkeypatch):
    """The grid goes from its aggregation to its blocks; blocks' borders, null groups and cells given as null do not show."""
    rng = random.Random(4)
    rows = [(k, rng.randrange(40), rng.randrange(12), 1, rng.uniform(1, 50), rng.uniform(0, 0.1), rng.uniform(0, 0.1), rng.uniform(900, 9000), rng.choice("AN"), "O") for k in range(200)]
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_extendedprice l_returnflag l_linestatus".split()
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = queries.dtm_fill(spark, str(tmp_path))
    assert all("lineitem" in f for f in out.inputFiles())
    whole = sorted(tuple(r) for r in out.collect())
    monkeypatch.setattr(raster, "BLOCK", 5)
    assert sorted(tuple(r) for r in queries.dtm_fill(spark, str(tmp_path)).collect()) == whole and {r[3] for r in whole} == {False, True}
    cells = spark.createDataFrame([(None, -1, 0, 2.0), (None, 1, 0, 4.0), (None, 0, 0, None), (7, 4, 4, 9.0)], "g int, row int, col int, value float")
    got = {(r["g"], r["row"], r["col"]): (r["value"], r["filled"]) for r in raster.window_fill(cells, 1, by=["g"]).collect()}
    assert len(got) == 9 + 15 and got[None, 0, 0] == (3.0, True) and got[None, -1, 0] == (2.0, False) and got[7, 5, 5] == (9.0, True)


def test_points_are_gridded_and_filled_in_one_exchange(spark, monkeypatch):
    """Neither pairs of points and cells nor the grid are rows, and the result is that of the two operators one after the other: points at cells'
    centres, on circles' edges, without height or place, far away, with any resolution, radius, power and origin."""
    rng = random.Random(8)
    rows = [(rng.uniform(-30, 30), rng.uniform(-9, 50), rng.uniform(1, 9)) for _ in range(150)] + [(k + 0.5, 0.5, float(k)) for k in range(5)] + [(0.5, 0.5, 7.0), (1.5, 0.5, None), (2.0, 2.0, 3.0)]
    rows += [(-40.5, -40.5, None), (7.5, 90.5, None), (8.5, 90.5, 2.0), (None, 1.0, 1.0), (1.0, None, 1.0), (float("nan"), 1.0, 1.0), (1.0, float("inf"), 1.0), (1e300, 1.0, 1.0), (3e9 + 0.25, -7e9, 4.0)]
    pts = spark.createDataFrame(rows, "x double, y double, z double")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(points.grid_idw_filled(pts, 1.0, 1.5, size=2)) == 1
    for size in (256, 5):
        monkeypatch.setattr(raster, "BLOCK", size)
        for how in ({"resolution": 1.0, "radius": 1.5}, {"resolution": 2.5, "power": 2.0, "origin": (0.3, -0.7)}, {"resolution": 1.0, "radius": 0.2}):
            want = raster.window_fill(points.grid_idw(pts, **how), 2, 1.5).collect()
            got = {(r["row"], r["col"]): r for r in points.grid_idw_filled(pts, **how, size=2, fill_power=1.5).collect()}
            assert len(got) == len(want) > 100
            assert all(got[r["row"], r["col"]]["value"] == pytest.approx(r["value"], rel=1e-12) and got[r["row"], r["col"]]["filled"] == r["filled"] for r in want)


def test_rounding_of_doubles(spark):
    values = [2.5, 3.5, -2.5, -3.5, 0.49999999999999994, 1e300, -0.4, 1e308, float("inf"), float("nan"), None, 123.45678949999999, 4503599627370497.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(queries.rounded("v", 0)).collect()]
    assert got[:8] == [3.0, 4.0, -3.0, -4.0, 0.0, 1e300, 0.0, 1e308] and got[8] == math.inf and math.isnan(got[9]) and got[10] is None and got[11:] == [123.0, 4503599627370498.0]
    got = [r[0] for r in df.select(queries.rounded("v", 7)).collect()]
    assert got[7:9] == [1e308, math.inf] and math.isnan(got[9]) and got[11] == 123.4567895


def test_height_above_ground_moves_a_point_once_however_far_groups_lie_apart(spark):
    """Points of a group are found by the spacing of its own ground: what is moved stays near the number of points. Dense places, places of
    several points, lone points, ties, nulls and groups without ground give what comparing all pairs gives."""
    rng = random.Random(5)
    rows = [(t, 5000.0 * t + rng.uniform(0, 10), 3000.0 * t + rng.uniform(0, 200), rng.uniform(0, 50), rng.choice([1, 1, 2])) for t in range(12) for _ in range(300)]
    rows += [(20, 7.0 + rng.gauss(0, 1e-4), 7.0 + rng.gauss(0, 1e-4), float(k % 7), 1 + k % 2) for k in range(900)] + [(20, 900.0, float(k), 1.0, 1) for k in range(5)]
    rows += [(21, float(k % 4), float(k // 4 % 4), float(k % 5), 1 + k % 2) for k in range(64)] + [(21, 0.5, 0.5, 3.0, 1), (22, 1.0, 1.0, 1.0, 1), (None, 1.0, 1.0, 1.0, 2), (0, None, 1.0, 1.0, 1), (23, 4.0, 4.0, 9.0, 2), (23, 5e5, 4.0, 9.5, 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, tile int, x double, y double, z double, cls int").coalesce(2)
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    last = max((stages().apply(k).stageId() for k in range(stages().size())), default=-1)
    got = {r["id"]: r["hag"] for r in points.height_above_ground(df).collect()}
    moved = [stages().apply(k) for k in range(stages().size())]
    assert sum(s.shuffleWriteRecords() for s in moved if s.stageId() > last) < 3 * len(rows)
    for k, (t, x, y, z, _) in enumerate(rows):
        near = [((x - g[1]) * (x - g[1]) + (y - g[2]) * (y - g[2]), g[3]) for g in rows if g[4] == 2 and g[0] == t] if t is not None and x is not None else []
        assert got[k] == (z - min(near)[1] if near else None)


def test_nearest_of_many_pairs():
    rng = np.random.default_rng(1)
    px, py = np.concatenate([rng.uniform(0, 9, 700), np.full(3000, 4.5)]), np.concatenate([rng.uniform(0, 9, 700), np.full(3000, 4.5)])
    gx, gy = np.round(rng.uniform(0, 9, (2, 900)), 1)
    best, d2 = points._nearest(px, py, gx, gy)
    want = (px[:, None] - gx) ** 2 + (py[:, None] - gy) ** 2
    assert (best == want.argmin(1)).all() and (d2 == want.min(1)).all()


def test_equal_shapes_are_swept_once(spark):
    """Surveys of an area, and resources, with the same shapes make one row of pieces, and each survey gets all names."""
    box = lambda w, s, d: [[[{"x": float(x), "y": float(y)} for x, y in ((w, s), (w + d, s), (w + d, s + d), (w, s + d))]]]
    shape = "parts array<array<array<struct<x:double,y:double>>>>"
    areas = spark.createDataFrame([(1, box(0, 0, 8)), (2, box(0, 0, 4))], f"aoi int, {shape}")
    own = [(a, f"w{k}", box(k % 2 * 2, 0, 2)) for a in (1, 2) for k in range(30)] + [(1, "far", box(20, 20, 1)), (1, None, box(20, 20, 1)), (1, "two", box(0, 0, 2)), (1, "two", box(2, 0, 2))]
    surveys = spark.createDataFrame(own, f"aoi int, workunit string, {shape}")
    builds = spark.createDataFrame([(f"r{k:02}", box(1 + k % 2 * 2, 0, 1)) for k in range(20)] + [("r99", box(0, 0, 1)), (None, box(0, 0, 8)), ("none", None)], f"name string, {shape}")
    pieces = polygons.overlay(areas, surveys, ["aoi"], resources=builds.where("name IS NOT NULL"), degrees=False)
    assert pieces.where("kind = 'overlap'").select("aoi", "id").distinct().count() == 5 and pieces.where("kind = 'hit'").select("aoi", "id", "other").distinct().count() == 9
    got = {(r["aoi"], r["workunit"]): r for r in polygons.inventory(pieces, surveys.dropDuplicates(["aoi", "workunit"]), ["aoi"]).collect()}
    even, odd = [f"r{k:02}" for k in range(0, 20, 2)] + ["r99"], [f"r{k:02}" for k in range(1, 20, 2)]
    assert len(got) == 61 and all(got[a, f"w{k}"]["ept_names"] == (odd if k % 2 else even) for a in (1, 2) for k in range(30)) and got[1, "two"]["ept_names"] == sorted(even + odd)
    # boxes of 2 x 2: in even ones, two squares of four are held, in odd ones one
    assert all(abs(got[a, f"w{k}"]["ept_coverage_frac"] - (0.25 if k % 2 else 0.5)) < 1e-9 for a in (1, 2) for k in range(30)) and abs(got[1, "two"]["ept_coverage_frac"] - 0.375) < 1e-9
    text = polygons.inventory(pieces, surveys, ["aoi"], joined=",").where("workunit = 'w0'").first()["ept_names"]
    assert text == ",".join(even)
    tiles = spark.createDataFrame([(1, f"t{k}", 0.0, 0.0, 2.0, 2.0) for k in range(9)], "aoi int, tile string, xmin double, ymin double, xmax double, ymax double")
    kept = staging.select_tiles(tiles, areas, ["aoi"], resources=builds.where("name = 'r99'")).collect()
    assert sorted(r["tile"] for r in kept) == [f"t{k}" for k in range(9)] and all(abs(r["share"] - 1) < 1e-9 for r in kept)


def test_shapes_of_resources_are_swept_once_whatever_their_names_have_besides(spark, monkeypatch):
    """Names with sets of shapes that are all different cost what their few shapes cost, and lists of names are not moved between tasks."""
    box = lambda w, s, d: [[[{"x": float(x), "y": float(y)} for x, y in ((w, s), (w + d, s), (w + d, s + d), (w, s + d))]]]
    shape = "parts array<array<array<struct<x:double,y:double>>>>"
    places = [box(0, 0, 1), box(1, 0, 1), box(2, 0, 1), box(0.5, 0, 1)]
    areas = spark.createDataFrame([(1, box(0, 0, 8))], f"aoi int, {shape}")
    surveys = spark.createDataFrame([(1, f"w{k}", box(2 * (k % 2), 0, 2)) for k in range(10)] + [(1, "empty", box(6, 6, 1))], f"aoi int, workunit string, {shape}")
    rows = [(f"r{k:02}", places[j]) for k in range(1, 16) for j in range(4) if k >> j & 1] + [("r01", places[0]), (None, box(3, 0, 1)), ("r00", None)]
    builds = spark.createDataFrame(rows, f"name string, {shape}")
    pieces = polygons.overlay(areas, surveys, ["aoi"], resources=builds, degrees=False)
    assert pieces.where("kind = 'hit'").select("id", "other").distinct().count() == 3 + 2
    even, odd = [f"r{k:02}" for k in range(1, 16) if k & 11], [f"r{k:02}" for k in range(1, 16) if k & 4]
    for most in (1 << 20, 0):
        monkeypatch.setattr(polygons, "NAMES_BYTES", most)
        out = polygons.inventory(pieces, surveys, ["aoi"], joined=",")
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
        got = {r["workunit"]: (r["ept_names"], round(r["ept_coverage_frac"], 9)) for r in out.collect()}
        # what has no name is held, too
        assert got == {"empty": ("", 0.0)} | {f"w{k}": (",".join(odd if k % 2 else even), 0.5) for k in range(10)}
        if most:
            lists = [k for k, line in enumerate(plan) if "collect_list(sg_names" in line]
            assert len(lists) > 1 and not any("Exchange" in line for line in plan[lists[0]:lists[-1]])


def test_holes_do_not_meet_all_sides_of_their_row(spark, monkeypatch):
    """A hole's neighbour in the west is found in the order of the row; the work does not grow with holes times sides of a row."""
    plans = []
    kept = footprints.written
    monkeypatch.setattr(footprints, "written", lambda df, name: (plans.append((name, df._jdf.queryExecution().toString())), kept(df, name))[1])
    cells = spark.createDataFrame([("a", r, c, 1.0) for r in range(3) for c in range(41) if r != 1 or c % 2 == 0] + [("b", 0, 0, 1.0)], "source string, row long, col long, value double")
    got = footprints.rings(cells).collect()
    assert sum(not r["outer"] for r in got) == 20 and len({r["parent"] for r in got if r["source"] == "a"}) == 1 and len(got) == 22
    assert "Window" in next(p for name, p in plans if name == "holes")
