"""GeoPackage files: round trips, boxes that go to the R-tree, other geometries and damaged files."""

import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from stratagrid.sources import geopackage, readers

SCHEMA = "workunit string, id long, ql double, day date, parts array<array<array<struct<x: double, y: double>>>>"


def ring(*xy):
    xy = [*xy, xy[0]]
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def square(w, s, e, n):
    return ring((w, s), (e, s), (e, n), (w, n))


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    geopackage.register(spark)
    rng = random.Random(1)
    rows = [(f"é {k}", k, k / 3, None, [[square(x, y, x + 1, y + 1)]]) for k in range(300) for x, y in [(rng.uniform(-120, -70), rng.uniform(25, 48))]]
    rows += [("two parts", 900, None, None, [[square(0, 0, 4, 4), square(1, 1, 2, 2)], [square(10, 0, 11, 1)]]), ("null", 901, 1.0, None, None), ("empty", 902, 1.0, None, [])]
    path = f"{tmp_path_factory.mktemp('gpkg')}/wesm.gpkg"
    assert geopackage.write(spark.createDataFrame(rows, SCHEMA).repartition(4), path, "WESM \"x\"") == 303
    return path, {r[1]: r for r in rows}


def test_round_trip(spark, catalog):
    path, rows = catalog
    df = spark.read.format("geopackage").option("part", 40).load(path)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][:4] == [("workunit", "string"), ("id", "bigint"), ("ql", "double"), ("day", "string")]
    got = {r["id"]: r for r in df.collect()}
    assert got.keys() == rows.keys()
    for k, r in got.items():
        want = rows[k]
        assert (r["workunit"], r["ql"], r["day"]) == (want[0], want[2], want[3])
        parts = None if r["parts"] is None else [[[{"x": p["x"], "y": p["y"]} for p in ring] for ring in rings] for rings in r["parts"]]
        assert parts == (want[4] or None)
    assert (got[900]["xmin"], got[900]["ymin"], got[900]["xmax"], got[900]["ymax"]) == (0, 0, 11, 4) and got[901]["xmin"] is got[902]["xmin"] is None


def test_box_goes_to_the_tree(spark, catalog):
    path, _ = catalog
    box = (-100.0, 30.0, -90.0, 35.0)
    whole = spark.read.format("geopackage").load(path).collect()
    want = {r["id"] for r in whole if r["xmin"] is not None and r["xmin"] <= box[2] and r["xmax"] >= box[0] and r["ymin"] <= box[3] and r["ymax"] >= box[1]}
    pushed = readers.in_box(spark.read.format("geopackage").option("part", 100).load(path), *box)
    given = spark.read.format("geopackage").options(**dict(zip(geopackage.BOX, box))).load(path)
    assert 0 < len(want) < 60 and {r["id"] for r in pushed.collect()} == {r["id"] for r in given.collect()} == want
    # rows that the database hands out
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

    reader = geopackage.GeoPackageReader({"path": path}, pushed.schema)
    list(reader.pushFilters([LessThanOrEqual(("xmin",), box[2]), GreaterThanOrEqual(("xmax",), box[0]), LessThanOrEqual(("ymin",), box[3]), GreaterThanOrEqual(("ymax",), box[1])]))
    assert sum(1 for p in reader.partitions() for _ in reader.rows(p)) == len(want)
    assert readers.in_box(spark.read.format("geopackage").load(path), 500.0, 0.0, 501.0, 1.0).count() == 0


def test_other_geometries():
    point = struct.pack("<BI2d", 1, 1, 3.0, 4.0)
    head = b"GP" + struct.pack(">BBi", 0, 0, 4326)
    assert geopackage.decode_blob(head + point) is None and geopackage.decode_blob(None) is None
    # big-endian, with heights, by either way to say so
    for kind in (1003, 0x80000003):
        body = struct.pack(">BIII9d", 0, kind, 1, 3, 0, 0, 9, 1, 0, 9, 1, 1, 9)
        assert geopackage.decode_blob(head + body) == [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]]]
    with pytest.raises(ValueError, match="geometry"):
        geopackage.decode_blob(b"nothing")


def test_damaged_files(spark, catalog, tmp_path):
    geopackage.register(spark)
    (tmp_path / "text.gpkg").write_bytes(b"no database, but long enough to be looked at" * 9)
    sqlite3.connect(tmp_path / "plain.gpkg").execute("CREATE TABLE t (a)").connection.commit()
    for name, what in (("text.gpkg", "not a GeoPackage"), ("plain.gpkg", "not a GeoPackage"), ("none.gpkg", "no file")):
        with pytest.raises(Exception, match=what):
            spark.read.format("geopackage").load(f"{tmp_path}/{name}").count()
    with pytest.raises(Exception, match="no table of shapes"):
        spark.read.format("geopackage").option("table", "x").load(catalog[0]).count()
    with pytest.raises(ValueError, match="file system"):
        geopackage.connect("s3://bucket/a.gpkg")
    empty = f"{tmp_path}/empty.gpkg"
    assert geopackage.write(spark.createDataFrame([], SCHEMA), empty, "t") == 0
    assert spark.read.format("geopackage").load(empty).count() == 0
    geopackage.write(spark.createDataFrame([], SCHEMA).withColumn("d", F.lit(1)), empty, "t")
    assert "d" in spark.read.format("geopackage").load(empty).columns
