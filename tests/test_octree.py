"""Octrees of points: equal to reading all and filtering, and what the walk leaves out."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratagrid.sources import octree

BOUNDS = (0.0, 0.0, -50.0, 100.0, 100.0, 50.0)


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    octree.register(spark)
    rng = random.Random(4)
    rows = [(round(rng.uniform(0, 99.9), 3), round(rng.uniform(0, 99.9), 3), round(rng.uniform(0, 9), 3), rng.randint(0, 4000), 1, 2, rng.choice([1, 2, 7])) for _ in range(6_000)] + [(500.0, 5.0, 5.0, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "x double, y double, z double, intensity int, rn int, nr int, cls int").repartition(4)
    folders = {}
    for codec in ("binary", "zstandard"):
        folders[codec] = str(tmp_path_factory.mktemp(codec))
        octree.write(df, folders[codec], BOUNDS, depths=5, span=8, codec=codec, subtree=2)
    return folders, rows[:-1]


def points(df):
    return sorted((round(r["x"], 3), round(r["y"], 3), round(r["z"], 3), r["intensity"], r["rn"], r["nr"], r["cls"]) for r in df.collect())


@pytest.mark.parametrize("codec", ["binary", "zstandard"])
def test_whole(spark, tree, codec):
    folders, rows = tree
    df = spark.read.format("octree").option("part", 500).load(folders[codec])
    assert points(df) == sorted(rows)
    assert df.rdd.getNumPartitions() > 5 and df.where("gps_time IS NOT NULL OR source_id IS NOT NULL").count() == 0


def test_box_leaves_out_nodes(spark, tree):
    folders, rows = tree
    box = dict(zip(octree.BOX, (20.0, 30.0, 31.0, 38.0)))
    want = sorted(r for r in rows if 20 <= r[0] <= 31 and 30 <= r[1] <= 38)
    assert points(spark.read.format("octree").options(**box).load(folders["binary"])) == want
    assert points(spark.read.format("octree").load(folders["binary"]).where("x >= 20 AND x <= 31 AND y >= 30 AND y <= 38")) == want
    about = octree.info(folders["binary"])
    everything = dict(octree.walk(folders["binary"], about, (-1e9, -1e9, 1e9, 1e9), None))
    near = dict(octree.walk(folders["binary"], about, tuple(box.values()), None))
    assert sum(everything.values()) == len(rows) and len(near) < 0.2 * len(everything) and sum(near.values()) < 0.2 * len(rows)
    assert all(octree.node_box(tuple(map(int, k.split("-"))), BOUNDS)[0] <= 31 for k in near)
    assert spark.read.format("octree").options(xmin=-9, ymin=-9, xmax=-5, ymax=-5).load(folders["binary"]).count() == 0


def test_hierarchy_of_other_places_is_not_read(tree, monkeypatch):
    folders, _ = tree
    read = []
    real = octree._read
    monkeypatch.setattr(octree, "_read", lambda folder, name: read.append(name) or real(folder, name))
    about = octree.info(folders["binary"])
    list(octree.walk(folders["binary"], about, (1.0, 1.0, 2.0, 2.0), None))
    near = len(read)
    list(octree.walk(folders["binary"], about, (-1e9, -1e9, 1e9, 1e9), None))
    assert near < 0.4 * (len(read) - near)
    read.clear()
    list(octree.walk(folders["binary"], about, (-1e9, -1e9, 1e9, 1e9), 1))
    assert read == ["ept-hierarchy/0-0-0-0.json"]


def test_resolution_ends_the_walk(spark, tree):
    folders, rows = tree
    # 100 / 8 = 12.5 at the root, then 6.25, 3.125, ...
    assert [octree.depth_for(100.0, 8, r) for r in (20.0, 12.5, 12.0, 6.25, 3.0, None)] == [1, 1, 2, 2, 4, None]
    for resolution, depths in ((12.5, 1), (6.0, 3), (0.1, 9)):
        df = spark.read.format("octree").option("resolution", resolution).load(folders["zstandard"])
        whole = spark.read.format("octree").load(folders["zstandard"]).where(F.split("node", "-")[0].cast("int") < depths)
        assert points(df) == points(whole)
    assert df.count() == len(rows)


def test_damaged_and_unsupported(spark, tree, tmp_path):
    with pytest.raises(ValueError, match="not an octree"):
        octree.info(str(tmp_path))
    (tmp_path / "ept.json").write_text(json.dumps({"dataType": "laszip"}))
    with pytest.raises(Exception, match="laszip are not supported"):
        spark.read.format("octree").load(str(tmp_path)).count()
    about = octree.info(tree[0]["binary"])
    with pytest.raises(ValueError, match="bytes"):
        octree.decode(b"12345", about, 1)
    with pytest.raises(ValueError, match="cube"):
        octree.write(spark.range(1), str(tmp_path), (0, 0, 0, 1, 2, 1))
