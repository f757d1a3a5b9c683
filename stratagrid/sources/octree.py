"""Octrees of points in folders (ept.json, ept-hierarchy, ept-data): ``spark.read.format("octree").load(folder)``, and ``write``.

A node at depth d is one of 2**d cubes a side; its points thin out the cube, and its children hold the rest. The reader walks the
hierarchy from the root and leaves out what lies outside the box, and what is deeper than a resolution needs, before any
point is read; parts of the hierarchy below such nodes are not read either. A partition is a group of nodes with about
``PART`` points. Filters on x and y narrow the box.

Points are stored as they are or with Zstandard; compressed LAS (LAZ) is refused, as no public decoder is at hand here.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "node string, x double, y double, z double, intensity int, rn short, nr short, cls short, source_id int, gps_time double"
#: Points of a partition, about.
PART = 1_000_000
BOX = ("xmin", "ymin", "xmax", "ymax")
# Names of dimensions in the format, and of this library's columns.
DIMENSIONS = {"X": "x", "Y": "y", "Z": "z", "Intensity": "intensity", "ReturnNumber": "rn", "NumberOfReturns": "nr", "Classification": "cls", "PointSourceId": "source_id", "GpsTime": "gps_time"}
# End of fixed values.
TYPES = {"x": np.float64, "y": np.float64, "z": np.float64, "intensity": np.int32, "rn": np.int16, "nr": np.int16, "cls": np.int16, "source_id": np.int32, "gps_time": np.float64}


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _read(folder: str, name: str) -> bytes:
    files, at = _open(folder)
    with files.open_input_file(f"{at}/{name}") as f:
        return f.read()


def info(folder: str) -> dict:
    """What ept.json says; an error where the points are stored in a way that is not supported."""
    try:
        found = json.loads(_read(folder, "ept.json"))
    except (FileNotFoundError, ValueError) as e:
        raise ValueError(f"{folder} is not an octree of points") from e
    if found.get("dataType") not in ("binary", "zstandard"):
        raise ValueError(f"points stored as {found.get('dataType')} are not supported")
    return found


def depth_for(side: float, span: int, resolution: float | None) -> int | None:
    """How many depths a resolution needs: the first whose points are as near to each other is the last. None: all."""
    if not resolution:
        return None
    depth, now = 1, side / span
    while now > resolution:
        depth, now = depth + 1, now / 2
    return depth


def node_box(key: tuple[int, int, int, int], bounds: Sequence[float]) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax of a node (depth, x, y, z)."""
    side = (bounds[3] - bounds[0]) / 2 ** key[0]
    return bounds[0] + key[1] * side, bounds[1] + key[2] * side, bounds[0] + (key[1] + 1) * side, bounds[1] + (key[2] + 1) * side


def walk(folder: str, about: dict, box: Sequence[float], depths: int | None) -> Iterator[tuple[str, int]]:
    """(node, points) of all nodes that meet the box and are not too deep. Parts of the hierarchy are read as the walk gets there."""
    counts = json.loads(_read(folder, "ept-hierarchy/0-0-0-0.json"))
    waiting = [(0, 0, 0, 0)]
    while waiting:
        key = waiting.pop()
        name = "-".join(map(str, key))
        n = counts.get(name)
        west, south, east, north = node_box(key, about["bounds"])
        if n is None or depths is not None and key[0] >= depths or west > box[2] or east < box[0] or south > box[3] or north < box[1]:
            continue
        if n == -1:
            counts.update(json.loads(_read(folder, f"ept-hierarchy/{name}.json")))
            n = counts[name]
        if n > 0:
            yield name, n
        waiting += [(key[0] + 1, 2 * key[1] + a, 2 * key[2] + b, 2 * key[3] + c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def layout(about: dict) -> np.dtype:
    kinds = {"signed": "i", "unsigned": "u", "float": "f", "floating": "f"}
    return np.dtype([(d["name"], f"<{kinds[d['type']]}{d['size']}") for d in about["schema"]])


def decode(data: bytes, about: dict, n: int) -> dict[str, np.ndarray]:
    """This library's columns of a node's points."""
    if about["dataType"] == "zstandard":
        data = pa.decompress(data, decompressed_size=n * layout(about).itemsize, codec="zstd").to_pybytes()
    if len(data) != n * layout(about).itemsize:
        raise ValueError(f"a node has {len(data)} bytes, {n} points are {n * layout(about).itemsize}")
    raw, out = np.frombuffer(data, layout(about)), {}
    for d in about["schema"]:
        if (name := DIMENSIONS.get(d["name"])) is not None:
            values = raw[d["name"]]
            if "scale" in d or "offset" in d:
                values = values * float(d.get("scale", 1.0)) + float(d.get("offset", 0.0))
            out[name] = values.astype(TYPES[name])
    return out


class Nodes(InputPartition):
    def __init__(self, nodes: list[tuple[str, int]]):
        self.nodes = nodes


class OctreeReader(DataSourceReader):
    """Options: xmin, ymin, xmax, ymax (points outside are left out), resolution (map units between points), part (points of a partition)."""

    def __init__(self, options: dict):
        self.options, self.folder = options, options["path"].rstrip("/")
        self.box = [float(options.get(c, v)) for c, v in zip(BOX, (-math.inf, -math.inf, math.inf, math.inf), strict=True)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the box; Spark applies all filters again."""
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if name in ("x", "y") and isinstance(getattr(f, "value", None), (int, float)):
                at = 0 if name == "x" else 1
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.box[at] = max(self.box[at], float(f.value))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.box[at + 2] = min(self.box[at + 2], float(f.value))
            yield f

    def partitions(self) -> Sequence[Nodes]:
        about = info(self.folder)
        resolution = float(self.options["resolution"]) if "resolution" in self.options else None
        depths = depth_for(about["bounds"][3] - about["bounds"][0], about["span"], resolution)
        out, held, size = [], [], 0
        for name, n in walk(self.folder, about, self.box, depths):
            held.append((name, n))
            size += n
            if size >= int(self.options.get("part", PART)):
                out.append(Nodes(held))
                held, size = [], 0
        return [*out, Nodes(held)] if held or not out else out

    def read(self, part: Nodes) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        about = info(self.folder)
        suffix = "bin" if about["dataType"] == "binary" else "zst"
        for name, n in part.nodes:
            columns = decode(_read(self.folder, f"ept-data/{name}.{suffix}"), about, n)
            x, y = columns["x"], columns["y"]
            good = np.flatnonzero((x >= self.box[0]) & (x <= self.box[2]) & (y >= self.box[1]) & (y <= self.box[3]))
            for k in range(0, len(good), 65_536):
                at = good[k:k + 65_536]
                arrays = [pa.array([name]).take(pa.array(np.zeros(len(at), np.int64)))]
                arrays += [pa.array(columns[c][at]) if c in columns else pa.nulls(len(at), pa.from_numpy_dtype(t)) for c, t in TYPES.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", *TYPES])


class OctreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "octree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OctreeReader:
        return OctreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters to Python data sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OctreeSource)


def write(points: DataFrame, folder: str, bounds: tuple[float, float, float, float, float, float], depths: int = 6, span: int = 128, scale: float = 0.001, codec: str = "zstandard", subtree: int = 4) -> int:
    """Writes points (x, y, z, and intensity, rn, nr, cls where there are) to an octree of ``depths`` depths in the cube ``bounds``; returns its nodes.

    A point's depth is drawn from a hash of it, each depth with four times the points of the one above, so that every depth
    thins out the whole. Points outside the cube are left out; coordinates are rounded to ``scale``. The hierarchy, a few bytes a
    node, goes through the driver, and is stored in a file for each node at every ``subtree``-th depth.
    """
    if codec not in ("binary", "zstandard") or bounds[3] - bounds[0] != bounds[4] - bounds[1] or bounds[3] - bounds[0] != bounds[5] - bounds[2]:
        raise ValueError("bounds are a cube, and points are stored as binary or zstandard")
    side = bounds[3] - bounds[0]
    names = [c for c in ("intensity", "rn", "nr", "cls") if c in points.columns]
    schema = [{"name": n, "type": "signed", "size": 4, "scale": scale, "offset": bounds[k]} for k, n in enumerate("XYZ")]
    schema += [{"name": next(k for k, v in DIMENSIONS.items() if v == c), "type": "unsigned", "size": 2 if c == "intensity" else 1} for c in names]
    about = {"bounds": list(bounds), "boundsConforming": list(bounds), "dataType": codec, "hierarchyType": "json", "schema": schema, "span": span, "version": "1.0.0"}
    kind = layout(about)
    draw = F.pmod(F.xxhash64("x", "y", "z", *names), F.lit(4 ** depths - 1))
    # 3 of 4**depths - 1 points are at depth 0, 12 at depth 1, and so on
    depth = F.floor(F.log(draw + 1.0) / math.log(4.0)).cast("int")
    index = lambda c, low: F.floor((F.col(c) - low) / side * F.pow(F.lit(2.0), F.col("sg_d"))).cast("int")
    inside = F.col("x").between(bounds[0], bounds[3]) & (F.col("x") < bounds[3]) & (F.col("y") >= bounds[1]) & (F.col("y") < bounds[4]) & (F.col("z") >= bounds[2]) & (F.col("z") < bounds[5])
    placed = points.where(inside).withColumn("sg_d", F.least(depth, F.lit(depths - 1)))
    node = F.concat_ws("-", "sg_d", index("x", bounds[0]), index("y", bounds[1]), index("z", bounds[2]))
    own = placed.select(node.alias("node"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("int").alias(c) for c in names])

    def run(pdf):
        import pandas as pd

        raw = np.zeros(len(pdf), kind)
        for k, c in enumerate("xyz"):
            raw[c.upper()] = np.rint((pdf[c].to_numpy() - bounds[k]) / scale)
        for c in names:
            raw[next(k for k, v in DIMENSIONS.items() if v == c)] = pdf[c].to_numpy()
        data, name = raw.tobytes(), pdf["node"].iloc[0]
        files, at = _open(folder)
        files.create_dir(f"{at}/ept-data", recursive=True)
        with files.open_output_stream(f"{at}/ept-data/{name}.{'bin' if codec == 'binary' else 'zst'}", compression=None) as out:
            out.write(data if codec == "binary" else pa.compress(data, codec="zstd", asbytes=True))
        return pd.DataFrame({"node": [name], "n": [len(pdf)]})

    counts = {r["node"]: r["n"] for r in own.groupBy("node").applyInPandas(run, "node string, n long").toLocalIterator()}
    for name in list(counts):
        d, *xyz = map(int, name.split("-"))
        while d:
            d, xyz = d - 1, [v // 2 for v in xyz]
            counts.setdefault("-".join(map(str, (d, *xyz))), 0)
    counts.setdefault("0-0-0-0", 0)
    trees: dict[str, dict[str, int]] = {}
    for name, n in counts.items():
        d, *xyz = map(int, name.split("-"))
        root = d // subtree * subtree
        up = "-".join(map(str, (root, *(v >> (d - root) for v in xyz))))
        trees.setdefault(up, {})[name] = n
        if d and d == root:
            above = "-".join(map(str, (d - subtree, *(v >> subtree for v in xyz))))
            trees.setdefault(above, {})[name] = -1
    files, at = _open(folder)
    files.create_dir(f"{at}/ept-hierarchy", recursive=True)
    for name, own_counts in trees.items():
        with files.open_output_stream(f"{at}/ept-hierarchy/{name}.json") as out:
            out.write(json.dumps(own_counts).encode())
    with files.open_output_stream(f"{at}/ept.json") as out:
        out.write(json.dumps(about).encode())
    return sum(n > 0 for n in counts.values())
