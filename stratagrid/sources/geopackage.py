"""GeoPackage files: ``spark.read.format("geopackage").load(path)``, and ``write``.

A GeoPackage is an SQLite database, which needs a file system that can read a file at any place (local, or mounted on all
machines). A partition is a range of row numbers; bounds go to the R-tree that the file has of its shapes, by option or pushed
down from filters on xmin, ymin, xmax and ymax, so rows outside are not read.

Polygons come as ``parts`` (an array of parts, each an array of rings, the outer one first, each an array of struct x, y), with their
bounds. Heights and measures are left out.
"""

from __future__ import annotations

import math
import os
import sqlite3
import struct
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Row numbers of a partition, and rows of a batch.
PART, BATCH = 50_000, 1_024
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))
BOX = ("xmin", "ymin", "xmax", "ymax")
# Fixed values of the format: magic numbers, doubles of an envelope by its kind, kinds of geometries, and column types.
MAGIC, APPLICATION, ENVELOPES, POLYGON, MULTIPOLYGON = b"GP", 0x47504B47, (0, 4, 6, 6, 8), 3, 6
INTEGERS, REALS = ("INT", "BOOLEAN", "TINYINT", "SMALLINT", "MEDIUMINT"), ("REAL", "DOUBLE", "FLOAT")
# End of fixed values.


def decode_wkb(data: bytes, at: int = 0) -> tuple[list | None, int]:
    """The parts of a polygon or multipolygon, in either byte order, and where it ends; None for other geometries."""
    order = "<" if data[at] else ">"
    kind = struct.unpack_from(order + "I", data, at + 1)[0]
    at += 5
    if kind & 0x20000000:
        at += 4
    width = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (0, 1, 1, 2)[(kind & 0xFFFFFFF) // 1000 % 4]
    kind = (kind & 0xFFFFFFF) % 1000
    if kind not in (POLYGON, MULTIPOLYGON):
        return None, at
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    if kind == MULTIPOLYGON:
        parts: list = []
        for _ in range(n):
            own, at = decode_wkb(data, at)
            parts += own or []
        return parts, at
    rings = []
    for _ in range(n):
        m = struct.unpack_from(order + "I", data, at)[0]
        numbers = struct.unpack_from(f"{order}{m * width}d", data, at + 4)
        rings.append([{"x": numbers[k], "y": numbers[k + 1]} for k in range(0, len(numbers), width)])
        at += 4 + 8 * m * width
    return [rings], at


def encode_wkb(parts: list) -> bytes:
    """A multipolygon; rings are closed."""
    out = struct.pack("<BII", 1, MULTIPOLYGON, len(parts))
    for rings in parts:
        out += struct.pack("<BII", 1, POLYGON, len(rings))
        for ring in rings:
            points = [(p["x"], p["y"]) for p in ring]
            points += points[:1] if points and points[0] != points[-1] else []
            out += struct.pack(f"<I{2 * len(points)}d", len(points), *(v for p in points for v in p))
    return out


def decode_blob(blob: bytes | None) -> list | None:
    """The parts in a geometry column; None where it is null, empty, or no polygon."""
    if not blob:
        return None
    if blob[:2] != MAGIC:
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    if flags & 0x10:
        return None
    return decode_wkb(blob, 8 + 8 * ENVELOPES[flags >> 1 & 7])[0]


def bounds_of(parts: list | None) -> tuple[float | None, ...]:
    points = [p for rings in parts or [] for ring in rings[:1] for p in ring]
    if not points:
        return None, None, None, None
    xs, ys = [p["x"] for p in points], [p["y"] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def _local(path: str) -> str:
    at = path[5:] if path.startswith("file:") else path
    if "://" in at:
        raise ValueError(f"{path} is not in a file system that SQLite can read")
    return "/" + at.lstrip("/") if path.startswith("file:") else os.path.abspath(at)


def connect(path: str) -> sqlite3.Connection:
    at = _local(path)
    if not os.path.isfile(at):
        raise ValueError(f"there is no file {path}")
    db = sqlite3.connect(f"file:{at}?mode=ro&immutable=1", uri=True)
    try:
        if not db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'gpkg_contents'").fetchone()[0]:
            raise ValueError(f"{path} is not a GeoPackage")
    except sqlite3.DatabaseError as e:
        raise ValueError(f"{path} is not a GeoPackage") from e
    return db


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GeoPackageReader(DataSourceReader):
    """Options: table (by default the first with shapes), xmin, ymin, xmax, ymax (only shapes whose bounds meet the box), part (row numbers
    of a partition)."""

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.path = options["path"]
        self.box = [float(options.get(c, v)) for c, v in zip(BOX, (-math.inf, -math.inf, math.inf, math.inf), strict=True)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """What filters say of the bounds goes to the R-tree. Its bounds are rounded outwards, so Spark applies all filters again."""
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if name in BOX and isinstance(getattr(f, "value", None), (int, float)):
                if name in ("xmin", "ymin") and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    at = BOX.index(name) + 2
                    self.box[at] = min(self.box[at], float(f.value))
                if name in ("xmax", "ymax") and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    at = BOX.index(name) - 2
                    self.box[at] = max(self.box[at], float(f.value))
            yield f

    def partitions(self) -> Sequence[Rows]:
        with connect(self.path) as db:
            table, _ = shape_column(db, self.options.get("table"))
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(table)}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        size = int(self.options.get("part", PART))
        return [Rows(k, min(k + size - 1, high)) for k in range(low, high + 1, size)]

    def rows(self, part: Rows) -> Iterator[tuple]:
        """What the database gives for a partition: the columns and the geometry."""
        with connect(self.path) as db:
            table, column = shape_column(db, self.options.get("table"))
            names = ", ".join(f"t.{quoted(c)}" for c in attributes(db, table, column))
            tree = f"rtree_{table}_{column}"
            query, given = f"SELECT {names + ', ' if names else ''}t.{quoted(column)} FROM {quoted(table)} t", [part.first, part.last]
            where = "t.rowid BETWEEN ? AND ?"
            if self.box != [-math.inf, -math.inf, math.inf, math.inf] and db.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", [tree]).fetchone()[0]:
                query += f" JOIN {quoted(tree)} r ON r.id = t.rowid"
                where += " AND r.maxx >= ? AND r.maxy >= ? AND r.minx <= ? AND r.miny <= ?"
                given += self.box
            yield from db.execute(f"{query} WHERE {where} ORDER BY t.rowid", given)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(self.schema), []
        boxed = any(c in self.options for c in BOX)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([None if v is None else cast(v) for v in c], f.type) for c, f, cast in zip(zip(*held, strict=True), schema, casts, strict=True)], schema=schema)

        casts = [{"bigint": int, "double": float, "string": lambda v: v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)}.get(f.dataType.simpleString(), lambda v: v) for f in self.schema.fields]
        for *values, blob in self.rows(part):
            parts = decode_blob(blob)
            box = bounds_of(parts)
            if boxed and (box[0] is None or box[0] > self.box[2] or box[1] > self.box[3] or box[2] < self.box[0] or box[3] < self.box[1]):
                continue
            held.append((*values, parts, *box))
            if len(held) >= BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


def shape_column(db: sqlite3.Connection, table: str | None) -> tuple[str, str]:
    found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
    own = [x for x in found if table is None or x[0] == table]
    if not own:
        raise ValueError(f"there is no table of shapes {table or ''}; there are {[x[0] for x in found]}")
    return own[0]


def attributes(db: sqlite3.Connection, table: str, column: str) -> dict[str, str]:
    return {r[1]: r[2] for r in db.execute(f"PRAGMA table_info({quoted(table)})") if r[1] != column}


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> T.StructType:
        """The table's columns (long, double, or string), parts, and the bounds. Columns named like these are left out."""
        with connect(self.options["path"]) as db:
            table, column = shape_column(db, self.options.get("table"))
            found = attributes(db, table, column)
        taken = {"parts", *BOX}
        if clash := [c for c in found if c.lower() in taken]:
            raise ValueError(f"the table has columns {clash}, which the reader makes itself")
        kind = lambda t: T.LongType() if t.upper().startswith(INTEGERS) else T.DoubleType() if t.upper().startswith(REALS) else T.StringType()
        return T.StructType([*(T.StructField(c, kind(t)) for c, t in found.items()), T.StructField("parts", PARTS), *(T.StructField(c, T.DoubleType()) for c in BOX)])

    def reader(self, schema: T.StructType) -> GeoPackageReader:
        return GeoPackageReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters to Python data sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoPackageSource)


def write(df: DataFrame, path: str, table: str, srs: int = 4326, wkt: str = "undefined") -> int:
    """Writes ``df`` (its columns, and ``parts``) as the one table of a new file, with an R-tree; returns the rows. Null shapes stay null.

    Shapes are encoded in all tasks. A database has one writer, so one task inserts the rows, as a stream. The file takes its
    name when it is whole; one that is there is replaced.
    """
    if "parts" not in df.columns:
        raise ValueError("there is no column parts")
    columns = [c for c in df.columns if c not in ("parts", *BOX)]
    kinds = {c: df.schema[c].dataType for c in columns}
    sql = {c: "INTEGER" if isinstance(t, T.IntegralType) else "REAL" if isinstance(t, (T.DoubleType, T.FloatType)) else "TEXT" for c, t in kinds.items()}
    plain = df.select(*[F.col(c) if sql[c] != "TEXT" else F.col(c).cast("string").alias(c) for c in columns], "parts")
    own = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(plain.schema.fields[:-1])), T.StructField("blob", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in BOX)])
    at = _local(path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = batch.column(batch.num_columns - 1).to_pylist()
            boxes = [bounds_of(p) for p in shapes]
            blobs = [None if p is None else MAGIC + struct.pack("<BBi4d", 0, 0b11, srs, b[0], b[2], b[1], b[3]) + encode_wkb(p) if b[0] is not None else MAGIC + struct.pack("<BBi", 0, 0b10001, srs) + encode_wkb([]) for p, b in zip(shapes, boxes, strict=True)]
            made = [pa.array(blobs, pa.binary()), *(pa.array([b[k] for b in boxes], pa.float64()) for k in range(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=own.names)

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        new = f"{at}.{os.getpid()}.new"
        if os.path.exists(new):
            os.remove(new)
        db = sqlite3.connect(new)
        db.executescript(f"""
            PRAGMA application_id = {APPLICATION}; PRAGMA user_version = 10300; PRAGMA journal_mode = OFF;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT '1970-01-01T00:00:00.000Z', min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
            CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);
            CREATE TABLE {quoted(table)} ({''.join(f'{quoted(c)} {sql[c]}, ' for c in columns)}geom MULTIPOLYGON);
            CREATE VIRTUAL TABLE {quoted(f'rtree_{table}_geom')} USING rtree(id, minx, maxx, miny, maxy);""")
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", {s: (n, s, o, s, d) for n, s, o, d in (("undefined cartesian", -1, "NONE", "undefined"), ("undefined geographic", 0, "NONE", "undefined"), (f"EPSG:{srs}", srs, "EPSG", wkt))}.values())
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'MULTIPOLYGON', ?, 0, 0)", [table, srs])
        db.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", [table])
        n = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                db.execute(f"INSERT INTO {quoted(table)} (rowid{''.join(f', {quoted(c)}' for c in columns)}, geom) VALUES (?{', ?' * (len(columns) + 1)})", [n, *row[:-4]])
                if row[-4] is not None:
                    db.execute(f"INSERT INTO {quoted(f'rtree_{table}_geom')} VALUES (?, ?, ?, ?, ?)", [n, row[-4], row[-2], row[-3], row[-1]])
        bounds = db.execute(f"SELECT min(minx), min(miny), max(maxx), max(maxy) FROM {quoted(f'rtree_{table}_geom')}").fetchone()
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", [table, table, *bounds, srs])
        db.commit()
        db.close()
        os.replace(new, at)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return plain.mapInArrow(encoded, own).repartition(1).mapInArrow(insert, "n long").agg(F.sum("n")).first()[0] or 0
