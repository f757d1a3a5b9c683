"""A data source for uncompressed LAS files (1.0 to 1.4): ``spark.read.format("las").load(path)``.

Point records have a fixed length, so a file is read in parts of so many records, each by its own task. Compressed files
(LAZ) are refused: no public decoder is at hand here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, x double, y double, z double, intensity int, rn short, nr short, cls short, source_id int, gps_time double"
#: Records in one part.
PART = 1_000_000
#: The record that has a CRS as text; where the GPS time is in the point formats that have one (fixed values).
WKT = 2112
TIME_AT = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}


def _open(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return files, at


def header(path: str) -> dict:
    """What a file's header says: version, number and length of records, scales, offsets and bounds."""
    files, at = _open(path)
    with files.open_input_file(at) as f:
        h = f.read_at(375, 0)
    if h[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    start, _, kind, length, n = struct.unpack_from("<IIBHI", h, 96)
    if kind & 0x80:
        raise ValueError(f"{path} is compressed")
    if h[25] >= 4 and n == 0:
        n = struct.unpack_from("<Q", h, 247)[0]
    numbers = struct.unpack_from("<12d", h, 131)
    return {"version": f"{h[24]}.{h[25]}", "start": start, "format": kind & 0x3F, "length": length, "n": n, "scale": numbers[:3], "offset": numbers[3:6], "xmin": numbers[7], "ymin": numbers[9], "xmax": numbers[6], "ymax": numbers[8]}


def crs(path: str) -> str | None:
    """The well-known text of a file's coordinate reference system, from its variable-length records; None if it has none."""
    files, at = _open(path)
    with files.open_input_file(at) as f:
        h = f.read_at(104, 0)
        if h[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        place, n = struct.unpack_from("<H", h, 94)[0], struct.unpack_from("<I", h, 100)[0]
        for _ in range(n):
            user, number, length = struct.unpack_from("<2x16sHH", f.read_at(54, place))
            if user.rstrip(b"\0") == b"LASF_Projection" and number == WKT:
                return f.read_at(length, place + 54).rstrip(b"\0").decode()
            place += 54 + length
    return None


def decode(data: bytes, h: dict) -> dict[str, np.ndarray]:
    """Columns of whole records."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, h["length"])
    take = lambda at, kind: np.ascontiguousarray(raw[:, at:at + np.dtype(kind).itemsize]).view(kind)[:, 0]
    xyz = [take(4 * k, "<i4") * h["scale"][k] + h["offset"][k] for k in range(3)]
    bits = raw[:, 14].astype(np.int16)
    if h["format"] >= 6:
        rn, nr, cls, source = bits & 15, bits >> 4, raw[:, 16].astype(np.int16), take(20, "<u2")
    else:
        rn, nr, cls, source = bits & 7, bits >> 3 & 7, (raw[:, 15] & 31).astype(np.int16), take(18, "<u2")
    time = take(TIME_AT[h["format"]], "<f8") if h["format"] in TIME_AT else np.full(len(raw), np.nan)
    return {"x": xyz[0], "y": xyz[1], "z": xyz[2], "intensity": take(12, "<u2").astype(np.int32), "rn": rn, "nr": nr, "cls": cls, "source_id": source.astype(np.int32), "gps_time": time}


class Part(InputPartition):
    def __init__(self, path: str, first: int, n: int, header: dict):
        self.path, self.first, self.n, self.header = path, first, n, header


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def paths(self) -> list[str]:
        from pyarrow import fs

        path = self.options["path"]
        files, at = _open(path)
        info = files.get_file_info(at)
        if info.type == fs.FileType.File:
            return [path]
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.path.lower().endswith((".las", ".laz")))
        prefix = path[: len(path) - len(path.split("://", 1)[1])] if "://" in path else ""
        return [prefix + p for p in found]

    def partitions(self) -> Sequence[Part]:
        """Files that lie wholly outside the box of the options xmin, ymin, xmax, ymax are not read."""
        box = [float(self.options[c]) if c in self.options else None for c in ("xmin", "ymin", "xmax", "ymax")]
        out = []
        for path in self.paths():
            h = header(path)
            if None not in box and (h["xmin"] > box[2] or h["xmax"] < box[0] or h["ymin"] > box[3] or h["ymax"] < box[1]):
                continue
            size = int(self.options.get("part", PART))
            out += [Part(path, k, min(size, h["n"] - k), h) for k in range(0, h["n"], size)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        files, at = _open(part.path)
        with files.open_input_file(at) as f:
            for k in range(part.first, part.first + part.n, 65_536):
                n = min(65_536, part.first + part.n - k)
                columns = decode(f.read_at(n * part.header["length"], part.header["start"] + k * part.header["length"]), part.header)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), *(pa.array(c, from_pandas=name == "gps_time") for name, c in columns.items())], names=["file", *columns])


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LasSource)
