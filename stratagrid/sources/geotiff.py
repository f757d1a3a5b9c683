"""GeoTIFF files as long rasters: ``spark.read.format("geotiff").load(path)``, and ``write``.

A file is an index of blocks (tiles or strips) and the blocks themselves. A reader's partition is a range of blocks of one
file, so a task reads its blocks and nothing else; blocks outside the window are not read, and overviews are read in place of
the full image. Filters on ``row`` and ``col`` narrow the window.

Blocks may be stored as they are or deflated, with either predictor; files may be larger than 4 GB. What else there is (other
compressions, rotated grids, complex numbers) is refused, and so are files that end before their blocks do.

The sink works in two steps: tasks gather cells to blocks and compress them into a table; their sizes, a few bytes a block, make
the index, and tasks then put each block at its place.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..plans.tables import written

SCHEMA = "file string, row long, col long, value double"
#: Blocks of a partition; files whose headers the driver reads itself; beyond that each task reads those of its files.
PART, HEADERS = 64, 64
#: Rows and columns of a block that is written, and the level of compression.
BLOCK, EFFORT = 256, 6
# Fixed values of the format: tags, sizes and codes of field types, sample formats, and keys of the reference system.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, SAMPLE_FORMAT, SCALE, TIEPOINT, TRANSFORM, KEYS, KEY_DOUBLES, KEY_TEXT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 34736, 34737, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
FORMATS = {1: "u", 2: "i", 3: "f"}
DEFLATE = (8, 32946)
MODEL, RASTER, CITATION, GEOGRAPHIC, PROJECTED = 1024, 1025, 1026, 2048, 3072
# End of fixed values.


@dataclass
class Image:
    """One image of a file: the full one (level 1) or an overview."""

    width: int
    height: int
    block_width: int
    block_height: int
    offsets: np.ndarray
    sizes: np.ndarray
    dtype: np.dtype
    compression: int
    predictor: int
    samples: int
    nodata: float | None
    level: int = 1

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    def box(self, block: int) -> tuple[int, int, int, int]:
        """First row and column of a block, and the rows and columns that the image has of it."""
        r, c = divmod(block, self.across)
        row, col = r * self.block_height, c * self.block_width
        return row, col, min(self.block_height, self.height - row), min(self.block_width, self.width - col)


@dataclass
class Header:
    """What a file says of itself: its images, the upper left corner, the cells' sizes, and its reference system's code."""

    images: list[Image]
    origin_x: float = 0.0
    origin_y: float = 0.0
    xres: float = 1.0
    yres: float = 1.0
    epsg: int | None = None
    citation: str | None = None
    extra: dict = field(default_factory=dict)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    files, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return files, at


def read_header(path: str, whole: bool = True) -> Header:
    """The header of a file; an error if it is none, is not supported, or (``whole``) ends before its blocks do."""
    files, at = _open(path)
    with files.open_input_file(at) as f:
        return parse_header(f.read_at, f.size(), path, whole)


def parse_header(read, size: int, path: str, whole: bool = True) -> Header:
    """``read`` (bytes, place) reads a part of the file."""
    def need(n: int, place: int) -> bytes:
        got = read(n, place) if 0 <= place <= size else b""
        if len(got) != n:
            raise ValueError(f"{path} ends before its header does")
        return got

    start = need(16, 0) if size >= 16 else need(8, 0)
    if start[:2] not in (b"II", b"MM"):
        raise ValueError(f"{path} is not a TIFF file")
    order = "<" if start[:2] == b"II" else ">"
    version = struct.unpack_from(order + "H", start, 2)[0]
    if version not in (42, 43):
        raise ValueError(f"{path} is not a TIFF file")
    big = version == 43
    place = struct.unpack_from(order + ("Q" if big else "I"), start, 8 if big else 4)[0]
    images, header, seen = [], None, set()
    while place and place not in seen:
        seen.add(place)
        n = struct.unpack(order + ("Q" if big else "H"), need(8 if big else 2, place))[0]
        each = 20 if big else 12
        if n > 4_096:
            raise ValueError(f"{path} is damaged: {n} fields")
        raw = need(n * each + (8 if big else 4), place + (8 if big else 2))
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, k * each)
            if kind not in FIELDS:
                continue
            letter = FIELDS[kind]
            length = count * struct.calcsize(order + letter)
            own = raw[k * each + (12 if big else 8):(k + 1) * each]
            if length > len(own):
                own = need(length, struct.unpack(order + ("Q" if big else "I"), own)[0])
            own = own[:length]
            tags[tag] = own if letter == "s" else np.frombuffer(own, order + (letter if letter in "Bb" else {"H": "u2", "h": "i2", "I": "u4", "i": "i4", "f": "f4", "d": "f8", "Q": "u8", "q": "i8"}[letter]))
        images.append(_image(tags, order, size if whole else 2**62, path))
        header = header or _header(tags, path)
        place = struct.unpack(order + ("Q" if big else "I"), raw[n * each:])[0]
    if header is None:
        raise ValueError(f"{path} has no image")
    for image in images:
        image.level = max(1, round(images[0].width / image.width))
    header.images = images
    return header


def _image(tags: dict, order: str, size: int, path: str) -> Image:
    one = lambda tag, default=None: int(tags[tag][0]) if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, kind, compression, predictor = set(map(int, tags.get(BITS, [1]))), set(map(int, tags.get(SAMPLE_FORMAT, [1]))), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if width is None or height is None or not width or not height:
        raise ValueError(f"{path} has an image without extent")
    if len(bits) != 1 or len(kind) != 1 or (b := bits.pop()) not in (8, 16, 32, 64) or (k := kind.pop()) not in FORMATS:
        raise ValueError(f"{path} has samples of a kind that is not supported")
    if compression not in (1, *DEFLATE):
        raise ValueError(f"{path} has compression {compression}, which is not supported")
    if predictor not in (1, 2, 3) or predictor == 3 and k != 3 or predictor == 2 and k == 3:
        raise ValueError(f"{path} has predictor {predictor}, which is not supported for its samples")
    if samples > 1 and one(PLANAR, 1) != 1:
        raise ValueError(f"{path} has its bands apart, which is not supported")
    if TILES in tags:
        bw, bh, offsets, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILES], tags[TILE_SIZES]
    else:
        bw, bh, offsets, sizes = width, min(height, one(STRIP_ROWS, height)), tags.get(STRIPS, []), tags.get(STRIP_SIZES, [])
    image = Image(width, height, bw, bh, np.asarray(offsets, np.int64), np.asarray(sizes, np.int64), np.dtype(f"{order}{FORMATS[k]}{b // 8}"), compression, predictor, samples, None)
    if len(image.offsets) != image.across * image.down or len(image.sizes) != len(image.offsets):
        raise ValueError(f"{path} has {len(image.offsets)} blocks, {image.across * image.down} are needed")
    if (image.offsets + image.sizes > size).any():
        raise ValueError(f"{path} is truncated: blocks reach to {int((image.offsets + image.sizes).max())}, the file to {size}")
    if NODATA in tags:
        text = tags[NODATA].rstrip(b"\0 ").decode()
        image.nodata = float(text) if text else None
    return image


def _header(tags: dict, path: str) -> Header:
    if TRANSFORM in tags:
        raise ValueError(f"{path} has a rotated grid, which is not supported")
    header = Header([])
    if SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2].tolist(), tags[TIEPOINT][:5].tolist()
        header.xres, header.yres, header.origin_x, header.origin_y = sx, sy, x - i * sx, y + j * sy
    keys = tags.get(KEYS, np.zeros(0, np.uint16)).tolist()
    for k in range(4, len(keys) - 3, 4):
        key, place, count, value = keys[k:k + 4]
        if key in (PROJECTED, GEOGRAPHIC) and place == 0 and value != 32767 and (key == PROJECTED or header.epsg is None):
            header.epsg = value
        if key == CITATION and place == KEY_TEXT:
            header.citation = tags[KEY_TEXT][value:value + count].rstrip(b"|\0").decode("utf-8", "replace")
    return header


def decode(data: bytes, image: Image, block: int) -> np.ndarray:
    """(rows, columns, samples) of a block, cut to the image."""
    _, _, rows, columns = image.box(block)
    if image.compression != 1:
        data = zlib.decompress(data)
    # the last strip may be shorter than the others
    width, dtype = image.block_width * image.samples, image.dtype
    height = len(data) // (width * dtype.itemsize)
    if height < rows:
        raise ValueError(f"block {block} has {height} rows, {rows} are needed")
    data = data[:height * width * dtype.itemsize]
    if image.predictor == 3:
        # bytes of equal weight stand together, the highest first, each as the difference from the one a sample before
        raw = np.frombuffer(data, np.uint8).reshape(height, -1, image.samples)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(height, dtype.itemsize, width)
        out = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(dtype.newbyteorder(">"))[:, :, 0].reshape(height, image.block_width, image.samples)
    else:
        out = np.frombuffer(data, dtype).reshape(height, image.block_width, image.samples)
        if image.predictor == 2:
            out = np.cumsum(out.astype(dtype.newbyteorder("=")), axis=1, dtype=dtype.newbyteorder("="))
    return out[:rows, :columns]


def valid(cells: np.ndarray, image: Image) -> np.ndarray:
    """Which cells have data."""
    good = ~np.isnan(cells) if cells.dtype.kind == "f" else np.ones(cells.shape, bool)
    if image.nodata is not None:
        good &= cells != np.array(image.nodata).astype(cells.dtype) if cells.dtype.kind == "f" else cells != image.nodata
    return good


def encode(cells: np.ndarray, compression: int = 8, predictor: int = 1) -> bytes:
    """A block's bytes from its rows and columns (little-endian)."""
    if predictor == 2:
        cells = np.diff(cells, axis=1, prepend=cells.dtype.type(0))
    if predictor == 3:
        raw = cells.astype(cells.dtype.newbyteorder(">")).view(np.uint8).reshape(*cells.shape, -1).transpose(0, 2, 1).reshape(cells.shape[0], -1)
        data = np.diff(raw, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    else:
        data = cells.astype(cells.dtype.newbyteorder("<")).tobytes()
    return data if compression == 1 else zlib.compress(data, EFFORT)


class Blocks(InputPartition):
    """A range of blocks of a file's image; of whole files where ``blocks`` is None."""

    def __init__(self, paths: list[str], image: Image | None, blocks: list[int] | None):
        self.paths, self.image, self.blocks = paths, image, blocks


class GeoTiffReader(DataSourceReader):
    """Options: level (1, or the factor of an overview that the file has), band (from 1), row_min, row_max, col_min, col_max (a window,
    with its ends, in rows and columns of that level), xmin, ymin, xmax, ymax (a window in map units), part (blocks of a partition),
    damaged (``skip``: blocks that are cut or can't be decoded are left out; by default they are an error).
    Cells without data give no rows."""

    def __init__(self, options: dict):
        self.options = options
        self.level, self.band = int(options.get("level", 1)), int(options.get("band", 1))
        edge = lambda name, default: int(options.get(name, default))
        self.window = [edge("row_min", 0), edge("row_max", 2**62), edge("col_min", 0), edge("col_max", 2**62)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the window. Spark applies all filters again, as blocks hold other cells too."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at in (("row",), ("col",)) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                low, high = (0, 1) if at == ("row",) else (2, 3)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.window[low] = max(self.window[low], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.window[high] = min(self.window[high], f.value - isinstance(f, LessThan))
            yield f

    def paths(self) -> list[str]:
        from pyarrow import fs

        path = self.options["path"]
        files, at = _open(path)
        if files.get_file_info(at).type == fs.FileType.File:
            return [path]
        prefix = path[:len(path) - len(path.split("://", 1)[1])] if "://" in path else ""
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.lower().endswith((".tif", ".tiff")))
        if not found:
            raise ValueError(f"no GeoTIFF files in {path}")
        return [prefix + p for p in found]

    def chosen(self, path: str) -> tuple[Image, list[int]]:
        """The image of the level that is asked for, and its blocks that the window meets."""
        header = read_header(path, self.options.get("damaged") != "skip")
        image = next((x for x in header.images if x.level == self.level), None)
        if image is None:
            raise ValueError(f"{path} has no level {self.level}; there are {[x.level for x in header.images]}")
        if not 1 <= self.band <= image.samples:
            raise ValueError(f"{path} has {image.samples} bands, not {self.band}")
        image.nodata = header.images[0].nodata if image.nodata is None else image.nodata
        low_row, high_row, low_col, high_col = self.window
        if all(c in self.options for c in ("xmin", "ymin", "xmax", "ymax")):
            xmin, ymin, xmax, ymax = (float(self.options[c]) for c in ("xmin", "ymin", "xmax", "ymax"))
            xres, yres = header.xres * header.images[0].width / image.width, header.yres * header.images[0].height / image.height
            low_col, high_col = max(low_col, math.floor((xmin - header.origin_x) / xres)), min(high_col, math.ceil((xmax - header.origin_x) / xres) - 1)
            low_row, high_row = max(low_row, math.floor((header.origin_y - ymax) / yres)), min(high_row, math.ceil((header.origin_y - ymin) / yres) - 1)
        self.rows, self.columns = (low_row, high_row), (low_col, high_col)
        down = range(max(0, low_row) // image.block_height, min(image.height - 1, high_row) // image.block_height + 1) if low_row < image.height and high_row >= 0 else []
        across = range(max(0, low_col) // image.block_width, min(image.width - 1, high_col) // image.block_width + 1) if low_col < image.width and high_col >= 0 else []
        return image, [r * image.across + c for r in down for c in across if image.sizes[r * image.across + c]]

    def partitions(self) -> Sequence[Blocks]:
        found, size = self.paths(), int(self.options.get("part", PART))
        if len(found) > HEADERS:
            return [Blocks(found[k:k + 8], None, None) for k in range(0, len(found), 8)]
        out = []
        for path in found:
            _, blocks = self.chosen(path)
            out += [Blocks([path], None, blocks[k:k + size]) for k in range(0, len(blocks), size)]
        return out

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        for path in part.paths:
            image, blocks = self.chosen(path)
            files, at = _open(path)
            with files.open_input_file(at) as f:
                for block in blocks if part.blocks is None else part.blocks:
                    row, col, rows, columns = image.box(block)
                    try:
                        cells = decode(f.read_at(int(image.sizes[block]), int(image.offsets[block])), image, block)[:, :, self.band - 1]
                    except (ValueError, zlib.error):
                        if self.options.get("damaged") == "skip":
                            continue
                        raise
                    r0, c0 = max(0, self.rows[0] - row), max(0, self.columns[0] - col)
                    cells = cells[r0:max(r0, self.rows[1] - row + 1), c0:max(c0, self.columns[1] - col + 1)]
                    r, c = np.nonzero(valid(cells, image))
                    yield pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(len(r), np.int64))), pa.array(r + row + r0), pa.array(c + col + c0), pa.array(cells[r, c].astype(np.float64))], names=["file", "row", "col", "value"])


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters to Python data sources, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)


@dataclass
class Grid:
    """Where a raster's cells are: upper left corner, cell size, rows and columns; how values are stored (``dtype``: a NumPy name), which
    value means no data, and the code of the reference system."""

    width: int
    height: int
    origin_x: float = 0.0
    origin_y: float = 0.0
    res: float = 1.0
    nodata: float | None = None
    dtype: str = "float32"
    epsg: int | None = None
    geographic: bool = False

    def cropped(self, xmin: float, ymin: float, xmax: float, ymax: float) -> tuple[Grid, int, int]:
        """The grid of the cells that the extent touches, and how many rows and columns it begins further in (less than 0: further out)."""
        close = 1e-9
        col, row = math.floor((xmin - self.origin_x) / self.res + close), math.floor((self.origin_y - ymax) / self.res + close)
        width, height = math.ceil((xmax - self.origin_x) / self.res - close) - col, math.ceil((self.origin_y - ymin) / self.res - close) - row
        if width <= 0 or height <= 0:
            raise ValueError("the extent is empty")
        return Grid(width, height, self.origin_x + col * self.res, self.origin_y - row * self.res, self.res, self.nodata, self.dtype, self.epsg, self.geographic), row, col


def cropped(raster: DataFrame, grid: Grid, extent: tuple[float, float, float, float]) -> tuple[DataFrame, Grid]:
    """``raster`` (row, col, value, ...) on the grid of an extent (xmin, ymin, xmax, ymax)."""
    own, row, col = grid.cropped(*extent)
    moved = raster.withColumns({"row": F.col("row") - row, "col": F.col("col") - col})
    return moved.where(F.col("row").between(0, own.height - 1) & F.col("col").between(0, own.width - 1)), own


def _blocks(raster: DataFrame, grid: Grid, block: int, predictor: int) -> DataFrame:
    """(level, tile, size, data): the compressed blocks that have data of ``raster`` (level, row, col, value)."""
    dtype = np.dtype(grid.dtype)
    if dtype.kind != "f" and grid.nodata is None:
        raise ValueError(f"a raster of {grid.dtype} needs a value for cells without data")
    filler = np.array(math.nan if grid.nodata is None else grid.nodata).astype(dtype)
    info = np.iinfo(dtype) if dtype.kind != "f" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, np.empty(0)

        def done() -> pa.RecordBatch:
            data = encode(at, 8, predictor)
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["level", "tile", "size", "data"])

        for batch in batches:
            level, tile, row, col = (batch.column(c).to_numpy() for c in ("level", "tile", "row", "col"))
            value = batch.column("value").to_numpy()
            value = value.astype(dtype) if info is None else np.clip(np.rint(value), info.min, info.max).astype(dtype)
            cuts = np.flatnonzero((np.diff(level) != 0) | (np.diff(tile) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(level)]):
                if a == b:
                    continue
                if held != (level[a], tile[a]):
                    if held is not None:
                        yield done()
                    held, at = (level[a], tile[a]), np.full((block, block), filler)
                at[row[a:b] % block, col[a:b] % block] = value[a:b]
        if held is not None:
            yield done()

    across = F.ceil(F.ceil(F.lit(grid.width) / F.col("level")) / block)
    inside = F.col("row").between(0, F.ceil(F.lit(grid.height) / F.col("level")) - 1) & F.col("col").between(0, F.ceil(F.lit(grid.width) / F.col("level")) - 1)
    tile = (F.floor(F.col("row") / block) * across + F.floor(F.col("col") / block)).cast("bigint")
    cells = raster.where(F.col("value").isNotNull() & ~F.isnan("value") & inside).select(F.col("level").cast("int").alias("level"), tile.alias("tile"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value"))
    return cells.repartition("level", "tile").sortWithinPartitions("level", "tile").mapInArrow(run, "level int, tile long, size long, data binary")


def _index(grid: Grid, levels: list[int], block: int, predictor: int, sizes: dict[int, dict[int, int]]) -> tuple[bytes, dict[tuple[int, int], int], int]:
    """The bytes before the blocks, the place of each block (level, tile), and the file's size. Always of the kind for large files."""
    images = []
    for level in levels:
        width, height = -(-grid.width // level), -(-grid.height // level)
        across, down = -(-width // block), -(-height // block)
        images.append((level, width, height, across * down))
    dtype = np.dtype(grid.dtype)
    keys = [(MODEL, 0, 1, 2 if grid.geographic else 1), (RASTER, 0, 1, 1)]
    if grid.epsg is not None:
        keys.append((GEOGRAPHIC if grid.geographic else PROJECTED, 0, 1, grid.epsg))
    flat = [1, 1, 0, len(keys), *(x for key in keys for x in key)]

    def tags(level: int, width: int, height: int, n: int, offsets: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, bytes]]:
        short, long_ = lambda *v: struct.pack(f"<{len(v)}H", *v), lambda *v: struct.pack(f"<{len(v)}I", *v)
        out = [
            (SUBFILE, 4, long_(int(level > 1))), (WIDTH, 4, long_(width)), (HEIGHT, 4, long_(height)), (BITS, 3, short(dtype.itemsize * 8)), (COMPRESSION, 3, short(8)), (PHOTOMETRIC, 3, short(1)), (SAMPLES, 3, short(1)), (PLANAR, 3, short(1)), (PREDICTOR, 3, short(predictor)),
            (TILE_WIDTH, 3, short(block)), (TILE_HEIGHT, 3, short(block)), (TILES, 16, offsets.astype("<u8").tobytes()), (TILE_SIZES, 16, counts.astype("<u8").tobytes()), (SAMPLE_FORMAT, 3, short({"u": 1, "i": 2, "f": 3}[dtype.kind])),
        ]
        if level == 1:
            out += [(SCALE, 12, struct.pack("<3d", grid.res, grid.res, 0.0)), (TIEPOINT, 12, struct.pack("<6d", 0, 0, 0, grid.origin_x, grid.origin_y, 0)), (KEYS, 3, short(*flat))]
        if grid.nodata is not None:
            out.append((NODATA, 2, f"{grid.nodata:.17g}".encode() + b"\0"))
        return sorted(out)

    width_of = {2: 1, 3: 2, 4: 4, 12: 8, 16: 8}
    start, layout = 16, []
    for level, width, height, n in images:
        zeros = np.zeros(n, np.int64)
        fields = tags(level, width, height, n, zeros, zeros)
        length = 8 + 20 * len(fields) + 8 + sum(len(data) + len(data) % 2 for _, _, data in fields if len(data) > 8)
        layout.append((start, level, width, height, n))
        start += length
    places, end = {}, start
    # overviews before the full image, so that a look at the file reads its beginning
    for level in sorted(levels, reverse=True):
        for tile in sorted(sizes.get(level, {})):
            places[level, tile] = end
            end += sizes[level][tile]
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
    for k, (begin, level, width, height, n) in enumerate(layout):
        offsets, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for tile, size in sizes.get(level, {}).items():
            offsets[tile], counts[tile] = places[level, tile], size
        fields = tags(level, width, height, n, offsets, counts)
        body, extra, spare = struct.pack("<Q", len(fields)), b"", begin + 8 + 20 * len(fields) + 8
        for tag, kind, data in fields:
            own = data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", spare + len(extra))
            body += struct.pack("<HHQ", tag, kind, len(data) // width_of[kind]) + own
            extra += (data + b"\0" * (len(data) % 2)) if len(data) > 8 else b""
        out += body + struct.pack("<Q", layout[k + 1][0] if k + 1 < len(layout) else 0) + extra
    return bytes(out), places, end


def write(raster: DataFrame, path: str, grid: Grid, block: int = BLOCK, predictor: int | None = None) -> dict[int, int]:
    """Writes ``raster`` (row, col, value, and level where it has overviews: 1 is the full image) to one file; returns the blocks of each level.

    Cells outside the grid, and null values, are left out; whole numbers are rounded and held in their type's range. Of a cell
    that is there twice either value is kept. Blocks without data take no room. ``block`` is a multiple of 16. ``predictor``: 1
    none, 2 differences (whole numbers), 3 for floating point; by default what suits the type. A raster without cells is written, too.
    Where tasks can't write into a file at any place (object stores), one task appends all blocks in order.
    """
    if block % 16 or grid.width <= 0 or grid.height <= 0:
        raise ValueError("blocks have a multiple of 16 rows, and a grid has cells")
    spark, floating = raster.sparkSession, np.dtype(grid.dtype).kind == "f"
    predictor = (3 if floating else 2) if predictor is None else predictor
    if predictor == 2 and floating or predictor == 3 and not floating:
        raise ValueError(f"predictor {predictor} does not suit {grid.dtype}")
    has = "level" in {c.lower() for c in raster.columns}
    levels = sorted({1, *(int(r[0]) for r in raster.select("level").distinct().collect())}) if has else [1]
    blocks = written(_blocks(raster if has else raster.withColumn("level", F.lit(1)), grid, block, predictor), "geotiff-blocks")
    # the index of a file lists all its blocks, so it is as long as this list
    sizes: dict[int, dict[int, int]] = {}
    for r in blocks.select("level", "tile", "size").toLocalIterator():
        sizes.setdefault(r["level"], {})[r["tile"]] = r["size"]
    head, places, end = _index(grid, levels, block, predictor, sizes)
    files, at = _open(path)
    local = files.type_name == "local"
    told = spark.sparkContext.broadcast(places)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = os.open(at, os.O_WRONLY)
        n = 0
        try:
            for batch in batches:
                for level, tile, data in zip(*(batch.column(c).to_pylist() for c in ("level", "tile", "data")), strict=True):
                    os.pwrite(handle, data, told.value[level, tile])
                    n += 1
            os.fsync(handle)
        finally:
            os.close(handle)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, where = _open(path)
        n = 0
        with own.open_output_stream(where, compression=None) as out:
            out.write(head)
            for batch in batches:
                for data in batch.column("data"):
                    out.write(data.as_buffer())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    if local:
        os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
        with open(at, "wb") as f:
            f.write(head)
            f.truncate(end)
        blocks.mapInArrow(put, "n long").agg(F.sum("n")).collect()
    else:
        blocks.orderBy(F.col("level").desc(), "tile").coalesce(1).mapInArrow(append, "n long").agg(F.sum("n")).collect()
    told.destroy()
    return {level: len(sizes.get(level, {})) for level in levels}
