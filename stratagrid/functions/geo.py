"""Geometry and geodesy as Column expressions: lattices, boxes, map projections, equal areas and grid identifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and flattening of the WGS 84 ellipsoid, GRS 80's flattening (fixed values).
A, F_WGS84, F_GRS80 = 6378137.0, 1 / 298.257223563, 1 / 298.257222101
#: Scale and false coordinates of UTM (fixed values).
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500000.0, 10000000.0
_N = F_WGS84 / (2 - F_WGS84)
#: Latitude of true scale of the cylindrical equal-area grid.
EQUAL_AREA_LATITUDE = math.radians(30)
#: Metres of northing in a degree of latitude, on average: a quarter of the meridian. Near enough to tell which 2,000 km cycle a grid square is in.
METRES_PER_DEGREE = A / (1 + _N) * (1 + _N**2 / 4) * math.pi / 180 * UTM_SCALE
#: Letters of the grid's latitude bands, and of its columns (by the zone modulo 3) and rows of squares (fixed values).
BANDS, COLUMN_LETTERS, ROW_LETTERS = "CDEFGHJKLMNPQRSTUVWX", ("STUVWXYZ", "ABCDEFGH", "JKLMNPQR"), "ABCDEFGHJKLMNPQRSTUV"


def nearest_floor(x: Column, step: float) -> Column:
    return F.floor(x / step) * F.lit(step)


def nearest_ceil(x: Column, step: float) -> Column:
    return F.ceil(x / step) * F.lit(step)


def cell(x: Column, origin: float, resolution: float) -> Column:
    """The cell's index along one axis: its lower edge belongs to it, its upper one does not."""
    return F.floor((x - F.lit(origin)) / F.lit(resolution)).cast("bigint")


def boxes_touch(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Closed boxes (xmin, ymin, xmax, ymax) that share a point at least."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def overlap_area(a: Sequence[Column], b: Sequence[Column]) -> Column:
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres (EPSG:3857) of degrees."""
    return F.radians(lon) * A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * A


def web_mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(F.atan(F.exp(y / A)) * 2 - F.lit(math.pi / 2))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_label(epsg: Column) -> Column:
    """``11N`` of 32611, ``11S`` of 32711; other codes are an error."""
    zone = epsg % 100
    good = (F.floor(epsg / 100).isin(326, 327)) & zone.between(1, 60)
    label = F.concat(zone.cast("int").cast("string"), F.when(epsg < 32700, "N").otherwise("S"))
    return F.when(good, label).otherwise(F.raise_error(F.concat(F.lit("no UTM zone has the code "), epsg.cast("string"))))


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series to the fourth order in the third flattening (Karney, 2011)."""
    n = F_WGS84 / (2 - F_WGS84)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = math.sqrt(F_WGS84 * (2 - F_WGS84))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north, east = xi, eta
    for k, a in enumerate(alpha, 1):
        north = north + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * a
        east = east + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * a
    return east * (UTM_SCALE * radius) + UTM_EAST, north * (UTM_SCALE * radius) + F.when(lat < 0, UTM_SOUTH).otherwise(0.0)


def _q(phi: Column) -> Column:
    """Twice the relative area between the equator and a latitude on the ellipsoid (Snyder, 1987, eq. 3-12)."""
    e2 = F_WGS84 * (2 - F_WGS84)
    e, s = math.sqrt(e2), F.sin(phi)
    return ((s / (F.lit(1.0) - s * s * e2)) - F.log((F.lit(1.0) - s * e) / (F.lit(1.0) + s * e)) / (2 * e)) * (1 - e2)


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres in a cylindrical equal-area projection."""
    e2, s = F_WGS84 * (2 - F_WGS84), math.sin(EQUAL_AREA_LATITUDE)
    k = math.cos(EQUAL_AREA_LATITUDE) / math.sqrt(1 - e2 * s * s)
    return F.radians(lon) * (A * k), _q(F.radians(lat)) * (A / (2 * k))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring (array of struct x, y; the last point may repeat the first or not) by the shoelace rule."""
    nxt = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def box_area_m2(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Square metres of a box of degrees."""
    (x0, y0), (x1, y1) = equal_area(west, south), equal_area(east, north)
    return (x1 - x0) * (y1 - y0)


GRID_ID = r"^(?:(\d{1,2})([C-HJ-NP-X]))?([A-HJ-NP-Z][A-HJ-NP-V])(\d{3})(\d{3})$"


def grid_zone(identifier: Column) -> tuple[Column, Column]:
    """The zone that a tile's name begins with, and whether its band lies south of the equator; null where it has none."""
    band = F.nullif(F.regexp_extract(identifier, GRID_ID, 2), F.lit(""))
    return F.nullif(F.regexp_extract(identifier, GRID_ID, 1), F.lit("")).try_cast("int"), band <= "M"


def grid_square(identifier: Column, zone: int, north_hint: Column | None = None) -> tuple[Column, Column]:
    """South-west corner (easting, northing) of a 1 km tile named like ``11SMA760990`` or ``MA870940`` in ``zone``.

    Two letters name the 100 km square: columns cycle with the zone modulo 3, rows every 20 letters (five further in even
    zones). Of the squares 2,000 km apart the one nearest to ``north_hint`` is meant; by default the middle of the band.
    Names of another zone, and those with letters that the zone does not have, give null for both.
    """
    part = lambda k: F.regexp_extract(identifier, GRID_ID, k)
    column = F.call_function("instr", F.lit(COLUMN_LETTERS[zone % 3]), F.substring(part(3), 1, 1))
    row = F.call_function("instr", F.lit(ROW_LETTERS), F.substring(part(3), 2, 1)) - 1
    base = ((row - (5 if zone % 2 == 0 else 0) + 20) % 20) * 100000
    hint = band_northing(part(2)) if north_hint is None else north_hint
    low = base + part(5).try_cast("int") * 100
    cycle = F.round((hint - base) / 2000000)
    good = (column > 0) & (row >= 0) & ((part(1) == "") | (part(1).try_cast("int") == zone))
    east = column * 100000 + part(4).try_cast("int") * 100
    return F.when(good, east.cast("double")), F.when(good, (low + cycle * 2000000).cast("double"))


def band_northing(letter: Column) -> Column:
    """About the northing of the middle of a latitude band; null for other letters."""
    latitude = (F.call_function("instr", F.lit(BANDS), letter) - 1) * 8 - 76
    return latitude * METRES_PER_DEGREE + F.when(latitude < 0, UTM_SOUTH).otherwise(0.0)


def projected_box(west: Column, south: Column, east: Column, north: Column, project, steps: int = 21) -> list[Column]:
    """xmin, ymin, xmax, ymax of a box after ``project`` (lon, lat to x, y), of ``steps`` places on each side: sides may bow outwards."""
    places = [k / (steps - 1) for k in range(steps)]
    between = lambda a, b, t: a + (b - a) * t
    rim = [(between(west, east, t), y) for y in (south, north) for t in places] + [(x, between(south, north, t)) for x in (west, east) for t in places]
    points = F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in rim])
    xs = F.transform(points, lambda p: project(p["lon"], p["lat"])[0])
    ys = F.transform(points, lambda p: project(p["lon"], p["lat"])[1])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def first_region(lon: Column, lat: Column, regions: Sequence[tuple[str, float, float, float, float]]) -> Column:
    """The first of ``regions`` (name, west, south, east, north) that holds the point; null if none does."""
    out = F.lit(None).cast("string")
    for name, west, south, east, north in reversed(regions):
        out = F.when(lon.between(west, east) & lat.between(south, north), name).otherwise(out)
    return out


def helmert(x: Column, y: Column, z: Column, years: Column, parameters: dict[str, float], rates: dict[str, float]) -> tuple[Column, Column, Column]:
    """Geocentric metres after a 14-parameter transformation: tx, ty, tz (m), rx, ry, rz (rad), s (ratio) and their yearly rates (position vector)."""
    p = {k: F.lit(parameters.get(k, 0.0)) + years * rates.get(k, 0.0) for k in ("tx", "ty", "tz", "rx", "ry", "rz", "s")}
    k = p["s"] + 1
    return p["tx"] + k * (x - p["rz"] * y + p["ry"] * z), p["ty"] + k * (p["rz"] * x + y - p["rx"] * z), p["tz"] + k * (p["rx"] * y - p["ry"] * x + z)
