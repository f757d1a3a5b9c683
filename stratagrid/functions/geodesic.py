"""Areas of polygons whose sides are geodesics of the ellipsoid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import A, F_WGS84

#: Square metres from which an area is called very large.
LARGE = 1e10
_E2 = F_WGS84 * (2 - F_WGS84)
#: The second eccentricity, squared; points and weights of Gauss and Legendre.
_EP2 = _E2 / (1 - _E2)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)


def _series(n: int = 10) -> list[float]:
    """Coefficients of t(x) = x + sqrt(1 + 1 / x) * asinh(sqrt(x)) (Karney, 2013, eq. 61); x is below 0.007 here."""
    a = [(-4.0) ** k * math.factorial(k) ** 2 / math.factorial(2 * k + 1) for k in range(n)]
    return [a[0], a[1] + a[0] + 1] + [a[k] + a[k - 1] for k in range(2, n)]


_T = _series()


def _authalic(phi: np.ndarray) -> np.ndarray:
    """Twice the relative area between the equator and a latitude (Snyder, 1987, eq. 3-12)."""
    e2 = F_WGS84 * (2 - F_WGS84)
    e, s = math.sqrt(e2), np.sin(phi)
    return (1 - e2) * (s / (1 - e2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))


#: Twice the relative area of a hemisphere for each radian.
_POLE = float(_authalic(np.array(math.pi / 2)))


def _flattened(x: np.ndarray) -> np.ndarray:
    """(t(e'2) - t(x)) / (e'2 - x), term by term, so that nothing cancels where x comes near e'2."""
    total, powers = np.zeros_like(x), np.ones_like(x)
    for k in range(1, len(_T)):
        # powers: the sum of e'2**i * x**(k - 1 - i)
        total += _T[k] * powers
        powers = powers * x + _EP2**k
    return total


def below(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of geodesics between places in degrees: the area between each and the equator (of an ellipsoid with the axis 1, doubled, eastward
    and north of the equator positive), and the longitude that it runs through (radians).

    Vincenty (1975) gives the geodesic, the spherical excess and an integral of Karney (2013, eq. 58 to 63) its area, at the cost of a few
    numbers a side, however long it is. Ends that lie nearly opposite on the globe are an error.
    """
    f = F_WGS84
    p1, p2 = np.radians(lat1), np.radians(lat2)
    turned = np.radians((lon2 - lon1 + 180) % 360 - 180)
    polar1, polar2 = np.abs(lat1) == 90, np.abs(lat2) == 90
    # a meridian, and a turn at the pole
    polar = (turned != 0) & (polar1 | polar2)
    area = np.where(polar, turned * np.where(polar1, np.sign(lat1), np.sign(lat2)) * _POLE, 0.0)
    k = np.flatnonzero(~polar & (turned != 0))
    if not len(k):
        return area, turned
    wanted, u1, u2 = turned[k], np.arctan2((1 - f) * np.sin(p1[k]), np.cos(p1[k])), np.arctan2((1 - f) * np.sin(p2[k]), np.cos(p2[k]))
    (s1, c1), (s2, c2) = (np.sin(u1), np.cos(u1)), (np.sin(u2), np.cos(u2))
    lam, going = wanted.copy(), np.arange(len(k))
    sigma, course, sin_a = np.zeros(len(k)), np.zeros(len(k)), np.zeros(len(k))
    for _ in range(100):
        w, l, a1, b1, a2, b2 = wanted[going], lam[going], s1[going], c1[going], s2[going], c2[going]  # noqa: E741
        sin_l, cos_l = np.sin(l), np.cos(l)
        north = b1 * a2 - a1 * b2 * cos_l
        sin_s, cos_s = np.hypot(b2 * sin_l, north), a1 * a2 + b1 * b2 * cos_l
        arc = np.arctan2(sin_s, cos_s)
        with np.errstate(divide="ignore", invalid="ignore"):
            sine = np.where(sin_s > 0, b1 * b2 * sin_l / sin_s, 0.0)
            cos2_a = 1 - sine**2
            middle = np.where(cos2_a > 1e-15, cos_s - 2 * a1 * a2 / cos2_a, 0.0)
        c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
        new = w + (1 - c) * f * sine * (arc + c * sin_s * (middle + c * cos_s * (2 * middle**2 - 1)))
        sigma[going], sin_a[going], course[going], lam[going] = arc, sine, np.arctan2(b2 * sin_l, north), new
        # what is no number doesn't get nearer either
        going = going[np.abs(new - l) >= 1e-14]
        if not len(going):
            break
    else:
        at = k[going[0]]
        raise ValueError(f"the geodesic from ({lon1[at]}, {lat1[at]}) to ({lon2[at]}, {lat2[at]}) can't be told: its ends are opposite")
    excess = 2 * np.arctan2(np.sin(lam / 2) * (s1 * (1 + c2) + s2 * (1 + c1)), np.cos(lam / 2) * (s1 * s2 + (1 + c1) * (1 + c2)))
    cos_a = np.hypot(np.cos(course), np.sin(course) * s1)
    first = np.arctan2(s1, np.cos(course) * c1)
    part = np.zeros(len(k))
    for node, weight in zip(_NODES.tolist(), _WEIGHTS.tolist(), strict=True):
        sine = np.sin(first + sigma * (node + 1) / 2)
        part -= weight * sine * _flattened(_EP2 * cos_a**2 * sine**2)
    area[k] = _POLE * excess + 2 * _E2 * cos_a * sin_a * part * sigma / 4
    return area, turned


def ring_areas(lon: np.ndarray, lat: np.ndarray, ring: np.ndarray, n: int) -> np.ndarray:
    """Square metres within ``n`` rings of geodesics, whichever way they run; of the two sides of a ring the smaller one. ``ring`` numbers
    each point's ring, whose points lie together. A ring may hold a pole or cross the antimeridian, and may repeat its first point at its end."""
    counts = np.bincount(ring, minlength=n)
    ends = np.cumsum(counts)
    starts = ends - counts
    some = np.flatnonzero(counts > 1)
    twice = some[(lon[starts[some]] == lon[ends[some] - 1]) & (lat[starts[some]] == lat[ends[some] - 1])]
    kept = np.ones(len(lon), bool)
    kept[ends[twice] - 1] = False
    counts[twice] -= 1
    kept &= counts[ring] >= 3
    lon, lat, ring = lon[kept], lat[kept], ring[kept]
    if not len(ring):
        return np.zeros(n)
    # each point's next one; the last one's is the first
    following = np.arange(1, len(ring) + 1)
    last = np.append(np.flatnonzero(np.diff(ring)), len(ring) - 1)
    following[last] = np.append(0, last[:-1] + 1)
    area, turned = below(lon, lat, lon[following], lat[following])
    total, around = (np.bincount(ring, weights=v, minlength=n) for v in (area, turned))
    half = 2 * math.pi * _POLE
    # a ring around a pole: what lies between it and the equator, taken from the hemisphere
    found = np.where(np.abs(around) > math.pi, half - np.abs(total), np.abs(total))
    return np.where(counts < 3, 0.0, np.minimum(found, 2 * half - found) * A * A / 2)


def ring_area(lon: list[float], lat: list[float]) -> float:
    """``ring_areas`` of one ring."""
    return float(ring_areas(np.array(lon, float), np.array(lat, float), np.zeros(len(lon), int), 1)[0])


def polygon_area(parts: Column) -> Column:
    """Square metres of ``parts`` in degrees (an array of parts, each an array of rings, the outer one and its holes, of struct x, y): holes
    are taken from their part. Null stays null."""
    def areas(shapes: pa.Array) -> pa.Array:
        size = lambda a: a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
        owners = lambda a: np.repeat(np.arange(len(a)), size(a))
        rings = shapes.flatten()
        # empty arrays may come without the buffers that flattening needs
        lines = rings.flatten() if len(rings) else rings
        points = lines.flatten() if len(lines) else lines
        if not len(points):
            if rings.null_count or lines.null_count:
                raise ValueError("parts, rings and coordinates must not be null")
            return pa.array(np.zeros(len(shapes)), pa.float64(), mask=shapes.is_null().to_numpy(zero_copy_only=False))
        x, y = (pc.struct_field(points, c) for c in ("x", "y"))
        if rings.null_count or lines.null_count or x.null_count or y.null_count:
            raise ValueError("parts, rings and coordinates must not be null")
        part_of = owners(rings)
        area = ring_areas(*(c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y)), owners(lines), len(lines))
        # the first ring of a part counts, those behind it are taken from it
        first = np.append(True, part_of[1:] != part_of[:-1])[:len(part_of)]
        whole = np.bincount(part_of, weights=np.where(first, area, -area), minlength=len(rings))
        out = np.bincount(owners(shapes), weights=whole, minlength=len(shapes))
        return pa.array(out, pa.float64(), mask=shapes.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(areas, "double")(parts)


def size_note(square_metres: Column) -> Column:
    """A warning for very large areas (10,000 square kilometres and more); null for others."""
    return F.when(square_metres >= LARGE, F.concat(F.lit("very large area: "), F.format_number(square_metres / 1e6, 0), F.lit(" km2; less than 10,000 km2 is recommended")))
