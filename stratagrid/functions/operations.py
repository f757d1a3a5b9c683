"""Coordinate operations written as pipelines of steps (``+proj=pipeline +step ...``), compiled to Column expressions.

Steps: set (the epoch), axisswap, unitconvert, noop, longlat, utm, tmerc, webmerc, cart, helmert (with yearly rates) and vgridshift, each
forward or ``+inv``. Anything else is an error: an operation that is not applied in full moves points without a word.
Angles are radians between steps, as in the language; what a pipeline's ends have is up to its own unitconvert steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo
from .geodesy import _with

# Ellipsoids (semi-major axis, flattening) and units in metres or radians.
ELLIPSOIDS = {"WGS84": (6378137.0, 1 / 298.257223563), "GRS80": (6378137.0, 1 / 298.257222101), "clrk66": (6378206.4, 1 / 294.9786982138982)}
UNITS = {"m": 1.0, "ft": 0.3048, "us-ft": 1200 / 3937, "km": 1000.0, "rad": 1.0, "deg": math.pi / 180, "grad": math.pi / 200}
# End of fixed values.
ARCSECOND = math.pi / 180 / 3600


@dataclass(frozen=True)
class Step:
    name: str
    params: tuple[tuple[str, str], ...]
    inverse: bool = False

    def get(self, key: str, default: str | None = None) -> str | None:
        return dict(self.params).get(key, default)

    def number(self, key: str, default: float = 0.0) -> float:
        value = self.get(key)
        return default if value is None else float(value)


def parse(text: str) -> list[Step]:
    """The steps of a pipeline, or the one step of an operation that is none. The signs before words may be absent."""
    words = [w.removeprefix("+") for w in text.split()]
    if not words:
        raise ValueError("the operation is empty")
    groups: list[list[str]] = [[]]
    for w in words:
        if w == "step":
            groups.append([])
        else:
            groups[-1].append(w)
    head, rest = groups[0], groups[1:]
    common: tuple[tuple[str, str], ...] = ()
    if "proj=pipeline" in head:
        common = tuple((k, v) for w in head if "=" in w and w != "proj=pipeline" for k, v in [w.split("=", 1)])
        if not rest:
            raise ValueError("the pipeline has no steps")
    elif rest:
        raise ValueError("steps stand behind +proj=pipeline")
    else:
        rest = [head]
    out = []
    for words in rest:
        pairs = [tuple(w.split("=", 1)) if "=" in w else (w, "") for w in words]
        named = dict(pairs)
        if "proj" not in named:
            raise ValueError(f"a step without +proj: {' '.join(words)}")
        own = tuple((k, v) for k, v in pairs if k not in ("proj", "inv"))
        out.append(Step(named["proj"], tuple({**dict(common), **dict(own)}.items()), "inv" in named))
    if "inv" in head and "proj=pipeline" in head:
        out = inverted(out)
    return out


def inverted(steps: Sequence[Step]) -> list[Step]:
    """The steps that undo ``steps``. What sets the epoch stays as it is."""
    return [replace(s, inverse=not s.inverse) if s.name not in ("set", "noop") else s for s in reversed(steps)]


def write(steps: Sequence[Step]) -> str:
    each = [f"+step {'+inv ' if s.inverse else ''}+proj={s.name}" + "".join(f" +{k}={v}" if v else f" +{k}" for k, v in s.params) for s in steps]
    return " ".join(["+proj=pipeline", *each])


def pinned(text: str, epoch: float, required: Sequence[str] = ()) -> str:
    """The operation with its epoch set at both ends. It must have all of ``required`` (for example ``+proj=helmert``, ``vgridshift``): an
    operation that leaves one out is an error, and so is one with rates but no epoch that they count from."""
    steps = [s for s in parse(text) if s.name != "set"]
    whole = write(steps)
    if missing := [r for r in required if r not in whole]:
        raise ValueError(f"the operation lacks {missing}: {whole}")
    for s in steps:
        if s.name == "helmert" and any(k[0] == "d" and s.number(k) for k, _ in s.params if k in RATES) and s.get("t_epoch") is None:
            raise ValueError(f"a transformation with rates has no t_epoch: {whole}")
    fixed = Step("set", (("v_4", f"{epoch:g}"),))
    return write([fixed, *steps, fixed])


RATES = ("dx", "dy", "dz", "drx", "dry", "drz", "ds")


def _ellipsoid(step: Step) -> tuple[float, float]:
    if step.get("a"):
        a = step.number("a")
        return a, 1 / step.number("rf") if step.get("rf") else step.number("f") if step.get("f") else 1 - step.number("b", a) / a
    name = step.get("ellps") or step.get("datum") or "GRS80"
    name = {"NAD83": "GRS80"}.get(name, name)
    if name not in ELLIPSOIDS:
        raise ValueError(f"no ellipsoid {name!r}")
    return ELLIPSOIDS[name]


def _series(n: float) -> tuple[list[float], list[float], list[float]]:
    """Coefficients of the transverse Mercator projection in the third flattening: forward, back, and of the latitude (Krueger, 1912)."""
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return alpha, beta, delta


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def _tmerc(step: Step, p: Column, inverse: bool) -> Column:
    a, f = _ellipsoid(step)
    if step.name == "utm":
        zone = int(step.number("zone"))
        if not 1 <= zone <= 60:
            raise ValueError(f"no UTM zone {zone}")
        lon0, k0, x0, y0 = math.radians(6 * zone - 183), geo.UTM_SCALE, geo.UTM_EAST, geo.UTM_SOUTH if step.get("south") is not None else 0.0
    else:
        if step.number("lat_0"):
            raise ValueError("a latitude of origin other than 0 is not supported")
        lon0, k0, x0, y0 = math.radians(step.number("lon_0")), step.number("k", step.number("k_0", 1.0)), step.number("x_0"), step.number("y_0")
    n = f / (2 - f)
    radius = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha, beta, delta = _series(n)
    sums = lambda c, q, cross: sum((F.lit(v) * (F.sin(q["u"] * (2 * k)) * F.cosh(q["v"] * (2 * k)) if not cross else F.cos(q["u"] * (2 * k)) * F.sinh(q["v"] * (2 * k))) for k, v in enumerate(c, 1)), F.lit(0.0))
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    if not inverse:
        e = 2 * math.sqrt(n) / (1 + n)
        tau = _with(F.sin(p["y"]), lambda s: F.sinh(F.atanh(s) - F.lit(e) * F.atanh(s * e)))
        ground = _with(F.struct(tau.alias("t"), (p["x"] - lon0).alias("l")), lambda q: pair(F.atan2(q["t"], F.cos(q["l"])), F.asinh(F.sin(q["l"]) / F.sqrt(q["t"] * q["t"] + F.cos(q["l"]) * F.cos(q["l"])))))
        return _with(ground, lambda q: _point((q["v"] + sums(alpha, q, True)) * radius + x0, (q["u"] + sums(alpha, q, False)) * radius + y0, p["z"]))
    given = pair((p["y"] - y0) / radius, (p["x"] - x0) / radius)
    sphere = _with(given, lambda q: pair(q["u"] - sums(beta, q, False), q["v"] - sums(beta, q, True)))
    chi = lambda q: F.asin(F.sin(q["u"]) / F.cosh(q["v"]))
    latitude = lambda c: c + sum((F.sin(c * (2 * k)) * v for k, v in enumerate(delta, 1)), F.lit(0.0))
    return _with(sphere, lambda q: _point(F.atan2(F.sinh(q["v"]), F.cos(q["u"])) + lon0, _with(chi(q), latitude), p["z"]))


def _cart(step: Step, p: Column, inverse: bool) -> Column:
    a, f = _ellipsoid(step)
    e2, b = f * (2 - f), a * (1 - f)
    if not inverse:
        n = F.lit(a) / F.sqrt(F.lit(1.0) - F.sin(p["y"]) * F.sin(p["y"]) * e2)
        return _with(n, lambda n: _point((n + p["z"]) * F.cos(p["y"]) * F.cos(p["x"]), (n + p["z"]) * F.cos(p["y"]) * F.sin(p["x"]), (n * (1 - e2) + p["z"]) * F.sin(p["y"])))
    # Bowring's formula (1976), once more from its own result
    from_axis = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
    second = e2 / (1 - e2)

    def latitude(r: Column, theta: Column) -> Column:
        return F.atan2(p["z"] + F.pow(F.sin(theta), F.lit(3)) * (second * b), r - F.pow(F.cos(theta), F.lit(3)) * (e2 * a))

    def located(r: Column) -> Column:
        first = _with(F.atan2(p["z"] * a, r * b), lambda t: latitude(r, t))
        again = _with(first, lambda phi: latitude(r, F.atan2(F.sin(phi) * (1 - f), F.cos(phi))))
        return _with(again, lambda phi: _point(F.atan2(p["y"], p["x"]), phi, r * F.cos(phi) + p["z"] * F.sin(phi) - F.lit(a) * F.sqrt(F.lit(1.0) - F.sin(phi) * F.sin(phi) * e2)))

    return _with(from_axis, located)


def _helmert(step: Step, p: Column, inverse: bool, epoch: Column | None) -> Column:
    if any(k in ("theta", "towgs84") for k, _ in step.params):
        raise ValueError("this kind of helmert step is not supported")
    turns = step.get("convention")
    rotated = any(step.number(k) for k in ("rx", "ry", "rz", "drx", "dry", "drz"))
    if rotated and turns not in ("position_vector", "coordinate_frame"):
        raise ValueError("a helmert step with rotations names its convention")
    sign = -ARCSECOND if turns == "coordinate_frame" else ARCSECOND
    scale = {"x": 1.0, "y": 1.0, "z": 1.0, "rx": sign, "ry": sign, "rz": sign, "s": 1e-6}
    names = {"x": "tx", "y": "ty", "z": "tz", "rx": "rx", "ry": "ry", "rz": "rz", "s": "s"}
    fixed = {names[k]: step.number(k) * v for k, v in scale.items()}
    rates = {names[k]: step.number("d" + k) * v for k, v in scale.items()}
    if any(rates.values()):
        if step.get("t_epoch") is None or epoch is None:
            raise ValueError("a helmert step with rates needs its t_epoch and the points' epoch")
        years = epoch - step.number("t_epoch")
    else:
        years = F.lit(0.0)
    if not inverse:
        return _point(*geo.helmert(p["x"], p["y"], p["z"], years, fixed, rates))

    def undone(v: Column) -> Column:
        q = {k: F.lit(fixed[k]) + v["years"] * rates[k] for k in fixed}
        x, y, z = (v["p"][c] - q[t] for c, t in zip("xyz", ("tx", "ty", "tz"), strict=True))
        k = q["s"] + 1
        # turned back by the transposed matrix
        return _with(_point(x, y, z), lambda d: _point((d["x"] + q["rz"] * d["y"] - q["ry"] * d["z"]) / k, (d["y"] - q["rz"] * d["x"] + q["rx"] * d["z"]) / k, (d["z"] + q["ry"] * d["x"] - q["rx"] * d["y"]) / k))

    return _with(F.struct(p.alias("p"), years.alias("years")), undone)


def _unitconvert(step: Step, p: Column, inverse: bool) -> Column:
    def factor(a: str, b: str) -> float:
        units = [step.get(a, step.get(b)), step.get(b, step.get(a))]
        if bad := [u for u in units if u is not None and u not in UNITS]:
            raise ValueError(f"no unit {bad[0]!r}")
        return 1.0 if units[0] is None else UNITS[units[0]] / UNITS[units[1]]

    xy, z = factor("xy_in", "xy_out"), factor("z_in", "z_out")
    if inverse:
        xy, z = 1 / xy, 1 / z
    return _point(p["x"] * xy, p["y"] * xy, p["z"] * z)


def _axisswap(step: Step, p: Column, inverse: bool) -> Column:
    order = [int(v) for v in (step.get("order") or "").split(",")]
    if sorted(abs(v) for v in order) not in ([1, 2], [1, 2, 3]):
        raise ValueError(f"an order of axes that is not supported: {order}")
    order = [*order, 3][:3]
    if inverse:
        order = [math.copysign(k + 1, v) for k, v in sorted(enumerate(order), key=lambda x: abs(x[1]))]
    return _point(*[p["xyz"[int(abs(v)) - 1]] * (1 if v > 0 else -1) for v in order])


def _webmerc(step: Step, p: Column, inverse: bool) -> Column:
    a = _ellipsoid(replace(step, params=(*step.params, ("ellps", step.get("ellps") or "WGS84"))))[0]
    if inverse:
        return _point(p["x"] / a, F.atan(F.sinh(p["y"] / a)), p["z"])
    return _point(p["x"] * a, F.asinh(F.tan(p["y"])) * a, p["z"])


def apply(operation: str | Sequence[Step], x: Column, y: Column, z: Column | None = None, undulation: Callable[[str, Column, Column], Column] | Column | None = None, epoch: Column | None = None) -> Column:
    """struct of x, y and z after an operation. Each step is computed once per row, in the JVM.

    ``undulation``: the geoid's height above the ellipsoid at the points that a vgridshift step gets, as a Column (looked up before, see
    ``gtx.with_undulation``) or as a function of the grids' names, longitude and latitude (radians). Where it is null, so is z.
    ``epoch``: of the points, in years; a set step has precedence.
    """
    steps = parse(operation) if isinstance(operation, str) else list(operation)
    kinds = {"utm": _tmerc, "tmerc": _tmerc, "cart": _cart, "unitconvert": _unitconvert, "axisswap": _axisswap, "webmerc": _webmerc}
    if unknown := [s.name for s in steps if s.name not in (*kinds, "helmert", "vgridshift", "set", "noop", "longlat", "latlong")]:
        raise ValueError(f"steps that are not supported: {unknown}")
    if undulation is None and any(s.name == "vgridshift" for s in steps):
        raise ValueError("a vgridshift step needs the undulation")

    def run(p: Column, left: list[Step], epoch: Column | None) -> Column:
        if not left:
            return p
        step, rest = left[0], left[1:]
        if step.name == "set":
            return run(p, rest, F.lit(step.number("v_4")) if step.get("v_4") else epoch)
        if step.name in ("noop", "longlat", "latlong"):
            return run(p, rest, epoch)
        if step.name == "helmert":
            made = _helmert(step, p, step.inverse, epoch)
        elif step.name == "vgridshift":
            shift = undulation if isinstance(undulation, Column) else undulation(step.get("grids") or "", p["x"], p["y"])  # type: ignore[misc]
            # forward takes ellipsoidal heights to the geoid's, unless the step says otherwise
            sign = step.number("multiplier", -1.0) * (-1 if step.inverse else 1)
            made = _point(p["x"], p["y"], p["z"] + shift * sign)
        else:
            made = kinds[step.name](step, p, step.inverse)
        return _with(made, lambda q: run(q, rest, epoch))

    return _with(_point(x.cast("double"), y.cast("double"), (F.lit(0.0) if z is None else z).cast("double")), lambda p: run(p, steps, epoch))
