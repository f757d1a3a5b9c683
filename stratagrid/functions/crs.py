"""Coordinate reference systems as well-known text: read into a tree, written again, built, and asked for what they rest on.

A definition is a short text, one for each system that a catalog declares; columns of them are parsed where they lie
(``bases``), and joined by code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z_][A-Za-z0-9_]*)|([-+]?[0-9.][0-9.eE+-]*)|([\[\](),]))')
# Keywords of WKT2 and WKT1 for geographic systems and datums; names and codes of the realizations of NAD83 on the North
# American plate; semi-major axes and inverse flattenings; parameters of UTM and of the spherical Mercator projection.
GEODETIC = ("GEOGCRS", "GEODCRS", "BASEGEOGCRS", "BASEGEODCRS", "GEOGCS", "GEOGRAPHICCRS", "GEODETICCRS")
NAD83 = {"NAD83": 4269, "NAD83(HARN)": 4152, "NAD83(NSRS2007)": 4759, "NAD83(2011)": 6318, "NAD83(CORS96)": 6783}
ELLIPSOIDS = {"WGS 84": ("6378137", "298.257223563"), "GRS 1980": ("6378137", "298.257222101")}
REALIZATIONS = {
    "WGS 84 (G2139)": ("World Geodetic System 1984 (G2139)", "WGS 84", 9755, True), "WGS 84 (G1674)": ("World Geodetic System 1984 (G1674)", "WGS 84", 9056, True),
    "ITRF2008": ("International Terrestrial Reference Frame 2008", "GRS 1980", 8999, True), "ITRF2014": ("International Terrestrial Reference Frame 2014", "GRS 1980", 9000, True),
    "ITRF2020": ("International Terrestrial Reference Frame 2020", "GRS 1980", 9990, True), "NAD83(2011)": ("NAD83 (National Spatial Reference System 2011)", "GRS 1980", 6318, False),
    "NAD83(HARN)": ("NAD83 (High Accuracy Reference Network)", "GRS 1980", 4152, False), "NAD83(NSRS2007)": ("NAD83 (National Spatial Reference System 2007)", "GRS 1980", 4759, False),
    "NAD83(CORS96)": ("NAD83 (Continuously Operating Reference Station 1996)", "GRS 1980", 6783, False), "NAD83": ("North American Datum 1983", "GRS 1980", 4269, False),
}
# End of fixed values.


class Node:
    """A keyword with its items: texts, numbers (as written), keywords without items (texts too), and nodes."""

    def __init__(self, key: str, items: list):
        self.key, self.items = key.upper(), items

    def nodes(self, *keys: str) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node) and (not keys or x.key in keys)]

    def walk(self) -> Iterator[Node]:
        yield self
        for x in self.nodes():
            yield from x.walk()

    @property
    def name(self) -> str:
        return next((x.text for x in self.items if isinstance(x, Quoted)), "")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and (self.key, self.items) == (other.key, other.items)

    __hash__ = None  # type: ignore[assignment]


class Quoted:
    def __init__(self, text: str):
        self.text = text

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Quoted) and self.text == other.text

    __hash__ = None  # type: ignore[assignment]


def parse(text: str) -> Node:
    """The tree of a definition; an error where it is no whole definition."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not well-known text at {text[at:at + 20]!r}")
        tokens.append(m.group(0).strip())
        at = m.end()
    place = 0

    def item():
        nonlocal place
        token = tokens[place] if place < len(tokens) else ""
        place += 1
        if token[:1] == '"':
            return Quoted(token[1:-1].replace('""', '"'))
        if token in ("", "[", "]", "(", ")", ","):
            raise ValueError("the definition is not whole")
        if place >= len(tokens) or tokens[place] not in "[(":
            return token
        end, items = "])"["[(".index(tokens[place])], []
        while tokens[place] != end:
            place += 1
            items.append(item())
            if place >= len(tokens) or tokens[place] not in (",", end):
                raise ValueError("the definition is not whole")
        place += 1
        return Node(token, items)

    root = item()
    if not isinstance(root, Node) or place != len(tokens):
        raise ValueError("the definition is not whole")
    return root


def write(node: Node | Quoted | str) -> str:
    if isinstance(node, Quoted):
        return '"' + node.text.replace('"', '""') + '"'
    return node if isinstance(node, str) else f"{node.key}[{','.join(write(x) for x in node.items)}]"


def code_of(node: Node) -> int | None:
    """The number in a node's own identifier."""
    for x in node.nodes("ID", "AUTHORITY"):
        own = x.items[1] if len(x.items) > 1 else None
        number = own.text if isinstance(own, Quoted) else own
        if isinstance(number, str) and number.isdigit():
            return int(number)
    return None


def geodetic(root: Node) -> Node | None:
    """The geographic system that a definition rests on: itself, or the first below; of a compound one its horizontal part's."""
    return next((x for x in root.walk() if x.key in GEODETIC), None)


def nad83_base(text: str | None) -> int | None:
    """The code of the realization of NAD83 on the North American plate that a definition rests on, by code or by name; None for all others."""
    try:
        base = geodetic(parse(text or ""))
    except ValueError:
        return None
    if base is None:
        return None
    code = code_of(base)
    return code if code in NAD83.values() else NAD83.get(base.name)


def is_dynamic(text: str) -> bool:
    """Whether coordinates need an epoch: the definition has a dynamic frame, or a frame that is known to be one."""
    root = parse(text)
    known = {name for name, (datum, _, _, moves) in REALIZATIONS.items() if moves for name in (name, datum)}
    return any(x.key == "DYNAMIC" or x.key in ("DATUM", "TRF", *GEODETIC) and x.name in known for x in root.walk())


def _geographic(realization: str, key: str, three_d: bool) -> Node:
    if realization not in REALIZATIONS:
        raise ValueError(f"no realization {realization!r}; there are {', '.join(REALIZATIONS)}")
    datum, ellipsoid, code, moves = REALIZATIONS[realization]
    axis, flattening = ELLIPSOIDS[ellipsoid]
    frame = Node("DATUM", [Quoted(datum), Node("ELLIPSOID", [Quoted(ellipsoid), axis, flattening, _metre()])])
    items = [Quoted(realization), *([Node("DYNAMIC", [Node("FRAMEEPOCH", ["2010"])])] if moves else []), frame, Node("PRIMEM", [Quoted("Greenwich"), "0", _degree()])]
    if not key.startswith("BASE"):
        axes = [Node("AXIS", [Quoted("latitude"), "north", _degree()]), Node("AXIS", [Quoted("longitude"), "east", _degree()])] + ([_height()] if three_d else [])
        items += [Node("CS", ["ellipsoidal", str(len(axes))]), *axes]
    return Node(key, [*items, Node("ID", [Quoted("EPSG"), str(code)])])


def _metre() -> Node:
    return Node("LENGTHUNIT", [Quoted("metre"), "1"])


def _degree() -> Node:
    return Node("ANGLEUNIT", [Quoted("degree"), "0.0174532925199433"])


def _height() -> Node:
    return Node("AXIS", [Quoted("ellipsoidal height (h)"), "up", _metre()])


def _projected(name: str, realization: str, conversion: str, method: str, parameters: list[tuple[str, str, Node]], three_d: bool) -> Node:
    axes = [Node("AXIS", [Quoted("easting"), "east", _metre()]), Node("AXIS", [Quoted("northing"), "north", _metre()])] + ([_height()] if three_d else [])
    steps = [Node("PARAMETER", [Quoted(p), value, unit]) for p, value, unit in parameters]
    return Node("PROJCRS", [Quoted(name), _geographic(realization, "BASEGEOGCRS", three_d), Node("CONVERSION", [Quoted(conversion), Node("METHOD", [Quoted(method)]), *steps]), Node("CS", ["Cartesian", str(len(axes))]), *axes])


def zone_label(code: int) -> str:
    """``10N`` of 32610; an error for codes that are no zone of UTM on WGS 84."""
    if code // 100 not in (326, 327) or not 1 <= code % 100 <= 60:
        raise ValueError(f"{code} is no UTM zone on WGS 84 (32601-32660, 32701-32760)")
    return f"{code % 100}{'N' if code // 100 == 326 else 'S'}"


def utm(code: int, realization: str = "WGS 84 (G2139)", three_d: bool = True) -> str:
    """The definition of the zone of UTM that ``code`` (326xx, 327xx) names, on a realization."""
    label = zone_label(code)
    unity = Node("SCALEUNIT", [Quoted("unity"), "1"])
    parameters = [
        ("Latitude of natural origin", "0", _degree()), ("Longitude of natural origin", str(6 * int(label[:-1]) - 183), _degree()), ("Scale factor at natural origin", "0.9996", unity),
        ("False easting", "500000", _metre()), ("False northing", "0" if label[-1] == "N" else "10000000", _metre()),
    ]
    return write(_projected(f"{realization} / UTM zone {label}", realization, f"UTM zone {label}", "Transverse Mercator", parameters, three_d))


def pseudo_mercator(realization: str = "NAD83(2011)", three_d: bool = True) -> str:
    """The spherical Mercator projection of coordinates on a realization: what tiles named EPSG:3857 really hold."""
    parameters = [("Latitude of natural origin", "0", _degree()), ("Longitude of natural origin", "0", _degree()), ("False easting", "0", _metre()), ("False northing", "0", _metre())]
    return write(_projected(f"Pseudo-Mercator ({realization} based)", realization, "Pseudo-Mercator", "Popular Visualisation Pseudo Mercator", parameters, three_d))


def with_navd88(horizontal: str) -> str:
    """A compound system of a horizontal one and heights above NAVD88."""
    root = parse(horizontal)
    if any(x.key == "AXIS" and "up" in x.items for x in root.walk()):
        raise ValueError("the horizontal system has a height of its own")
    vertical = Node("VERTCRS", [Quoted("NAVD88 height"), Node("VDATUM", [Quoted("North American Vertical Datum 1988")]), Node("CS", ["vertical", "1"]), Node("AXIS", [Quoted("gravity-related height"), "up", _metre()]), Node("ID", [Quoted("EPSG"), "5703"])])
    return write(Node("COMPOUNDCRS", [Quoted(f"{root.name} + NAVD88 height"), root, vertical]))


def bases(registry: DataFrame, code: str = "code", wkt: str = "wkt") -> DataFrame:
    """(code, base) of a registry of definitions: the NAD83 realization that each rests on, null where it rests on none. Of codes that
    are there twice the one with the smallest definition counts."""
    own = F.pandas_udf(lambda s: s.map(nad83_base).astype("Int64"), "long")
    return registry.groupBy(F.col(code).cast("long").alias("code")).agg(F.min(wkt).alias("wkt")).select("code", own("wkt").alias("base"))


def read_file(spark: SparkSession, path: str) -> str:
    """The definition in a file; an error if it is none."""
    text = spark.read.text(path, wholetext=True).first()[0]
    parse(text)
    return text.strip()


def write_file(spark: SparkSession, text: str, path: str) -> None:
    """The definition as the one text in the folder ``path``; one that is not whole is refused."""
    spark.createDataFrame([(write(parse(text)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def same(a: Column, b: Column) -> Column:
    """Whether two columns hold the same definitions, however they are laid out."""
    form = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else write(parse(t))), "string")
    return form(a) == form(b)
