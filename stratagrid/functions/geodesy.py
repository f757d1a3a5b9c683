"""Transformation records as Column expressions: grids, areas of use, epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .crs import NAD83

#: Epoch of the fixed-plate realization (decimal year).
FIXED_EPOCH = 2010.0
# Zones of UTM on realizations of NAD83 on the North American plate (first code, last code, geographic base).
NAD83_UTM = ((26901, 26923, 4269), (3740, 3751, 4152), (3706, 3726, 4759), (6328, 6348, 6318))
# End of fixed values.


def geographic_base(code: Column, registered: Column | None = None) -> Column:
    """The geographic system below a declared one (both as codes), which must be a realization of NAD83 on the North American plate:
    ``error`` for all others, such as WGS 84 and the Pacific plate's. Null stays null.

    Geographic systems and zones of UTM are known. State planes and all other systems take ``registered``, what their
    definition says (see ``crs.bases``); without it they are an error.
    """
    out = F.coalesce(registered.cast("string"), F.lit("error")) if registered is not None else F.lit("error")
    for low, high, base in NAD83_UTM:
        out = F.when(code.between(low, high), str(base)).otherwise(out)
    out = F.when(code.isin(*NAD83.values()), code.cast("string")).otherwise(out)
    return F.when(code.isNull(), F.lit(None)).otherwise(out)


def swap_vertical_grids(pipeline: Column, grids: Column, fail: bool = True) -> Column:
    """``pipeline`` with the grids of its vertical shift replaced. It must have exactly one such step, and it must change."""
    pattern = r"(\+proj=vgridshift\s+\+grids=)([^\s]+)"
    out = F.regexp_replace(pipeline, F.lit(pattern), F.concat(F.lit("$1"), grids))
    good = (F.regexp_count(pipeline, F.lit(pattern)) == 1) & (out != pipeline)
    return F.when(good, out).otherwise(F.raise_error(F.lit("no single vertical grid to replace")) if fail else F.lit(None))


def lon_in(lon: Column, west: Column, east: Column) -> Column:
    """Whether a longitude is in an interval, which may cross the antimeridian."""
    return F.when(west <= east, lon.between(west, east)).otherwise((lon >= west) | (lon <= east))


def decimal_year(date: Column) -> Column:
    """The year and the share of it that is over."""
    start = F.make_date(F.year(date), F.lit(1), F.lit(1))
    days = F.datediff(F.make_date(F.year(date) + 1, F.lit(1), F.lit(1)), start)
    return F.year(date) + F.datediff(date, start) / days


def geoid_shift(height: Column, undulation: Column, to_ellipsoid: bool = True) -> Column:
    """Ellipsoidal of orthometric heights, or back."""
    return height + undulation if to_ellipsoid else height - undulation


def nice_length(span: Column) -> Column:
    """The length of 1, 2, 5 or 10 times a power of ten nearest to a fifth of ``span`` (borders at 1.5, 3.5 and 7.5)."""
    target = span / 5
    power = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    lead = target / power
    return power * F.when(lead < 1.5, 1.0).when(lead < 3.5, 2.0).when(lead < 7.5, 5.0).otherwise(10.0)


# Public grid files by geoid model and region, and the regions' boxes (west, south, east, north), the first that holds a point.
GEOID_GRIDS = {
    "GEOID18": {"conus": ["us_noaa_g2018u0.tif"], "prvi": ["us_noaa_g2018p0.tif"]},
    "GEOID12B": {
        "conus": ["us_noaa_g2012bu0.tif"], "ak": ["us_noaa_g2012ba0.tif"], "prvi": ["us_noaa_g2012bp0.tif"], "hi": ["us_noaa_g2012bh0.tif"],
        "guam": ["us_noaa_g2012bg0.tif"], "samoa": ["us_noaa_g2012bs0.tif"],
    },
    "GEOID09": {"conus": ["us_noaa_geoid09_conus.tif"], "ak": ["us_noaa_geoid09_ak.tif"]},
    "GEOID06": {"ak": ["us_noaa_geoid06_ak.tif"]},
    "GEOID03": {"conus": ["us_noaa_geoid03_conus.tif"]},
    "GEOID99": {
        "conus": [f"us_noaa_g1999u0{k}.tif" for k in range(1, 9)], "ak": [f"us_noaa_g1999a0{k}.tif" for k in range(1, 5)], "hi": ["us_noaa_g1999h01.tif"],
        "prvi": ["us_noaa_g1999p01.tif"],
    },
}
REGIONS = (
    ("prvi", -68.5, 17.0, -64.0, 19.5), ("hi", -161.5, 18.0, -154.0, 23.5), ("guam", 144.0, 13.0, 146.5, 16.0), ("samoa", -171.5, -15.0, -169.0, -13.5),
    ("ak", -190.0, 49.5, -129.0, 72.5), ("conus", -130.0, 23.0, -66.0, 50.0),
)
UNDECLARED = ("", "UNKNOWN", "N/A", "NA", "NONE")
SHORT_GEOIDS = {"12A": "GEOID12A", "12B": "GEOID12B"}
GRID_HINTS = {
    "GEOID18": "g2018", "GEOID12B": "g2012b", "GEOID12A": "g2012a", "GEOID09": "geoid09", "GEOID06": "geoid06", "GEOID03": "geoid03", "GEOID99": "geoid99",
}
# End of fixed values.


def region_grids(model: Column, region: Column, fail: bool = True) -> Column:
    """The grid files (array) of a geoid model in a region. A model without grids there is an error, or null if not ``fail``; null stays null."""
    pairs = [F.lit(x) for m, regions in GEOID_GRIDS.items() for r, files in regions.items() for x in (f"{m}/{r}", ",".join(files))]
    found = F.split(F.element_at(F.create_map(*pairs), F.concat(model, F.lit("/"), region)), ",")
    missing = F.raise_error(F.concat(F.lit("no grid for "), model, F.lit(" in "), F.coalesce(region, F.lit("no region")))).cast("array<string>") if fail else F.lit(None).cast("array<string>")
    return F.when(model.isNull(), F.lit(None).cast("array<string>")).when(found.isNotNull(), found).otherwise(missing)


def geoid_key(declared: Column) -> Column:
    """A declared geoid's name as it is looked up: no blanks, upper case, short names in full; empty where null."""
    key = F.upper(F.replace(F.coalesce(declared, F.lit("")), F.lit(" ")))
    for short, full in SHORT_GEOIDS.items():
        key = F.when(key == short, full).otherwise(key)
    return key


def grid_hint(declared: Column) -> Column:
    """The part of grid names that tells a declared geoid's; null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in GRID_HINTS.items() for x in pair]), F.upper(F.replace(declared, F.lit(" "))))


def declared_geoid(declared: Column, region: Column) -> Column:
    """struct of model, substituted_for, grids (array) and error, for a survey's declared geoid in a region (see ``geo.first_region``).

    Null where nothing is declared. The declared model is part of the data, so no other takes its place: GEOID12, which was
    replaced, models without grids, and regions that a model has no grids for are errors. GEOID12A is the same as GEOID12B, which
    stands for it, but in Puerto Rico and the Virgin Islands (prvi), where it is an error.
    """
    def resolved(v: Column) -> Column:
        key, region, grids = v["key"], v["region"], v["grids"]
        stands, model = key == "GEOID12A", v["model"]
        error = (
            F.when(region.isNull(), "the place is outside every region of geoid grids")
            .when(key == "GEOID12", "GEOID12 was replaced by GEOID12A and GEOID12B and has no grids")
            .when(stands & (region == "prvi"), "GEOID12A and GEOID12B differ in Puerto Rico and the Virgin Islands")
            .when(~model.isin(*GEOID_GRIDS), F.concat(F.lit("no known grids for "), model))
            .when(grids.isNull(), F.concat(F.lit("no grid for "), model, F.lit(" in "), region))
        )
        return _with(error, lambda e: F.when(~key.isin(*UNDECLARED), F.struct(
            F.when(e.isNull(), model).alias("model"), F.when(e.isNull() & stands, "GEOID12A").alias("substituted_for"), F.when(e.isNull(), grids).alias("grids"), e.alias("error"),
        )))

    named = lambda v: F.struct(v["key"].alias("key"), v["region"].alias("region"), F.when(v["key"] == "GEOID12A", "GEOID12B").otherwise(v["key"]).alias("model"))
    files = lambda v: F.struct(v["key"].alias("key"), v["region"].alias("region"), v["model"].alias("model"), region_grids(v["model"], v["region"], fail=False).alias("grids"))
    return _with(F.struct(geoid_key(declared).alias("key"), region.alias("region")), lambda v: _with(named(v), lambda v: _with(files(v), resolved)))


def _with(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
