"""Reference systems as text, realizations of NAD83, declared geoids."""

import pytest
from pyspark.sql import functions as F

from stratagrid.functions import crs, geo, geodesy


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_wkt_round_trip():
    text = 'PROJCS["a ""quoted"" name",GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],AUTHORITY["EPSG","4269"]],PARAMETER["scale",9.996e-1],AXIS["E",EAST]]'
    root = crs.parse(text)
    assert crs.write(root) == text and crs.parse(crs.write(root)) == root
    assert crs.parse(text.replace(",", " ,\n  ").replace("[", "(").replace("]", " )")) == root
    assert root.name == 'a "quoted" name' and crs.code_of(crs.geodetic(root)) == 4269
    for bad in ("", "GEOGCS", 'GEOGCS["a"', 'GEOGCS["a"]]', 'GEOGCS["a",]', 'GEOGCS["a" "b"]', '"a"', "GEOGCS[;]", 'GEOGCS["a")'):
        with pytest.raises(ValueError):
            crs.parse(bad)


def test_built_systems():
    south, north = crs.utm(32733), crs.utm(32611, "NAD83(2011)")
    assert '"WGS 84 (G2139) / UTM zone 33S"' in south and '"False northing",10000000' in south and '"Longitude of natural origin",15,' in south and 'CS[Cartesian,3]' in south
    assert '"NAD83(2011) / UTM zone 11N"' in north and '"False northing",0' in north and crs.nad83_base(north) == 6318 and crs.nad83_base(south) is None
    assert crs.is_dynamic(south) and not crs.is_dynamic(north) and crs.is_dynamic(crs.utm(32610, "ITRF2020"))
    harn = crs.pseudo_mercator("NAD83(HARN)", three_d=False)
    assert crs.nad83_base(harn) == 4152 and "HARN" in crs.parse(harn).name
    both = crs.parse(crs.with_navd88(harn))
    assert both.key == "COMPOUNDCRS" and crs.nad83_base(crs.write(both)) == 4152 and both.nodes()[1].name == "NAVD88 height"
    assert crs.zone_label(32610) == "10N" and crs.zone_label(32719) == "19S"
    for bad in (26910, 32600, 32661):
        with pytest.raises(ValueError, match="UTM zone"):
            crs.utm(bad)
    with pytest.raises(ValueError, match="realization"):
        crs.utm(32610, "WGS 72")
    with pytest.raises(ValueError, match="height of its own"):
        crs.with_navd88(crs.pseudo_mercator())


def test_files(spark, tmp_path):
    crs.write_file(spark, crs.utm(32611), f"{tmp_path}/utm.wkt")
    assert crs.parse(crs.read_file(spark, f"{tmp_path}/utm.wkt")) == crs.parse(crs.utm(32611))
    with pytest.raises(ValueError):
        crs.write_file(spark, "GEOGCS[", f"{tmp_path}/bad.wkt")
    assert one(spark, crs.same(F.lit(crs.utm(32611)), F.lit(crs.utm(32611).replace(",", ", "))), crs.same(F.lit(crs.utm(32611)), F.lit(crs.utm(32612)))) == (True, False)


def test_geographic_base(spark):
    base = lambda code, **k: one(spark, geodesy.geographic_base(F.lit(code), **k))[0]
    assert [base(c) for c in (26910, 3740, 6339, 3717, 4759, 6783, 6318)] == ["4269", "4152", "6318", "4759", "4759", "6783", "6318"]
    assert [base(c) for c in (32610, 6322, 4326, 7131)] == ["error"] * 4
    plane = 'PROJCRS["plane",BASEGEOGCRS["NAD83({0})",DATUM["x",ELLIPSOID["GRS 1980",6378137,298.257222101]]{1}],CONVERSION["c",METHOD["m"]]]'
    registry = spark.createDataFrame([(7131, plane.format("2011", ',ID["EPSG",6318]')), (6521, plane.format("2011", "")), (6322, plane.format("PA11", "")), (1, "no definition"), (2, None)], "code long, wkt string")
    found = crs.bases(registry).select("code", geodesy.geographic_base(F.col("code"), F.col("base")).alias("base")).collect()
    assert {r["code"]: r["base"] for r in found} == {7131: "6318", 6521: "6318", 6322: "error", 1: "error", 2: "error"}


def test_declared_geoids(spark):
    conus, prvi, alaska = ("conus", (-115.2, 36.1)), ("prvi", (-66.5, 18.2)), ("ak", (-149.5, 60.5))

    def get(declared, place):
        region = geo.first_region(F.lit(place[1][0]), F.lit(place[1][1]), geodesy.REGIONS)
        got = one(spark, region, geodesy.declared_geoid(F.lit(declared).cast("string"), region))
        assert got[0] == place[0]
        return got[1]

    for declared, grids in (("GEOID18", ["us_noaa_g2018u0.tif"]), ("GEOID12B", ["us_noaa_g2012bu0.tif"]), ("GEOID09", ["us_noaa_geoid09_conus.tif"]), ("GEOID03", ["us_noaa_geoid03_conus.tif"]), ("Geoid18", ["us_noaa_g2018u0.tif"]), ("12B", ["us_noaa_g2012bu0.tif"])):
        got = get(declared, conus)
        assert got["grids"] == grids and got["error"] is None and got["substituted_for"] is None
    assert len(get("GEOID99", conus)["grids"]) == 8 and get("GEOID09", alaska)["grids"] == ["us_noaa_geoid09_ak.tif"]
    for declared in (None, "Unknown", "N/A", "", " "):
        assert get(declared, conus) is None
    same = get("GEOID12A", conus)
    assert (same["model"], same["substituted_for"], same["grids"]) == ("GEOID12B", "GEOID12A", ["us_noaa_g2012bu0.tif"])
    assert get("GEOID12B", prvi)["grids"] == ["us_noaa_g2012bp0.tif"]
    for declared, place, what in (("GEOID12A", prvi, "Puerto Rico"), ("12A", prvi, "Puerto Rico"), ("GEOID12", conus, "GEOID12 was"), ("GEOID03", alaska, "no grid for"), ("GEOID29", conus, "no known grids"), ("09", conus, "no known grids")):
        got = get(declared, place)
        assert what in got["error"] and got["model"] is got["grids"] is got["substituted_for"] is None
    outside = one(spark, geodesy.declared_geoid(F.lit("GEOID18"), F.lit(None).cast("string")))[0]
    assert "outside every region" in outside["error"]
    assert one(spark, geodesy.grid_hint(F.lit("geoid 09")), geodesy.grid_hint(F.lit("Unknown")), geodesy.grid_hint(F.lit(None).cast("string"))) == ("geoid09", None, None)
