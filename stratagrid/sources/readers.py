"""Tables that the operators read: catalogs, footprints, listings, report files and land-cover or elevation rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A survey record: every attribute may be null or absent.
SURVEY = "workunit string, workunit_id bigint, project string, collect_start timestamp_ntz, collect_end timestamp_ntz, ql string, spec string, p_method string, horiz_crs string, vert_crs string, geoid string, lpc_pub_date string, lpc_category string, lpc_reason string, lpc_link string, metadata_link string"
#: A point record.
POINT = "x double, y double, z double, cls short, rn short, nr short, intensity int, gps_time double, source_id int"


def with_schema(df: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    """``df`` with all columns of ``schema`` (absent ones null), and the names of those that were there."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    there = {c.lower(): c for c in df.columns}
    out = df.select(*[(F.col(there[f.name.lower()]) if f.name.lower() in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
    return out, [f.name for f in wanted if f.name.lower() in there]


def in_box(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows whose box columns touch the box: four inequalities, which reach the scan and skip row groups."""
    return df.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def csv_catalog(spark: SparkSession, path: str) -> DataFrame:
    """An attribute table with a header; all strings, as audits want them."""
    return spark.read.csv(path, header=True, inferSchema=False)


def geojson(spark: SparkSession, path: str, properties: Sequence[str] = ()) -> DataFrame:
    """One row per feature of a polygon collection: properties, ring (array of struct x, y, the outer ring of the first part),
    parts (all parts, each an array of rings: the outer one, then its holes) and the box over all parts."""
    props = ", ".join(f"`{p}`: string" for p in properties)
    feature = f"struct<properties: struct<{props}>, geometry: struct<type: string, coordinates: string>>" if props else "struct<geometry: struct<type: string, coordinates: string>>"
    rows = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    multi = F.col("f.geometry.type") == "MultiPolygon"
    single = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    given = F.when(multi, F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")).when(single.isNotNull(), F.array(single))
    parts = F.transform(given, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    out = rows.select(*[F.col(f"f.properties.{p}").alias(p) for p in properties], parts.alias("parts"))
    # holes lie within their outer rings, so the outer rings bound everything
    outer = F.flatten(F.transform(F.filter("parts", lambda rings: F.size(rings) > 0), lambda rings: rings[0]))
    return out.select(*properties, F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("ring"), "parts", *box_of(outer))


def box_of(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")]


def link_list(spark: SparkSession, path: str) -> DataFrame:
    """A file of links: one per line, trimmed, without empty lines."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder`` with key (path behind it) and size. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.select(F.regexp_replace("path", r"^.*?" + folder.rstrip("/").split("://")[-1].replace(".", r"\.") + "/", "").alias("key"), F.col("length").alias("size"))


def bucket_listing(pages: DataFrame, column: str = "xml") -> DataFrame:
    """Keys and sizes of object-store listing pages (XML)."""
    parsed = F.from_xml(column, "Contents array<struct<Key: string, Size: bigint>>")
    return pages.select(F.explode(parsed["Contents"]).alias("c")).select(F.col("c.Key").alias("key"), F.col("c.Size").alias("size"))


def report_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with their paths; XML files whose names promise classified points come first."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    rank = F.when(F.contains(F.col("path"), F.lit("ClassifiedPointCloud")), 0).when(F.contains(F.col("path"), F.lit("Classified")), 1).otherwise(2)
    return files.withColumn("rank", rank)


def rasters(spark: SparkSession, path: str, nodata: float | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A long raster table (source, row, col, value), as land cover (nodata 0) or a reference elevation model (nodata -32767) is kept;
    of it the cells in ``box`` (first row, first col, last row, last col), which the scan skips row groups by. Bring it onto another grid with ``warp``."""
    out = spark.read.parquet(path)
    if box is not None:
        out = out.where(F.col("row").between(box[0], box[2]) & F.col("col").between(box[1], box[3]))
    value = F.col("value").cast("double")
    fine = ~F.isnan(value) if nodata is None else ~F.isnan(value) & (value != nodata)
    return out.withColumn("value", F.when(fine, value))


def newest(df: DataFrame, by: Sequence[str], value: str, time: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, time).alias(value))
