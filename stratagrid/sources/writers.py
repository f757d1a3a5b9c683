"""Sinks: rasters by product, records as JSON lines, inventories as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_products(grids: DataFrame, path: str, products: Sequence[str], keys: Sequence[str] = ("row", "col")) -> None:
    """A wide table of grids as one long raster, partitioned by product; cells without data are left out."""
    pairs = F.array(*[F.struct(F.lit(p).alias("product"), F.col(p).cast("double").alias("value")) for p in products])
    long = grids.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").where("value IS NOT NULL")
    long.write.mode("overwrite").partitionBy("product").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object per row, its fields in the columns' order, nulls included."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_inventory(files: DataFrame, path: str) -> None:
    """Size, right-aligned to twelve places, and key of each file."""
    files.select(F.concat(F.lpad(F.col("size").cast("string"), 12, " "), F.lit(" "), F.col("key")).alias("value")).write.mode("overwrite").text(path)


def write_points(points: DataFrame, path: str, by: Sequence[str] = ("tile",), decimals: int | None = None) -> None:
    """Points partitioned by tile, so that later reads prune; with ``decimals``, coordinates as a file of that precision holds them."""
    if decimals is not None:
        points = points.withColumns({c: F.round(c, decimals) for c in ("x", "y", "z")})
    points.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_surveys(surveys: DataFrame, gaps: DataFrame, path: str) -> None:
    """Survey records as JSON lines and their gaps as a table, under ``path``; lists of names become one text, so that any reader takes them."""
    lists = [c for c, kind in surveys.dtypes if kind == "array<string>"]
    flat = surveys.withColumns({c: F.array_join(c, ",") for c in lists}) if lists else surveys
    write_records(flat.drop("parts"), f"{path}/surveys")
    gaps.write.mode("overwrite").parquet(f"{path}/coverage_gaps")


def buffered_area(areas: DataFrame, metres: float = 250.0) -> DataFrame:
    """``areas`` (xmin, ymin, xmax, ymax in metres) widened on all sides, as they are asked for."""
    return areas.withColumns({"xmin": F.col("xmin") - metres, "ymin": F.col("ymin") - metres, "xmax": F.col("xmax") + metres, "ymax": F.col("ymax") + metres})
