"""Conformance of a survey catalog: which attributes the rest can't work with, how many surveys each concerns, and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import UNDECLARED, geoid_key

EXAMPLES = 8
#: From the most severe on.
SEVERITIES = ("blocker", "unsupported", "degraded", "info")
# Names that the catalog uses.
LIDAR_METHODS = ("linear-mode lidar", "geiger-mode lidar", "single photon lidar", "flash lidar", "topobathymetric lidar", "bathymetric lidar")
OTHER_METHODS = ("ifsar",)
GEOIDS = ("GEOID18", "GEOID12B", "GEOID09", "GEOID06", "GEOID03", "GEOID99")
#: Attributes that must be there, and how bad it is if one is not.
NEEDED = {"lpc_link": "degraded", "metadata_link": "degraded", "collect_start": "degraded", "collect_end": "degraded", "ql": "info"}
# End of fixed values.


def crs_class(surveys: DataFrame, registry: DataFrame, crs: str = "horiz_crs") -> DataFrame:
    """``surveys`` with crs_class, by ``registry`` (code, class): supported, esri (a code of another authority) or other_datum; null if it has no such code."""
    own = registry.select(F.col("code").alias("sg_code"), F.col("class").alias("crs_class")).dropDuplicates(["sg_code"])
    return surveys.join(own, F.coalesce(F.col(crs), F.lit("")) == F.col("sg_code"), "left").drop("sg_code")


def audit(surveys: DataFrame, registry: DataFrame, name: str = "workunit") -> DataFrame:
    """check, severity, count, total, fraction, examples (up to 8), place: a row per kind of fault that occurs, the most severe first.

    Examples of a value's faults are the most frequent values, of missing attributes the first names. Attributes that the
    catalog does not have are not checked. An empty catalog has no findings.
    """
    there = {c.lower() for c in surveys.columns}
    marked, faults = surveys, []

    def fault(check: str, severity: str, bad: Column, example: Column) -> None:
        faults.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), example.cast("string").alias("example"))))

    if "horiz_crs" in there:
        marked = crs_class(surveys, registry)
        value, known = F.coalesce("horiz_crs", F.lit("")), F.col("crs_class")
        fault("horiz_crs.esri_authority_code", "blocker", known == "esri", value)
        fault("horiz_crs.non_nad83_datum", "unsupported", known == "other_datum", value)
        fault("horiz_crs.unparseable", "blocker", known.isNull(), value)
    if "geoid" in there:
        key, value = geoid_key(F.col("geoid")), F.coalesce(F.nullif(F.col("geoid"), F.lit("")), F.lit("(null)"))
        fault("geoid.undeclared", "degraded", key.isin(*UNDECLARED), value)
        fault("geoid.unrecognized_model", "blocker", ~key.isin(*UNDECLARED, *GEOIDS, "GEOID12A"), F.col("geoid"))
    if "p_method" in there:
        method = F.lower(F.trim(F.coalesce("p_method", F.lit(""))))
        fault("p_method.not_lidar", "unsupported", method.isin(*OTHER_METHODS), F.col("p_method"))
        fault("p_method.unrecognized", "info", (method != "") & ~method.isin(*LIDAR_METHODS, *OTHER_METHODS), F.col("p_method"))
    for c, severity in NEEDED.items():
        if c in there:
            fault(f"metadata.missing_{c}", severity, F.col(c).isNull(), F.col(name))
    if not faults:
        raise ValueError("the catalog has none of the attributes that are checked")
    total = surveys.count()
    each = marked.select(F.explode(F.filter(F.array(*faults), lambda f: f.isNotNull())).alias("f")).select("f.*")
    values = each.groupBy("check", "severity", "example").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("check").orderBy(F.col("n").desc(), "example")
    first = values.where("example IS NOT NULL").withColumn("k", F.row_number().over(order)).where(F.col("k") <= EXAMPLES)
    examples = first.groupBy("check").agg(F.sort_array(F.collect_list(F.struct("k", "example"))).alias("e")).select("check", F.transform("e", lambda x: x["example"]).alias("examples"))
    found = values.groupBy("check", "severity").agg(F.sum("n").alias("count")).join(examples, "check", "left")
    found = found.withColumns({"total": F.lit(total).cast("bigint"), "fraction": F.round(F.col("count") / total, 4)})
    # one row per check: a constant number of rows in one task
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(rank, F.col("count").desc(), "check")))
