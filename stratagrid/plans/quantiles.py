"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by keys in which null is a value like any other."""
    renamed = right.withColumnsRenamed({c: f"sg_on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"sg_on_{c}"))
    return left.join(renamed, same, how).drop(*[f"sg_on_{c}" for c in on]) if on else left.crossJoin(F.broadcast(renamed))


def quantiles(df: DataFrame, by: Sequence[str], value: Column, at: Sequence[float]) -> DataFrame:
    """(by, n, q, least): of each group the number of values, their quantiles at ``at`` (an array; interpolated between neighbouring
    values, as ``percentile`` does) and the least value.

    Equal values are counted first. Distinct ones are then dealt to as many ranges of (group, value) as a shuffle has partitions,
    so a group of any size is spread over all tasks; from the counts of ranges follows which of them hold a wanted rank, and only these
    are looked into. Null values do not count, NaN is larger than any other, null is a group like any other. Without ``by`` there
    is one row, with n = 0 and null where there are no values; a group without values has none.
    """
    by, at = list(by), [float(q) for q in at]
    if any(not 0 <= q <= 1 for q in at):
        raise ValueError("quantiles are between 0 and 1")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = written(df.select(*by, value.cast("double").alias("sg_v")).where("sg_v IS NOT NULL").groupBy(*by, "sg_v").agg(F.count(F.lit(1)).alias("sg_n")), "values")
    ranged = written(counted.repartitionByRange(parts, *[F.col(c) for c in by], F.col("sg_v")).withColumn("sg_p", F.spark_partition_id()), "ranges")
    # a row for each group and range that holds some of it
    pieces = ranged.groupBy(*by, "sg_p").agg(F.sum("sg_n").alias("own"), F.min("sg_v").alias("least"))
    group = Window.partitionBy(*by)
    pieces = pieces.withColumns({
        "before": F.coalesce(F.sum("own").over(group.orderBy("sg_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("own").over(group), "least": F.min("least").over(group),
    })
    points = F.array(*[F.lit(q) for q in at])
    ranks = F.array_distinct(F.flatten(F.transform(points, lambda q: F.array(F.floor(q * (F.col("total") - 1)), F.ceil(q * (F.col("total") - 1))))))
    wanted = pieces.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("own")))).where(F.size("ranks") > 0)
    rows = _join(ranged, wanted.select(*by, F.col("sg_p").alias("sg_piece"), "before", "total", "least", "ranks"), by) if not by else _join(ranged, wanted.select(*by, "sg_p", "before", "total", "least", "ranks"), [*by, "sg_p"])
    if not by:
        rows = rows.where("sg_p = sg_piece")
    upto = F.sum("sg_n").over(Window.partitionBy(*by, "sg_p").orderBy("sg_v"))
    rows = rows.withColumn("upto", F.col("before") + upto)
    hit = rows.select(*by, "total", "least", "sg_v", F.explode(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("sg_n")) & (r < F.col("upto")))).alias("rank"))
    # twice as many values as quantiles at most
    found = hit.groupBy(*by).agg(F.first("total").alias("n"), F.first("least").alias("least"), F.map_from_entries(F.collect_list(F.struct("rank", "sg_v"))).alias("m"))

    def quantile(q: Column) -> Column:
        where = q * (F.col("n") - 1)
        low, high = F.floor(where), F.ceil(where)
        return F.when(low == high, F.element_at("m", low)).otherwise((high - where) * F.element_at("m", low) + (where - low) * F.element_at("m", high))

    out = found.select(*by, "n", F.transform(points, quantile).alias("q"), "least")
    if by:
        return out
    nothing = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n0"))
    return nothing.join(F.broadcast(out), F.lit(True), "left").select(F.coalesce("n", "n0").alias("n"), F.when(F.col("n").isNotNull(), F.col("q")).alias("q"), "least")
