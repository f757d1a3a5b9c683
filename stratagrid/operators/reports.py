"""Metrics from report text: tags, first matches, look-ahead values and their comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_match


def metrics(reports: DataFrame, patterns: Mapping[str, Sequence[str]], text: str = "text") -> DataFrame:
    """One row per report and metric that has a value: the first pattern that occurs, at its first place."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), first_match(F.col(text), p).alias("value")) for m, p in patterns.items()])
    keep = [c for c in reports.columns if c != text]
    return reports.select(*keep, F.explode(pairs).alias("m")).select(*keep, "m.*").where("value IS NOT NULL")


def first_of_files(found: DataFrame, by: Sequence[str], path: str) -> DataFrame:
    """Each project's metrics: the first file, by path, that has one decides; the files that also have it are counted."""
    return found.groupBy(*by, "metric").agg(F.min_by("value", path).alias("value"), F.min(path).alias("from"), F.count(F.lit(1)).alias("n_files"))


def look_ahead(lines: DataFrame, by: Sequence[str], order: str, label: Column, value: Column, reach: int = 3) -> DataFrame:
    """Rows where ``label`` holds, with the first value (``found``) of the next ``reach`` rows."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1, reach)
    return lines.withColumns({"sg_label": label, "sg_value": value}).withColumn("found", F.first("sg_value", ignorenulls=True).over(w)).where("sg_label").drop("sg_label", "sg_value")


def compare(found: DataFrame, label: str, project: str, projects: Sequence) -> DataFrame:
    """Metrics down, projects across; metrics that no project has are left out. The projects are given, so it is one pass."""
    out = found.groupBy(label).pivot(project, list(projects)).agg(F.min("value"))
    return out.where(F.coalesce(*[F.col(f"`{p}`") for p in projects]).isNotNull())


def window_check(start: Column, end: Column, ref_start: Column, ref_end: Column, slack_days: int = 45) -> Column:
    """Whether a report's dates fit its survey's within the slack; null where any date is missing."""
    return (start >= F.date_sub(ref_start, slack_days)) & (end <= F.date_add(ref_end, slack_days))
