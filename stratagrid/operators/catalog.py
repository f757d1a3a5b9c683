"""Survey catalogs: name resolution, ranking, acquisition epochs and coverage.

Every operator takes ``by``, the columns that tell one area of interest from another, so one pass serves all areas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import boxes_touch, overlap_area
from ..functions.text import floor_days, midpoint, normal_name, years_between
from ..plans.tables import written
from . import polygons

BOX = ("xmin", "ymin", "xmax", "ymax")
TIERS = (1, 2, 3, 4)


def resolve_names(surveys: DataFrame, resources: DataFrame, survey: str = "workunit", name: str = "name", count: str = "count") -> DataFrame:
    """The resource of each survey: the lowest tier on which names agree wins, then the larger count, then the name.

    Every name becomes one row per tier with the key it folds to, so all tiers are one equi-join. candidates: the names at
    the winning tier. Surveys that none fits are left out. Of a resource given twice the larger count stands.
    """
    keys = lambda c: F.array(*[F.struct(F.lit(t).alias("tier"), normal_name(F.col(c), t).alias("key")) for t in TIERS])
    left = surveys.select(survey).where(F.col(survey).isNotNull()).distinct().select(survey, F.explode(keys(survey)).alias("k")).select(survey, "k.*")
    right = resources.groupBy(name).agg(F.max(F.coalesce(count, F.lit(0))).alias(count)).select(name, count, F.explode(keys(name)).alias("k")).select(name, count, "k.*")
    hits = left.join(right, ["tier", "key"])
    by = Window.partitionBy(survey)
    best = hits.withColumn("least", F.min("tier").over(by)).where("tier = least")
    picked = F.struct((-F.col(count)).alias("c"), F.col(name).alias("n"))
    return best.groupBy(survey, "tier").agg(F.min(picked).alias("p"), F.sort_array(F.collect_set(name)).alias("candidates")).select(survey, "tier", F.col("p.n").alias("resource"), "candidates")


def sort_surveys(surveys: DataFrame) -> DataFrame:
    """By quality level, then the latest first; of equal ones the order is not told."""
    return surveys.orderBy(*_survey_order())


def _survey_order() -> list[Column]:
    return [F.col("ql").asc_nulls_last(), F.col("end").desc_nulls_last()]


def survey_places(surveys: DataFrame, by: Sequence[str], ties: Sequence[str] = ("workunit",)) -> DataFrame:
    """``surveys`` with place, from 1, in the order of ``sort_surveys``, for each area."""
    return surveys.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*_survey_order(), *[F.col(t).asc() for t in ties])))


def assign_epochs(surveys: DataFrame, by: Sequence[str], order: Sequence[str], gap_days: float = 1.5 * 365.25, start: str = "start", end: str = "end") -> DataFrame:
    """``surveys`` with epoch_no and epoch, the year or years of a cluster whose middles follow each other within the gap.

    A new cluster begins where whole days exceed the gap. Rows without dates are ``undated``, with no number.
    """
    mid = surveys.withColumn("sg_mid", midpoint(F.col(start), F.col(end)))
    w = Window.partitionBy(*by, F.col("sg_mid").isNull()).orderBy("sg_mid", *order)
    new = F.coalesce((floor_days(F.col("sg_mid"), F.lag("sg_mid").over(w)) > gap_days).cast("int"), F.lit(1))
    out = mid.withColumn("sg_new", new).withColumn("epoch_no", F.when(F.col("sg_mid").isNotNull(), F.sum("sg_new").over(w)))
    group = Window.partitionBy(*by, "epoch_no")
    low, high = F.min(F.year("sg_mid")).over(group), F.max(F.year("sg_mid")).over(group)
    label = F.when(F.col("epoch_no").isNull(), "undated").when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))
    return out.withColumn("epoch", label).drop("sg_mid", "sg_new")


def prefer(df: DataFrame, flag: Column, by: Sequence[str]) -> DataFrame:
    """Rows with ``flag``; all rows of a group in which none has it."""
    w = Window.partitionBy(*by)
    out = df.withColumn("sg_flag", F.coalesce(flag, F.lit(False))).withColumn("sg_any", F.max("sg_flag").over(w))
    return out.where("sg_flag OR NOT sg_any").drop("sg_flag", "sg_any")


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("sg_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("sg_n = 1").drop("sg_n")


def select_latest(surveys: DataFrame, by: Sequence[str], name: str = "workunit") -> DataFrame:
    """The latest survey of each area, then the widest, then by name; ``undated`` where none has a date. n_candidates counts all."""
    counted = surveys.withColumn("n_candidates", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    dated = prefer(counted, F.col("end").isNotNull(), by)
    out = first_by(dated, by, [F.col("end").desc_nulls_last(), F.col("overlap").desc_nulls_last(), F.col(name).asc()])
    return out.withColumn("undated", F.col("end").isNull())


def pick_anchor(surveys: DataFrame, by: Sequence[str], name: str = "workunit") -> DataFrame:
    """The survey that others are compared with: of those that meet the specification, if any, and have dates, if any, the widest, then the latest."""
    meets = prefer(surveys, F.col("category") == "Meets", by)
    dated = prefer(meets, midpoint(F.col("start"), F.col("end")).isNotNull(), by)
    return first_by(dated, by, [F.col("overlap").desc_nulls_last(), F.col("end").desc_nulls_last(), F.col(name).asc()])


def relative_metrics(surveys: DataFrame, by: Sequence[str], name: str = "workunit") -> DataFrame:
    """``surveys`` with anchor (is it the area's anchor), dt_years from the anchor's middle, and same_geoid; two unknown geoids are not the same."""
    a = pick_anchor(surveys, by, name).select(*by, F.col(name).alias("sg_name"), midpoint(F.col("start"), F.col("end")).alias("sg_mid"), F.col("geoid").alias("sg_geoid"))
    out = surveys.join(a, list(by))
    return out.withColumns({"anchor": F.col(name) == F.col("sg_name"), "dt_years": years_between(midpoint(F.col("start"), F.col("end")), F.col("sg_mid")), "same_geoid": F.coalesce(F.col("geoid") == F.col("sg_geoid"), F.lit(False))}).drop("sg_name", "sg_mid", "sg_geoid")


def rank_collections(related: DataFrame, by: Sequence[str], ties: Sequence[str] = ("workunit",)) -> DataFrame:
    """priority 1, 2, ...: the anchor, those that meet the specification, the better quality, the nearer in time, the wider."""
    quality = F.coalesce(F.nullif(F.regexp_extract("ql", r"^QL ([0-3])$", 1), F.lit("")).cast("int"), F.lit(9))
    order = [F.col("anchor").desc(), (~F.coalesce(F.col("category") == "Meets", F.lit(False))).asc(), quality.asc(), F.coalesce(F.abs("dt_years"), F.lit(999.0)).asc(), F.col("overlap").desc_nulls_last(), *[F.col(t).asc() for t in ties]]
    return related.withColumn("priority", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def coverage(surveys: DataFrame, areas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Surveys whose box meets their area's, with the share of the area that each covers; areas without extent are an error."""
    own = [F.col(f"a_{c}") for c in BOX]
    box = [F.col(c) for c in BOX]
    a = areas.select(*by, *[F.col(c).alias(f"a_{c}") for c in BOX])
    size = (own[2] - own[0]) * (own[3] - own[1])
    size = F.when(size > 0, size).otherwise(F.raise_error(F.lit("an area has no extent")))
    return surveys.join(a, list(by)).where(boxes_touch(box, own)).withColumn("share", overlap_area(box, own) / size).drop(*[f"a_{c}" for c in BOX])


def _as_polygons(boxes: DataFrame, areas: DataFrame, by: Sequence[str]) -> DataFrame:
    parts = lambda df: df.withColumn("parts", polygons.box_parts(*[F.col(c) for c in BOX]))
    # boxes need no names: only what they cover together counts
    return polygons.overlay(parts(areas), parts(boxes).withColumn("sg_id", F.monotonically_increasing_id()), by, "sg_id", degrees=False)


def union_coverage(boxes: DataFrame, areas: DataFrame, by: Sequence[str]) -> DataFrame:
    """The share of each area that its boxes cover together: no part counts twice."""
    return polygons.covered_share(_as_polygons(boxes, areas, by), by)


def coverage_gaps(boxes: DataFrame, areas: DataFrame, by: Sequence[str]) -> DataFrame:
    """The parts of each area that no box covers: gap_frac and its bounds, one row per connected part."""
    return polygons.gaps(_as_polygons(boxes, areas, by), by).drop("area")


def search(surveys: DataFrame, areas: DataFrame, by: Sequence[str], resources: DataFrame | None = None, least: float = 0.0, name: str = "workunit") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What there is for each area: its surveys, ranked and in epochs; the gaps that these leave; the surveys that cover less than ``least``.

    Shapes are polygons (``parts``). Surveys get aoi_overlap_frac, and with ``resources`` ept_names and ept_coverage_frac (see
    ``polygons.inventory``), the comparison with the anchor, priority and epoch.
    """
    pieces = polygons.overlay(areas, surveys, by, name, resources)
    found = polygons.inventory(pieces, surveys, by, name, resources is not None).withColumn("overlap", F.col("aoi_overlap_frac"))
    kept, dropped = min_overlap(written(found, "inventory"), least)
    ranked = assign_epochs(rank_collections(relative_metrics(kept, by, name), by, [name]), by, [name])
    # the dropped ones cover nothing that counts
    after = pieces if least <= 0 else polygons.overlay(areas, kept, by, name)
    return ranked, polygons.gaps(after, by), dropped


def with_resource(surveys: DataFrame, resources: DataFrame, name: str = "workunit") -> DataFrame:
    """Surveys whose name resolves to a resource, with it: only these can be read remotely. Lying under a resource is not enough."""
    return surveys.join(resolve_names(surveys, resources, name).select(name, "resource", "tier"), name)


def choose(surveys: DataFrame, resources: DataFrame, how: str, by: Sequence[str], names: Sequence[str] = (), name: str = "workunit") -> DataFrame:
    """The surveys, with their resources, that a selection means: ``auto`` all that have one, ``latest`` the latest of these in each area, ``list`` those of ``names``."""
    own = with_resource(surveys, resources, name)
    if how == "list":
        return own.where(F.col(name).isin(*names))
    if how == "latest":
        return select_latest(own, by, name)
    if how != "auto":
        raise ValueError(f"no selection {how!r}")
    return own


def min_overlap(surveys: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Surveys with at least this share, and those that are dropped."""
    keep = F.coalesce(F.col("overlap") >= least, F.lit(False))
    return surveys.where(keep), surveys.where(~keep)


def epoch_summary(surveys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of surveys and least distance in time of each epoch, and its place: the anchor's epoch first, then the nearest, those without a distance last."""
    out = surveys.groupBy(*by, "epoch").agg(F.count(F.lit(1)).alias("n"), F.min(F.abs("dt_years")).alias("least_dt"), F.bool_or("anchor").alias("has_anchor"))
    order = [F.col("has_anchor").desc_nulls_last(), F.col("least_dt").asc_nulls_last(), F.col("epoch").asc()]
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def distinct_epochs(surveys: DataFrame, by: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """(by, n_epochs): how many epochs the surveys of each area are in."""
    return surveys.groupBy(*by).agg(F.count_distinct(epoch).alias("n_epochs"))


def draw_order(surveys: DataFrame, by: Sequence[str], area: str = "area", name: str = "workunit") -> DataFrame:
    """``surveys`` with draw, from 1 in each area: the largest first, so that smaller ones stay visible; those without an area before all."""
    order = Window.partitionBy(*by).orderBy(F.col(area).desc_nulls_first(), name)
    return surveys.withColumn("draw", F.row_number().over(order))


def open_share(gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, open_frac, n_gaps): what the gaps of each area come to together. Areas without gaps have no row."""
    return gaps.groupBy(*by).agg(F.sum("gap_frac").alias("open_frac"), F.count(F.lit(1)).alias("n_gaps"))
