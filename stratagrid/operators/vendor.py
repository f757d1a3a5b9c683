"""Metrics of vendors' and agencies' survey reports, read from their text with Column expressions.

Each family of documents has its labelled patterns; of several patterns for a metric the first that occurs counts, at its first
place. Values are in metres and points per square metre.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_date, tag
from .reports import window_check

# The labels that the documents have.
#: Metrics, in the order of their groups, and the pattern that has them; tried in this order.
LABELLED = (
    (("n_nva", "nva_rmsez_m", "nva_95pct_m"), r"NVA of (?:Point Cloud|Bare Earth)\s+(\d+)\s+([\d.]+)\s+([\d.]+)"),
    (("n_vva", "vva_95th_m"), r"VVA of (?:Bare Earth|DEM)\s+(\d+)\s+[\d.]+\s+([\d.]+)"),
    (("nva_95pct_m", "n_nva"), r"^\s*NVA\s+[\d.]+\s*m\s+([\d.]+)\s+(\d+)\s*$"),
    (("vva_95th_m", "n_vva"), r"^\s*VVA\s+[\d.]+\s*m\s+([\d.]+)\s+(\d+)\s*$"),
    (("nva_rmsez_m",), r"Non-vegetated Vertical Accuracy \(NVA\) RMSE\(z\)\s+([\d.]+)/"),
    (("nva_95pct_m",), r"NVA\) at the 95% Confidence Level \+/-\s+([\d.]+)/"),
    (("vva_95th_m",), r"VVA\) at the 95(?:th)? [Pp]ercentile\s+([\d.]+)/"),
    (("anpd_ppsm",), r"Aggregate Nominal Pulse Density \(pls/(?:m..?|m2)\)\s+([\d.]+)"),
    (("anps_m",), r"Aggregate Nominal Pulse Spacing \(m\)\s+([\d.]+)"),
    (("first_return_density_ppsm",), r"^\s*Aggregate\s+[\d,]+\s+[\d,]+\s+([\d.]+)/[\d.]+"),
    (("measured_density_ppsm",), r"^\s*Density\s+([\d.]+)\s*pts?\s*/\s*m2?\s*$"),
    (("measured_density_ppsm",), r"Density\s+[\d.]+\s*pts?\s*/\s*m2\s+[\d.]+\s*pts?\s*/\s*m2\s+([\d.]+)\s*pts?\s*/\s*m2"),
    (("swath_relative_dz_mean_m",), r"relative vertical accuracy[\s\S]{0,120}?\(\s*([\d.]+)\s*meters?\)"),
    (("horizontal_acc95_m",), r"compiled to meet ([\d.]+)\s*m(?:eter)? horizontal accuracy"),
    (("nva_rmsez_pointcloud_vendor_cm",), r"Nonvegetated Vertical Accuracy \(Ground LAS\)[\s\S]{0,2000}?RMSE\s+([\d.]+)\s*cm\s+[\d.]+\s*cm"),
    (("nva_rmsez_dem_vendor_cm",), r"Nonvegetated Vertical Accuracy \(DEM\)[\s\S]{0,2000}?RMSE\s+([\d.]+)\s*cm\s+[\d.]+\s*cm"),
)
#: Labels on a line of their own, whose value ends one of the next three lines.
AHEAD = {"RMSEr": "horizontal_rmser_m", "ACCr": "horizontal_acc95_m"}
VALIDATION = {
    "quality_level": r"Quality Level:\s*(\S+)", "lidar_base_spec": r"Lidar Base Spec:\s*([\d.]+)", "p_method": r"P-Method:\s*([^\n]+?)\s*$", "geoid": r"Geoid Model:\s*([^\n]+?)\s*$",
    "horizontal_epsg": r"Horizontal EPSG Code:\s*(\d+)", "vertical_epsg": r"Vertical EPSG Code:\s*(\d+)", "verdict": r"delivered data is\s+([A-Z\s]+?)\s+3D Elevation",
}
PROJECT = {
    "primary_contractor": r"Primary Contractor:\s*([^\n]+?)\s*$", "lidar_base_spec": r"Lidar Base Specification:\s*(.+?)(?:\s{2,}|\n)", "p_method": r"P Method:\s*([^\n]+?)\s*$",
    "collection_start": r"Collection Start Date:\s*([\d-]+)", "collection_end": r"Collection End Date:\s*([\d-]+)",
}
#: A required and a tested value.
PAIR = r"(?:N/A|[\d.]+)\s+([\d.]+)"
RESULTS = "Vertical Accuracy Results"
VALIDATION_TITLE, PROJECT_TITLES = "Data Validation Report", (RESULTS, "Work Unit Definition")
# End of fixed values.
#: Patterns look at lines, which newlines end and nothing else: carriage returns and other breaks are characters of a line.
LINES = "(?md)"


def _group(text: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, LINES + pattern, k)), F.lit(""))


def _name(metric: str) -> str:
    return metric.removesuffix("_cm") + "_m" if metric.endswith("_cm") else metric


def _metrics(value, ahead) -> dict[str, Column]:
    """Metrics of ``value(pattern's number, group)`` and ``ahead(label)``."""
    found: dict[str, list[Column]] = {}
    for k, (names, _) in enumerate(LABELLED):
        for g, name in enumerate(names, 1):
            number = value(k, g).try_cast("double")
            found.setdefault(_name(name), []).append(F.round(number / 100, 4) if name.endswith("_cm") else number)
    for label, name in AHEAD.items():
        found.setdefault(name, []).append(ahead(label).try_cast("double"))
    return {name: F.coalesce(*columns) for name, columns in found.items()}


def _ahead(text: Column, label: str) -> Column:
    lines = F.split(text, r"\r?\n")
    after = F.flatten(F.transform(lines, lambda line, i: F.when(F.trim(line) == label, F.slice(lines, i + 2, 3)).otherwise(F.array().cast("array<string>"))))
    values = F.transform(after, lambda line: F.nullif(F.regexp_extract(line, r"([\d.]+)\s*m\s*$", 1), F.lit("")))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def labelled(text: Column) -> dict[str, Column]:
    """Each metric's expression (double; null where no pattern has it)."""
    return _metrics(lambda k, g: _group(text, LABELLED[k][1], g), lambda label: _ahead(text, label))


def _line(text: Column, pattern: str) -> Column:
    """The line in which the pattern's first place is, blanks collapsed; null if there is none."""
    at, match = F.regexp_instr(text, F.lit(LINES + pattern)), F.regexp_extract(text, LINES + pattern, 0)
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(match), F.length(text))
    rest = F.when(F.contains(after, F.lit("\n")), F.substring_index(after, "\n", 1)).otherwise("")
    return F.when(at > 0, F.trim(F.regexp_replace(F.concat(F.substring_index(before, "\n", -1), match, rest), r"\s+", " ")))


def fgdc(xml: Column) -> dict[str, Column]:
    """Dates and statements of a metadata document, and whether a statement was left blank."""
    out = {"acquisition_start": tag(xml, "begdate"), "acquisition_end": tag(xml, "enddate"), "vertical_accuracy_statement": tag(xml, "vertaccr"), "horizontal_accuracy_statement": tag(xml, "horizpar")}
    for c in ("acquisition_start", "acquisition_end"):
        out[c] = F.coalesce(iso_date(out[c]), out[c])
    blank = F.lit(False)
    for c in list(out.values()):
        blank = blank | F.coalesce(F.contains(c, F.lit("___")), F.lit(False))
    return out | {"unfilled_template_fields": blank}


def validation(text: Column) -> dict[str, Column]:
    """What a validation report says; null where a label is missing."""
    out = {name: _group(text, pattern) for name, pattern in VALIDATION.items()}
    return out | {"verdict": F.regexp_replace(out["verdict"], r"\s+", " ")}


def project(text: Column) -> dict[str, Column]:
    """What a project report says: of the table of tested accuracies the first layout, else the newer one, a row per product."""
    out = {name: _group(text, pattern) for name, pattern in PROJECT.items()}
    for c in ("collection_start", "collection_end"):
        us = r"^(\d{2})-(\d{2})-(\d{4})$"
        out[c] = F.when(out[c].rlike(us), F.regexp_replace(out[c], us, "$3-$1-$2")).otherwise(out[c])
    metres = lambda c: F.round(c.try_cast("double") / 100, 4)
    old = {}
    for label, names in (("Non-Vegetated Vertical Accuracy", ("nva_95_pointcloud_m", "nva_95_dem_m")), ("Vegetated Vertical Accuracy", ("vva_95th_pointcloud_m", "vva_95th_dem_m"))):
        for k, name in enumerate(names, 1):
            old[name] = metres(_group(text, rf"^\s*{label}\s*\n\s*{PAIR}\s+{PAIR}", k))
    rest = F.coalesce(F.get(F.split(text, RESULTS, 2), F.lit(1)), text)
    row = LINES + rf"^\s*{PAIR}\s+{PAIR}\s+{PAIR}\s*$"
    new = {}
    for k, kind in enumerate(("pointcloud", "dem")):
        for g, name in enumerate((f"nva_rmsez_{kind}_m", f"nva_95_{kind}_m", f"vva_95th_{kind}_m"), 1):
            new[name] = metres(F.get(F.regexp_extract_all(rest, F.lit(row), g), F.lit(k)))
    first = old["nva_95_pointcloud_m"].isNotNull()
    return out | {name: F.when(first, old[name]).otherwise(F.coalesce(new[name], old[name])) if name in old else F.when(~first, new[name]) for name in new}


def kind(text: Column) -> Column:
    """Which family a document's text belongs to: validation, project or labelled; null and empty texts to none."""
    is_project = F.lit(True)
    for title in PROJECT_TITLES:
        is_project = is_project & F.contains(text, F.lit(title))
    return F.when(F.length(text) == 0, None).when(F.contains(F.substring(text, 1, 400), F.lit(VALIDATION_TITLE)), "validation").when(is_project, "project").when(text.isNotNull(), "labelled")


def metric_rows(reports: DataFrame, by: Sequence[str], path: str = "path", text: str = "text", lines: bool = True) -> DataFrame:
    """(by, path, metric, value): all metrics of labelled documents, and with ``lines`` the line that each is from. Every file's evidence stays."""
    t = F.col(text)
    # each pattern is looked for once, whatever number of metrics it has
    found = {f"sg_{k}_{g}": _group(t, pattern, g) for k, (names, pattern) in enumerate(LABELLED) for g in range(1, len(names) + 1)}
    found |= {f"sg_{label}": _ahead(t, label) for label in AHEAD}
    if lines:
        found |= {f"sg_{k}_line": _line(t, pattern) for k, (_, pattern) in enumerate(LABELLED)}
    own = reports.where(kind(t) == "labelled").select(*by, path, *[c.alias(n) for n, c in found.items()])
    values = _metrics(lambda k, g: F.col(f"sg_{k}_{g}"), lambda label: F.col(f"sg_{label}"))
    said: dict[str, list[Column]] = {}
    for k, (names, _) in enumerate(LABELLED):
        for name in names:
            said.setdefault(_name(name), []).append(F.col(f"sg_{k}_line"))
    line = lambda m: [F.coalesce(*said.get(m, [F.lit(None).cast("string")]), F.lit(None).cast("string")).alias("line")] if lines else []
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value"), *line(m)) for m, c in values.items()])
    return own.select(*by, path, F.explode(pairs).alias("m")).select(*by, path, "m.*").where("value IS NOT NULL")


def project_metrics(rows: DataFrame, by: Sequence[str], path: str = "path") -> DataFrame:
    """(by, metric, value, from): of several files the first by path decides."""
    return rows.groupBy(*by, "metric").agg(F.min_by("value", path).alias("value"), F.min(path).alias("from"))


def point_spacing(density: Column) -> Column:
    """Metres between points of a density; null where there is none."""
    return F.when(density > 0, F.round(1 / F.sqrt(density), 3))


def project_records(reports: DataFrame, by: Sequence[str], path: str = "path", text: str = "text") -> DataFrame:
    """A row per project that has reports: metrics (map), validation and project_report (structs of the last such file), n_files, spacing."""
    by, t = list(by), F.col(text)
    as_struct = lambda columns, name: F.when(F.col("sg_kind") == name, F.struct(*[c.alias(k) for k, c in columns.items()]))
    marked = reports.withColumn("sg_kind", kind(t))
    last = lambda c, name: F.max_by(c, F.when(F.col("sg_kind") == name, F.col(path)))
    heads = marked.groupBy(*by).agg(last(as_struct(validation(t), "validation"), "validation").alias("validation"), last(as_struct(project(t), "project"), "project").alias("project_report"), F.count(F.lit(1)).alias("n_files"))
    metrics = project_metrics(metric_rows(reports, by, path, text, lines=False), by, path)
    as_map = metrics.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    out = heads.join(as_map, by, "left")
    density = F.coalesce(F.nullif(F.col("metrics")["first_return_density_ppsm"], F.lit(0.0)), F.col("metrics")["anpd_ppsm"])
    return out.withColumn("first_return_mean_spacing_m", point_spacing(density))


def pick_metadata(files: DataFrame, by: Sequence[str], path: str = "path") -> DataFrame:
    """The metadata file of each project: names that promise classified points first, then by path."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    order = F.when(F.contains(name, F.lit("Classified")), 0).otherwise(1)
    w = Window.partitionBy(*by).orderBy(order, path)
    return files.withColumn("sg_n", F.row_number().over(w)).where("sg_n = 1").drop("sg_n")


def dates_consistent(reports: DataFrame, surveys: DataFrame, by: Sequence[str], slack_days: int = 45) -> DataFrame:
    """``reports`` (acquisition_start, acquisition_end as text) with acquisition_dates_consistent by the survey's collect_start and
    collect_end; null where one is missing or can't be read."""
    day = lambda c: F.col(c).cast("string").try_cast("date")
    joined = reports.join(surveys.select(*by, "collect_start", "collect_end"), list(by), "left")
    good = window_check(day("acquisition_start"), day("acquisition_end"), day("collect_start"), day("collect_end"), slack_days)
    known = day("acquisition_start").isNotNull() & day("acquisition_end").isNotNull() & day("collect_start").isNotNull() & day("collect_end").isNotNull()
    return joined.withColumn("acquisition_dates_consistent", F.when(known, good))
