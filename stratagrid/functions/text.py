"""Names, report text and dates as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def normal_name(name: Column, tier: int) -> Column:
    """A resource's name as far as ``tier`` folds it: 1 as it is, 2 without case, 3 without wrapper, 4 with - as _.

    The wrapper is told by capital letters, before case is folded.
    """
    if tier >= 3:
        name = F.regexp_replace(F.regexp_replace(name, r"^USGS_LPC_", ""), r"_LAS_\d{4}$", "")
    if tier >= 4:
        name = F.translate(name, "-", "_")
    return F.lower(name) if tier >= 2 else name


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """What the first pattern that occurs captures at its first place; null if none occurs."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def tag(xml: Column, name: str) -> Column:
    """The content of the first element ``name``, white space collapsed; null if there is none."""
    inner = F.regexp_extract(xml, f"(?is)<{name}(?:\\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(F.trim(F.regexp_replace(inner, r"\s+", " ")), F.lit(""))


def iso_date(digits: Column) -> Column:
    """YYYY-MM-DD of YYYYMMDD; null for anything else."""
    return F.when(digits.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))


def metres(value: Column, unit: Column) -> Column:
    """Centimetres as metres, to four places."""
    return F.when(unit == "cm", F.round(value / 100, 4)).otherwise(value)


def micros(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def midpoint(start: Column, end: Column) -> Column:
    """The middle of a window; of an open one, its known end."""
    middle = F.timestamp_add("MICROSECOND", F.floor(micros(end, start) / 2), start)
    return F.coalesce(middle, start, end)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days, towards the past for negative differences."""
    return F.floor(micros(later, earlier) / 86_400_000_000)


def years_between(later: Column, earlier: Column) -> Column:
    return F.round(floor_days(later, earlier) / YEAR_DAYS, 2)


def has_suffix(key: Column, suffixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(F.lower(key), F.lit(s))
    return out


def fingerprint(value: Column) -> Column:
    """Sixteen hex digits that tell one geometry or parameter set from another."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)


def endpoint_and_prefix(url: Column) -> tuple[Column, Column]:
    """A listing URL's endpoint and the key prefix behind it (with a slash at its end, unless it is empty)."""
    endpoint = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]+/?([^?#]*)", 1), r"/+$", "")
    return endpoint, F.when(path == "", path).otherwise(F.concat(path, F.lit("/")))


def grid_names(pipeline: Column) -> Column:
    """Distinct grid files that a transformation's text names, in order."""
    lists = F.regexp_extract_all(pipeline, F.lit(r"grids=([^\s]+)"), 1)
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.split(x, ","))))
