"""Batch control: what is left to do, whether a run may be resumed, and the record of a batch."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")

PRODUCTS = ("dsm", "dtm", "dtm_fill", "intensity")
ALIASES = {"all": PRODUCTS, "dtm": ("dtm", "dtm_fill")}


def parse_products(text: str) -> list[str]:
    """The products that a comma-separated list names, in canonical order; ``all`` and ``dtm`` stand for several."""
    names = [x.strip().lower() for x in text.split(",") if x.strip()]
    if not names:
        raise ValueError("no product is named")
    found: set[str] = set()
    for n in names:
        if n not in ALIASES and n not in PRODUCTS:
            raise ValueError(f"no product {n!r}; there are {', '.join(PRODUCTS)}, all")
        found.update(ALIASES.get(n, (n,)))
    return [p for p in PRODUCTS if p in found]


def surface_method(text: str) -> tuple[str, float | None]:
    """``first_idw``, or ``NN-pct`` with one or two digits: the method and the share."""
    import re

    if text == "first_idw":
        return "idw", None
    if not re.fullmatch(r"\d{1,2}-pct", text):
        raise ValueError(f"{text!r} is neither first_idw nor NN-pct")
    return "max", int(text.split("-")[0]) / 100


def check_resume(prior: Mapping[str, object], current: Mapping[str, object], keys: Sequence[str]) -> list[str]:
    """Keys that the earlier run did not record. A value that has changed is an error: its outputs must not be mixed with new ones."""
    changed = [k for k in keys if k in prior and prior[k] != current.get(k)]
    if changed:
        raise ValueError(f"Cannot resume: {', '.join(changed)} changed")
    return [k for k in keys if k not in prior]


def selector(text: str, keywords: Iterable[str] = ("auto", "latest")) -> tuple[str, list[str]]:
    """A project selector: a keyword, or a list of names."""
    tokens = [t.strip() for t in text.split(",") if t.strip()]
    words = {k.lower() for k in keywords}
    if not tokens:
        raise ValueError("no project is named")
    if any("/" in t or "\\" in t for t in tokens):
        raise ValueError("projects are names, not paths")
    if any(t.lower() == "all" for t in tokens):
        raise ValueError("'all' is ambiguous; use 'auto'")
    hit = [t.lower() for t in tokens if t.lower() in words]
    if hit and len(tokens) > 1:
        raise ValueError(f"{hit[0]!r} can't be mixed with names")
    return (hit[0], []) if hit else ("list", tokens)


def local_project(text: str) -> str | None:
    """The project of a local folder of files: one name, or None for ``auto``, as the folder then names it. A folder is one project, so a list
    of names, and ``latest``, are errors, as all is that ``selector`` refuses."""
    kind, names = selector(text)
    if kind == "latest" or len(names) > 1:
        raise ValueError(f"{text!r} can't apply to a local folder: name the one project that its files belong to")
    return names[0] if names else None


def prefetched(load: Callable[[], DataFrame], kind: str) -> DataFrame | None:
    """What ``load`` reads, once for all projects. If it fails, a list of names can go on without it (None, with a warning), as each
    project then reads its own; a keyword (``auto``, ``latest``) can't, and the failure is raised."""
    try:
        return load()
    except Exception as e:
        if kind != "list":
            raise
        warnings.warn(f"the catalog could not be read beforehand ({e}); each project reads it", stacklevel=2)
        return None


def validated(checks: Mapping[str, Callable[[], bool]], then: Callable[[], T]) -> T:
    """What ``then`` does, once all ``checks`` hold; else one error that names all that fail, and nothing is done. What deletes or replaces
    goes into ``then``."""
    failed = []
    for what, check in checks.items():
        try:
            good = check()
        except Exception as e:
            failed.append(f"{what} ({e})")
        else:
            failed += [] if good else [what]
    if failed:
        raise ValueError(f"nothing was done: {'; '.join(failed)}")
    return then()


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without a committed output."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def carry_forward(old: DataFrame, new: DataFrame, key: str, same: Sequence[str], order: str = "ord") -> DataFrame:
    """A batch's record: new rows replace old ones of their key; old ones of the same grid stay in place, those of another go."""
    grid = new.select(*same).distinct()
    kept = old.join(grid, list(same), "left_semi")
    place = kept.select(key, F.col(order).alias("sg_place"))
    top = kept.agg(F.max(order)).first()[0] or 0
    fresh = new.join(place, key, "left").withColumn(order, F.coalesce("sg_place", F.col(order) + top)).drop("sg_place")
    return kept.join(new.select(key), key, "left_anti").unionByName(fresh)


def outcome_tally(tiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tiles per product: ok, empty and failed, and how many hold data."""
    return tiles.groupBy(*by).agg(
        F.count_if(F.col("state") == "ok").alias("ok"),
        F.count_if(F.col("state") == "empty").alias("empty"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") != "empty").alias("data_total"),
    )


def project_outcomes(tiles: DataFrame, key: str = "project", error: str = "error") -> DataFrame:
    """(project, state, note): completed, completed (no data) or failed, from the states of a project's tiles and the error, if any, that ended it.

    One project's failure says nothing of another's. A run that may not be resumed is told apart, as its advice is another.
    """
    counts = tiles.groupBy(key).agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") == "failed").alias("failed"), F.min(error).alias("sg_error"))
    state = F.when(F.col("sg_error").isNotNull(), F.concat(F.lit("failed: "), F.col("sg_error"))).when(F.col("failed") > 0, F.concat(F.lit("failed: "), F.col("failed").cast("string"), F.lit(" tiles"))).otherwise("completed")
    note = F.when(F.startswith(F.col("sg_error"), F.lit("Cannot resume")), "start it anew in another folder").when(is_failed(state), "run it again to resume").when(F.col("ok") == 0, "no data")
    return counts.select(key, state.alias("state"), note.alias("note"))


def is_failed(state: Column) -> Column:
    return F.startswith(state, F.lit("failed"))


def has_no_data(note: Column) -> Column:
    return F.coalesce(F.contains(note, F.lit("no data")), F.lit(False))


def finish(outcomes: DataFrame, key: str = "project") -> int:
    """The number of projects; an error that names the first failed ones if there are any, once all have had their turn."""
    failed = outcomes.where(is_failed(F.col("state"))).orderBy(key).select(key).limit(10).collect()
    if failed:
        raise RuntimeError(f"{outcomes.where(is_failed(F.col('state'))).count()} projects failed, among them {', '.join(str(r[0]) for r in failed)}")
    return outcomes.count()


def output_name(area: str, resolution: float, project: str | None = None) -> str:
    """What an area's outputs are called: ``area_1m``, with the project's name behind it if there is one."""
    return f"{area}_{resolution:g}m" + (f"_{project}" if project else "")


def span(low: float | None, high: float | None, unit: str = "") -> str:
    """``1.5-2 m``, one number where both are the same, and nothing where one is missing."""
    if low is None or high is None:
        return ""
    tail = f" {unit}" if unit else ""
    return f"{low:g}{tail}" if low == high else f"{low:g}-{high:g}{tail}"
