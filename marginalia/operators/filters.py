"""Filters that apply before ranking, each a step for ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def language(code: str | None, undetermined: bool = False) -> Step:
    """Sources in a language; with ``undetermined`` also those without one; no code, no filter."""

    def step(rows: DataFrame) -> DataFrame:
        if code is None:
            return rows
        fits = F.col("language") == code
        return rows.where(fits | F.col("language").isNull() if undetermined else fits)

    return step


def tree(slug: str | None) -> Step:
    return lambda rows: rows if slug is None else rows.where(F.col("tree") == slug)


def entities(links: DataFrame, slugs: list[str], known: list[str] | None = None) -> Step:
    """Sources linked to any of the entities.

    No slugs, no filter.  Unknown slugs are ignored; if ``known`` shows that all of them
    are, the plan folds to an empty relation.
    """

    def step(rows: DataFrame) -> DataFrame:
        if not slugs:
            return rows
        wanted = slugs if known is None else [s for s in slugs if s in known]
        if not wanted:
            return rows.where(F.lit(False))
        return rows.join(links.where(F.col("slug").isin(wanted)).select("doc_id"), "doc_id", "left_semi")

    return step


def tenant(name: str) -> Step:
    return lambda rows: rows.where(F.col("tenant_id") == name)
