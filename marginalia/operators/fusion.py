"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The constant that damps the first ranks.
DAMP = 60


def ranked(run: DataFrame, by: str = "score") -> DataFrame:
    """(doc_id, rank) of a run that a limit has cut already, so one task orders few rows."""
    return run.select("doc_id", F.expr(f"row_number() OVER (ORDER BY round({by}, 9) DESC, doc_id)").alias("rank"))


def fuse(runs: list[DataFrame], limit: int = 10, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): the sum of 1 / (60 + rank) over all runs, best first.

    Ties go by title, where ``titles`` (doc_id, title) gives them, then by doc_id.  The
    fused rows are few, the limits of the runs together, and are the side that is broadcast.
    """
    rows = reduce(DataFrame.unionByName, [ranked(r) for r in runs])
    fused = rows.groupBy("doc_id").agg(F.sum(1 / (F.lit(DAMP) + F.col("rank"))).alias("score"))
    keys = [F.desc(F.round("score", 12))]
    if titles is not None:
        # an inner join may broadcast the few; those without a title come back by a join of few with few
        named = titles.select("doc_id", "title").join(F.broadcast(fused.select("doc_id")), "doc_id")
        fused = fused.join(F.broadcast(named), "doc_id", "left")
        keys.append(F.asc_nulls_last("title"))
    return fused.orderBy(*keys, F.asc("doc_id")).limit(limit).select("doc_id", "score")
