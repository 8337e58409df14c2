"""Exact cosine ranking and the upkeep of stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine


def one_model(vectors: DataFrame, dims: int, model: str | None = None) -> DataFrame:
    """Vectors of the active model and width, the newest row of each document."""
    rows = vectors.where(F.col("vector").isNotNull() & (F.size("vector") == dims))
    if model is not None:
        rows = rows.where(F.col("model") == model)
    if "created_at" in rows.columns:
        rows = rows.groupBy("doc_id").agg(F.max_by("vector", "created_at").alias("vector"))
    return rows


def search(vectors: DataFrame, query: Column | list[float], limit: int = 10) -> DataFrame:
    """The nearest vectors by cosine times weight, above 0; filters come before.

    A zero query gives no rows, as no score is above 0.
    """
    q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, list) else query
    rows = vectors.withColumn("score", cosine(F.col("vector"), q))
    if "weight" in rows.columns:
        rows = rows.withColumn("score", F.col("score") * F.col("weight"))
    return rows.where("score > 0").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id")).limit(limit).drop("vector")


def compare_stored(stored: DataFrame, fresh: DataFrame, same: float = 0.999) -> DataFrame:
    """(doc_id, action, similarity): created, updated, unchanged or orphaned."""
    old = stored.groupBy("doc_id").agg(F.min("vector").alias("old"), F.count("*").alias("times"))
    both = old.join(fresh.select("doc_id", F.col("vector").alias("new")), "doc_id", "full")
    near = F.when(F.size("old") == F.size("new"), cosine(F.col("old"), F.col("new")))
    action = (
        F.when(F.col("old").isNull(), "created")
        .when(F.col("new").isNull(), "orphaned")
        .when((F.col("times") > 1) | near.isNull() | (near < same), "updated")
        .otherwise("unchanged")
    )
    return both.select("doc_id", action.alias("action"), near.alias("similarity"))


def applied_plan(stored: DataFrame, fresh: DataFrame, model: str, prune: bool = False, same: float = 0.999) -> DataFrame:
    """The stored vectors (doc_id, model, vector) after a re-embedding with ``model``.

    Unchanged vectors stay as they are, others are replaced by the fresh ones; documents that
    have none any more keep what they had.  ``prune`` drops the rows of other models.
    """
    own, others = stored.where(F.col("model") == model), stored.where(~F.col("model").eqNullSafe(F.lit(model)))
    plan = compare_stored(own.select("doc_id", "vector"), fresh, same)
    new = plan.where("action IN ('created', 'updated')").select("doc_id")
    kept = own.join(new, "doc_id", "left_anti")
    made = fresh.join(new, "doc_id", "left_semi").select("doc_id", F.lit(model).alias("model"), "vector")
    rows = kept.select("doc_id", "model", "vector").unionByName(made)
    return rows if prune else rows.unionByName(others.select("doc_id", "model", "vector"))
