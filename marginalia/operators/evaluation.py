"""Retrieval quality of many runs at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graded(run: DataFrame, judged: DataFrame, known: DataFrame) -> DataFrame:
    """``run`` with grade: that of ``judged`` (query_id, doc_id, grade) if there is one, else 2 for a source
    that ``known`` (query_id, doc_id) names, else 0.
    """
    rows = run.join(judged.select("query_id", "doc_id", F.col("grade").alias("given")), ["query_id", "doc_id"], "left")
    rows = rows.join(known.select("query_id", "doc_id", F.lit(2).alias("named")).distinct(), ["query_id", "doc_id"], "left")
    return rows.withColumn("grade", F.coalesce("given", "named", F.lit(0))).drop("given", "named")


def all_grades(judged: DataFrame, known: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of everything relevant: judged rows, and known sources that nobody judged, as 2."""
    rest = known.select("query_id", "doc_id").distinct().join(judged.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return judged.select("query_id", "doc_id", "grade").unionByName(rest.withColumn("grade", F.lit(2)))


def metrics(run: DataFrame, grades: DataFrame, k: int = 10, everywhere: DataFrame | None = None) -> DataFrame:
    """(query_id, recall, mrr, ndcg) of a run (query_id, doc_id, rank) under graded judgements (query_id, doc_id, grade).

    Gains are 2**grade - 1 with a discount of log2(rank + 1); unjudged rows count as 0.  Totals
    and ideals come from all ``grades`` of a query, or, where judgements hold for every
    query alike, from those of ``everywhere`` (doc_id, grade), whose counts by grade are enough.
    Queries without relevant documents score 0.
    """
    judged = run.where(F.col("rank") <= k).join(grades, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    got = judged.groupBy("query_id").agg(
        F.count_if(F.col("grade") >= 1).alias("hits"),
        F.min(F.when(F.col("grade") >= 1, F.col("rank"))).alias("first"),
        F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    if everywhere is None:
        best = grades.where("grade >= 1").withColumn("r", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id)"))
        ideal = best.groupBy("query_id").agg(
            F.count("*").alias("total"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1))).alias("idcg")
        )
        rows = got.join(ideal, "query_id", "left")
    else:
        # as many rows as there are different grades
        counts = sorted(((r.grade, r.n) for r in everywhere.where("grade >= 1").groupBy("grade").agg(F.count("*").alias("n")).collect()), reverse=True)
        top = [g for g, n in counts for _ in range(min(n, k))][:k]
        idcg = sum((2.0**g - 1) / math.log2(i + 2) for i, g in enumerate(top))
        rows = got.withColumn("total", F.lit(sum(n for _, n in counts) or None).cast("long")).withColumn("idcg", F.lit(idcg))
    return rows.select(
        "query_id",
        F.coalesce(F.col("hits") / F.least(F.col("total"), F.lit(k)), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
    )


def latencies(times: DataFrame) -> DataFrame:
    """p50 and the p95 by index of (mode, ms)."""
    held = times.groupBy("mode").agg(F.array_sort(F.collect_list("ms")).alias("ms"))
    n = F.size("ms")
    return held.select("mode", F.expr("(ms[(size(ms) - 1) div 2] + ms[size(ms) div 2]) / 2").alias("p50"), F.element_at("ms", F.greatest(F.floor(n * 0.95).cast("int"), F.lit(1))).alias("p95"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(mode, metric, before, after, change) of two reports (mode, metric, value); a side that lacks a row has null."""
    old = before.select("mode", "metric", F.col("value").alias("before"))
    both = old.join(after.select("mode", "metric", F.col("value").alias("after")), ["mode", "metric"], "full")
    return both.withColumn("change", F.col("after") - F.col("before")).orderBy("mode", "metric")
