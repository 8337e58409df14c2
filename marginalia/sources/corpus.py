"""The retrieval model over the given tables: sources, chunks, vectors, entities, jobs.

Every reader selects its columns first, so projections and filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source for each document, with ranking weight and preference from its label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    timed = F.col("doc_id") % 2 == 0
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("src_"), "doc_id").alias("source_id"),
        F.concat(F.lit("Document "), "doc_id").alias("title"),
        F.when(timed, "podcast_episode").otherwise("text_note").alias("source_type"),
        F.col("lang").alias("language"),
        F.col("source").alias("tree"),
        F.when(timed, F.concat(F.lit("https://example.org/e/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "?x=1").otherwise(""))).alias("url"),
        F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.7).otherwise(1.0).alias("weight"),
        F.when(F.col("quality") == 1, "current").when(F.col("quality") == 0, "legacy").alias("preference"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as chunks: (doc_id, language, tree, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("tree"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the 64-dimensional model, with vec_id as the document's id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as timed segments: the n-th turn begins at n times four seconds."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("source"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text", (F.col("turn") * 4000).alias("start_ms")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as ingestion jobs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("job_type"), F.col("ts").alias("created_at"), F.col("user_id").alias("owner"), "value", F.col("props").alias("input_json")
    )
