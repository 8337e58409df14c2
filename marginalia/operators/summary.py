"""Resolving one whole source for a summary, and its ordered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_tokens, episode_number


def match_score(title: Column, query: str) -> Column:
    """Shared words, 10 more for the same number, 5 more if the title holds the query."""
    q = F.lit(query)
    shared = F.size(F.array_intersect(ascii_tokens(title), ascii_tokens(q)))
    number = F.when(episode_number(q) == episode_number(title), 10).otherwise(0)
    inside = F.when(F.contains(F.lower(title), F.lower(q)), 5).otherwise(0)
    return (shared + number + inside).cast("double")


def resolve(sources: DataFrame, query: str, preference: str = "current") -> DataFrame:
    """The best source: by score, preference, weight, title, then id; none without a score."""
    order = F.when(F.col("preference") == preference, 0).when(F.col("preference") == "current", 1).when(F.col("preference") == "legacy", 3).otherwise(2)
    rows = sources.withColumn("match", match_score(F.col("title"), query)).where("match > 0")
    return rows.orderBy(F.desc("match"), order, F.desc("weight"), F.asc("title"), F.asc("doc_id")).limit(1)


def context(source: DataFrame, chunks: DataFrame, most: int | None = None) -> DataFrame:
    """The chunks (doc_id, chunk_index, body) of the one resolved source, in order."""
    rows = chunks.join(F.broadcast(source.select("doc_id", "title")), "doc_id")
    if most is not None:
        rows = rows.where(F.col("chunk_index") <= most)
    return rows.select("doc_id", "title", "chunk_index", "body").orderBy("doc_id", "chunk_index")
