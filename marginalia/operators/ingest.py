"""Ingestion: notes and transcripts to sources, chunks, vectors and a job row, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import detect, tagged
from ..functions.text import hash_embedding
from .segmentation import chunk_text

#: The model name of vectors made by hashing.
HASH_MODEL = "deterministic-hash-v1"


def _id(prefix: str, *parts) -> Column:
    """An identifier made from its parts by rule: a rerun makes the same one."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def notes(rows: DataFrame, tenant: str = "local", most: int = 700) -> dict[str, DataFrame]:
    """sources, chunks, embeddings and jobs for notes (title, text, collection_id).

    Of notes that share title and text the one with the least collection_id stays.
    ``chunks`` also carries title and language of its source, so that showing both needs
    no join with sources.
    """
    # repeats go before anything is computed of them
    once = rows.groupBy("title", "text").agg(F.min("collection_id").alias("collection_id"))
    sources = once.select(
        _id("src", F.lit(tenant), "title", "text").alias("source_id"),
        F.lit(tenant).alias("tenant_id"),
        "collection_id",
        F.lit("text_note").alias("source_type"),
        "title",
        tagged(detect(F.col("text"))).alias("language"),
        "text",
    )
    # an outer explode is not preceded by a filter that would cut every text once more
    pieces = sources.select("source_id", "tenant_id", "title", "language", F.posexplode_outer(chunk_text(F.col("text"), most)).alias("n", "c")).where("n IS NOT NULL")
    chunks = pieces.select(
        _id("chk", "source_id", (F.col("n") + 1).cast("string")).alias("chunk_id"), "source_id", "tenant_id", (F.col("n") + 1).alias("chunk_index"),
        F.col("c.body").alias("text"), "c.start_char", "c.end_char", "title", "language",
    )
    return _finish(sources.drop("text"), chunks, "text_ingestion")


def transcripts(rows: DataFrame, tenant: str = "local") -> dict[str, DataFrame]:
    """The same for transcripts (show_title, episode_title, episode_url, language, segments).

    A segment is a chunk; a language that is given wins over the detected one.
    """
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    sources = rows.select(
        _id("src", F.lit(tenant), "show_title", "episode_title", F.coalesce("episode_url", F.lit(""))).alias("source_id"),
        F.lit(tenant).alias("tenant_id"),
        F.lit(None).cast("string").alias("collection_id"),
        F.lit("podcast_episode").alias("source_type"),
        F.col("episode_title").alias("title"),
        F.coalesce(F.nullif("language", F.lit("")), tagged(detect(whole))).alias("language"),
        "segments",
    ).dropDuplicates(["source_id"])
    parts = sources.select("source_id", "tenant_id", F.posexplode("segments").alias("n", "s"))
    chunks = parts.select(
        _id("chk", "source_id", (F.col("n") + 1).cast("string")).alias("chunk_id"), "source_id", "tenant_id", (F.col("n") + 1).alias("chunk_index"), F.col("s.text").alias("text"), F.col("s.start_ms"), F.col("s.end_ms")
    )
    return _finish(sources.drop("segments"), chunks, "transcript_ingestion")


def _finish(sources: DataFrame, chunks: DataFrame, kind: str) -> dict[str, DataFrame]:
    vectors = chunks.select("chunk_id", "source_id", F.lit(HASH_MODEL).alias("model"), F.lit(8).alias("dimensions"), hash_embedding(F.col("text")).alias("vector"))
    jobs = sources.select(_id("job", "source_id").alias("job_id"), "tenant_id", "source_id", F.lit(kind).alias("job_type"), F.lit("succeeded").alias("status"))
    return {"sources": sources, "chunks": chunks, "embeddings": vectors, "jobs": jobs}
