"""Search by mode, the language policy before it and the context pack after it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import TAGGED_FROM, detect
from ..functions.text import citation_label, timestamp_url
from . import filters, fusion, keyword, vector

POLICIES = ("auto", "strict", "any")
MODES = ("keyword", "vector", "hybrid")

#: A corpus of so many sources second-guesses a detected language below this share.
GUARD_SOURCES, GUARD_SHARE = 10, 0.1


def language_counts(sources: DataFrame) -> DataFrame:
    """(language, n), most frequent first, ties by code; a row with null for untagged ones."""
    return sources.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("language"))


@dataclass(frozen=True)
class Decision:
    """The language to filter by (None: no filter), and whether untagged sources pass too."""

    language: str | None
    undetermined: bool


def decide(counts: dict[str | None, int], policy: str, explicit: str | None, found: tuple[str | None, float]) -> Decision:
    """The language policy, on counts by language (a small aggregate) and a detected language.

    ``any`` never filters.  A candidate, given or detected with confidence, gives way to
    the dominant language if no source has it, or, when only detected under ``auto``, if
    it is a thin part of a corpus of some size.
    """
    policy = (policy or "auto").lower()
    if policy not in POLICIES:
        raise ValueError(f"language_policy is one of {', '.join(POLICIES)}")
    if policy == "any":
        return Decision(None, False)
    loose = policy == "auto"
    named = {c: n for c, n in counts.items() if c is not None}
    dominant = min(named, key=lambda c: (-named[c], c)) if named else None
    candidate = explicit or (found[0] if found[1] >= TAGGED_FROM else None)
    matching, total = named.get(candidate, 0), sum(counts.values())
    thin = loose and explicit is None and total >= GUARD_SOURCES and matching < max(1.0, total * GUARD_SHARE)
    if candidate is None or matching == 0 or thin:
        return Decision(dominant, loose)
    return Decision(candidate, loose)


def detected(spark: SparkSession, text: str) -> tuple[str | None, float]:
    row = spark.range(1).select(detect(F.lit(text)).alias("d")).first().d
    return row.language, row.confidence


def notice(counts: dict[str | None, int], tokens: int, found: tuple[str | None, float]) -> dict | None:
    """Why a result may be empty: a query without tokens, or in a language that no source has."""
    known = [c for c in sorted((c for c in counts if c is not None), key=lambda c: (-counts[c], c))]
    wrong = tokens == 0 or (bool(known) and found[0] is not None and found[1] >= TAGGED_FROM and found[0] not in known)
    return {"code": "cross_language_query", "query_language": found[0], "corpus_languages": known} if wrong else None


def search(
    chunks: DataFrame,
    vectors: DataFrame,
    queries: list[tuple[str, list[float]]],
    mode: str = "hybrid",
    limit: int = 10,
    language: Decision = Decision(None, False),
    tree: str | None = None,
    tenant: str | None = None,
    entities: list[str] | None = None,
    links: DataFrame | None = None,
    titles: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, score) of one query, given as (text, vector), or of it and its translations.

    Filters come before ranking: language, tree, tenant (of chunks and vectors alike), and
    entities, by ``links`` (doc_id, slug).  Hybrid fuses keyword and vector runs of twice the
    limit; several queries are run to twice the limit each and fused again.  Ties of fused
    scores go by ``titles`` (doc_id, title) first.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    held = chunks.transform(filters.language(language.language, language.undetermined)).transform(filters.tree(tree))
    if tenant is not None:
        held = held.transform(filters.tenant(tenant))
        vectors = vectors.transform(filters.tenant(tenant)) if "tenant_id" in vectors.columns else vectors
    if entities:
        held = held.transform(filters.entities(links, entities))
    near = vectors if held is chunks else vectors.join(held.select("doc_id"), "doc_id", "left_semi")
    most = limit if len(queries) == 1 else 2 * limit

    deep = 2 * most if mode == "hybrid" else most
    said = keyword.search_each(held, [t for t, _ in queries], deep) if mode != "vector" else []
    met = [vector.search(near, v, deep) for _, v in queries] if mode != "keyword" else []
    each = [[run.select("doc_id", "score") for run in (said[i : i + 1] + met[i : i + 1])] for i in range(len(queries))]
    runs = [fusion.fuse(pair, most, titles) if mode == "hybrid" else pair[0] for pair in each]
    return runs[0] if len(runs) == 1 else fusion.fuse(runs, limit, titles)


def context_pack(hits: DataFrame, sources: DataFrame, texts: DataFrame) -> DataFrame:
    """Ranked hits with verbatim text, citation and link.

    ``hits`` is a limited run: text and sources join it late, and it is the side that is
    broadcast (its size is the limit).
    """
    few = F.broadcast(hits)
    rows = sources.join(few, "doc_id").join(texts.select("doc_id", "text"), "doc_id")
    start = F.when(F.col("source_type") == "podcast_episode", (F.col("doc_id") * 1000).cast("long"))
    return rows.select(
        F.expr("row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)").alias("rank"),
        "doc_id",
        "title",
        "text",
        citation_label(F.col("source_type"), F.col("tree"), F.lit(None).cast("string"), F.col("title"), start, F.lit(1)).alias("citation"),
        timestamp_url(F.col("source_type"), F.col("url"), start).alias("link"),
    )
