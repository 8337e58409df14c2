"""BM25 ranking.

For one query every term is a column: a scan yields each chunk's length and term counts,
a one-row aggregate gives the statistics, and the score is an expression.  No token is
exploded and nothing is shuffled but that row and the top-k.  Many queries are ranked a
block at a time, by sparse products over Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_term, idf, tokenize, tokens_of
from ..runtime import materialise, small_batches
from .topk import Best


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, in order, by the tokenizer of the index."""
    return list(dict.fromkeys(tokens_of(query)))


def _tokens() -> Column:
    """Tokens of the text; a null text has none."""
    return F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>"))


def term_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """Length and the count of each term; the other columns of ``chunks`` but its text stay."""
    rest = [c for c in chunks.columns if c != "text"]
    held = chunks.select(*rest, _tokens().alias("toks"))
    # one look at all tokens leaves the few that are terms
    hits = F.filter("toks", lambda x: x.isin(terms)) if terms else F.array().cast("array<string>")
    held = held.select(*rest, F.size("toks").alias("dl"), hits.alias("hits"))

    def count(term: str) -> Column:
        return F.size(F.filter("hits", lambda x: x == F.lit(term)))

    counts = [count(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    return held.select(*rest, "dl", *counts)


def _terms_of(terms: list[str], among: list[str]) -> list[Column]:
    """Columns tf0, tf1, ... of ``terms`` from the counts of more terms."""
    return [F.col(f"tf{among.index(t)}").alias(f"tf{i}") for i, t in enumerate(terms)]


def statistics(counts: DataFrame, terms: list[str]) -> DataFrame:
    """One row: documents, mean length and the document frequency of each term."""
    return counts.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]
    )


def score(counts: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """Adds ``score``; ``stats`` is one row, so the product with it stays a map."""
    parts = [bm25_term(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"), idf(F.col("n"), F.col(f"df{i}"))) for i in range(len(terms))]
    total = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    drop = ["n", "avgdl", "dl", *(f"{k}{i}" for i in range(len(terms)) for k in ("tf", "df"))]
    return counts.join(F.broadcast(stats)).withColumn("score", total).drop(*drop)


def search(chunks: DataFrame, query: str, limit: int = 10, corpus: DataFrame | None = None) -> DataFrame:
    """The best chunks by BM25 times weight; ``chunks`` is filtered already.

    Statistics are those of ``chunks``, or of ``corpus`` for the global scope.  A column
    ``weight`` multiplies before the cut.  Chunks without score go; a query without
    tokens gives no rows.  Ties go by title, then by doc_id.
    """
    terms = query_terms(query)
    # statistics come before scores, from the same counts: texts are cut once
    counts = materialise(term_counts(chunks, terms), "term-counts")
    stats = statistics(counts if corpus is None else term_counts(corpus, terms), terms)
    return _best(counts, stats, terms, limit)


def search_each(chunks: DataFrame, queries: list[str], limit: int = 10) -> list[DataFrame]:
    """As ``search``, for each of a few queries; the chunks are cut into tokens once for all."""
    each = [query_terms(q) for q in queries]
    every = list(dict.fromkeys(t for terms in each for t in terms))
    counts = materialise(term_counts(chunks, every), "term-counts")
    rest = [c for c in counts.columns if c == "dl" or c in chunks.columns]
    own = [counts.select(*rest, *_terms_of(terms, every)) for terms in each]
    return [_best(c, statistics(c, terms), terms, limit) for c, terms in zip(own, each)]


def _best(counts: DataFrame, stats: DataFrame, terms: list[str], limit: int) -> DataFrame:
    ranked = score(counts, stats, terms)
    if "weight" in ranked.columns:
        ranked = ranked.withColumn("score", F.col("score") * F.col("weight"))
    keys = [F.desc(F.round("score", 9)), *([F.asc("title")] if "title" in ranked.columns else []), F.asc("doc_id")]
    return ranked.where("score > 0").orderBy(*keys).limit(limit)


def postings(chunks: DataFrame) -> DataFrame:
    """(token, doc_id, tf, dl): the inverted index; write it partitioned by a token hash."""
    toks = chunks.select("doc_id", _tokens().alias("toks")).select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("token"))
    return toks.groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))


#: Queries that one pass over the corpus ranks.
BLOCK = 2048


def search_many(chunks: DataFrame, queries: DataFrame, limit: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank) for each row (query_id, text) of ``queries``.

    Queries go out in blocks, each against all chunks: a task counts the block's tokens in a
    batch of chunks as one sparse product and keeps the best ``limit`` of each query, so
    what is shuffled is tasks x queries x limit rows, however common a token is.  Tokens are
    compared by 64-bit hashes.
    """
    spark = chunks.sparkSession
    small_batches(spark)

    def hashed(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.xxhash64(t))

    held = materialise(chunks.select(F.col("doc_id").cast("long").alias("doc_id"), hashed(_tokens()).alias("toks")), "batch-tokens")
    stats = held.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl")).first()
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = materialise(queries.select("query_id", hashed(F.array_distinct(_tokens())).alias("toks")).where(F.size("toks") > 0), "batch-queries")
    blocks = max(-(-asked.count() // block), 1)
    found = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        terms = np.unique(np.array([t for r in part for t in r.toks], np.int64))
        # as many rows as the block has tokens
        df = held.mapInArrow(_frequencies(terms), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weight = np.zeros(len(terms))
        for r in df:
            weight[r.term] = max(0.0, math.log(1 + (stats.n - r.df + 0.5) / (r.df + 0.5)))
        rows = held.mapInArrow(_scores([r.query_id for r in part], [r.toks for r in part], terms, weight, stats.avgdl or 1.0, limit), f"query_id {kind}, doc_id long, score double")
        found = rows if found is None else found.unionByName(rows)
    return found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)")).where(F.col("rank") <= limit)


def _counted(batch: pa.RecordBatch, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document's row, term, times) of the terms in a batch, and the documents' lengths."""
    lists = batch.column(1)
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()[off[0] : off[-1]]
    size = np.diff(off)
    at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
    hit = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
    key, times = np.unique(np.repeat(np.arange(len(size)), size)[hit] * max(len(terms), 1) + at[hit], return_counts=True)
    return key // max(len(terms), 1), key % max(len(terms), 1), times, size


def _frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            total += np.bincount(_counted(batch, terms)[1], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])

    return run


def _scores(ids: list, tokens: list, terms: np.ndarray, weight: np.ndarray, avgdl: float, limit: int, k1: float = 1.2, b: float = 0.75):
    # for each term the queries that ask for it, end to end
    pairs = sorted((int(np.searchsorted(terms, t)), q) for q, toks in enumerate(tokens) for t in toks)
    by = np.array([q for _, q in pairs], np.int64)
    first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(terms) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), limit)
        for batch in batches:
            row, term, times, size = _counted(batch, terms)
            part = weight[term] * times * (k1 + 1) / (times + k1 * (1 - b + b * size[row] / avgdl))
            many = first[term + 1] - first[term]
            at = np.repeat(first[term] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
            cell = np.repeat(row, many) * len(ids) + by[at]
            scores = np.bincount(cell, np.repeat(part, many), minlength=len(size) * len(ids)).reshape(len(size), len(ids))
            best.add(batch.column(0).to_numpy(), np.round(scores, 9))
        which, docs, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in which]) if len(which) else pa.nulls(0, pa.array(ids).type if ids else pa.int64()), pa.array(docs), pa.array(scores)], names=["query_id", "doc_id", "score"])

    return run
