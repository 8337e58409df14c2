"""Stored indexes: postings for keyword ranking and unit vectors for exact nearest neighbours.

Both are Parquet in a folder that the caller names.  A keyword query reads only the
buckets and row groups of its own tokens; a vector query scans unit vectors, so its score
is one dot product.  Building again writes a new generation beside the old one and then
switches a pointer, so readers never see half an index.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bm25_term, idf, tokenize, tokens_of
from ..runtime import lean, parallelism, small_batches
from .topk import Best

#: Buckets of the postings, one folder each, and parts that a bucket is dealt to; the bucket of all chunks' lengths.
BUCKETS, STRIPES, DOCS = 64, 8, -1

#: Tokens of the chunks that share blocks, from which on no more chunks are added, and blocks in one Arrow batch.
STRETCH, BLOCK_ROWS = 2_000_000, 8192

_ENTRIES = "entries array<struct<doc_id:bigint,dl:int,tf:int>>"

#: Seconds for which an open index is taken as current without a look at the pointer.
TTL = 30.0

#: Bytes of query vectors that go out to the executors at once.
QUERY_BYTES = 64_000_000


def publish(spark: SparkSession, path: str, generation: str) -> None:
    """Make a generation the current one: a new pointer row, the newest of which counts."""
    spark.createDataFrame([(generation, time.time_ns())], "generation string, at long").coalesce(1).write.mode("append").parquet(f"{path}/current")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the newest generation."""
    row = spark.read.schema("generation string, at long").parquet(f"{path}/current").orderBy(F.desc("at")).first()
    if row is None:
        raise ValueError(f"no index at {path}")
    return f"{path}/{row.generation}"


def version(rows: DataFrame, created: str | None = None, updated: str | None = None) -> DataFrame:
    """One row that changes when a corpus does: rows, newest creation, newest update."""
    def newest(name: str | None) -> Column:
        return (F.max(name) if name else F.lit(None)).cast("string")

    return rows.agg(F.count("*").alias("n"), newest(created).alias("created"), newest(updated).alias("updated"))


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def build_keywords(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> str:
    """Write the postings of ``chunks`` (doc_id, text) and make them current.

    A row is a block: a token and its entries (doc_id, length, count) in one stretch of chunks.  Blocks
    are dealt by bucket and stripe, so a stop word's lie in several files.  The blocks without a token, in bucket
    ``DOCS``, have every chunk with its length, those without tokens too.
    """
    spark = chunks.sparkSession
    small_batches(spark)
    generation = uuid.uuid4().hex
    toks = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("toks"))
    blocks = toks.mapInArrow(lean(_blocks), f"token string, {_ENTRIES}")
    blocks = blocks.withColumn("bucket", F.when(F.col("token").isNull(), DOCS).otherwise(_bucket(F.col("token"), buckets)))
    first = F.col("entries")[0]["doc_id"]
    dealt = blocks.repartition(parallelism(spark), "bucket", F.pmod(F.xxhash64(first), F.lit(STRIPES)))
    dealt.sortWithinPartitions("bucket", "token", first).write.partitionBy("bucket").parquet(f"{path}/{generation}/postings")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/{generation}/layout")
    publish(spark, path, generation)
    return generation


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toks) to posting blocks; chunks are put together up to ``STRETCH`` tokens."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += len(batch.column(1).flatten())
        if many >= STRETCH:
            yield from _posted(held)
            held, many = [], 0
    if held:
        yield from _posted(held)


def _posted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = pa.concat_arrays([b.column(0) for b in held])
    dl = np.concatenate([b.column(1).value_lengths().to_numpy() for b in held]).astype(np.int64)
    coded = pa.concat_arrays([b.column(1).flatten() for b in held]).dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    code, row = key // len(dl), key % len(dl)
    yield _lists(pa.nulls(1, pa.string()), np.array([0, len(dl)]), docs, dl, np.zeros(len(dl)))
    begins = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
    for i in range(0, len(begins) - 1, BLOCK_ROWS):
        some = begins[i : i + BLOCK_ROWS + 1]
        at = row[some[0] : some[-1]]
        yield _lists(coded.dictionary[i : i + BLOCK_ROWS], some - some[0], docs.take(pa.array(at)), dl[at], tf[some[0] : some[-1]])


def _lists(tokens: pa.Array, offsets: np.ndarray, docs: pa.Array, dl: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    entries = pa.StructArray.from_arrays([docs, pa.array(dl.astype(np.int32)), pa.array(tf.astype(np.int32))], names=["doc_id", "dl", "tf"])
    return pa.RecordBatch.from_arrays([tokens, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries)], names=["token", "entries"])


class KeywordIndex:
    """An open index; it looks for a newer generation once its time to live has passed."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = TTL) -> None:
        self.spark, self.path, self.ttl = spark, path, ttl
        self.folder, self.opened = "", 0.0
        self.refresh(force=True)

    def refresh(self, force: bool = False) -> bool:
        """Open the newest generation if the time to live has passed; was there a newer one?"""
        if not force and time.monotonic() - self.opened < self.ttl:
            return False
        folder, self.opened = current(self.spark, self.path), time.monotonic()
        if folder == self.folder:
            return False
        self.folder = folder
        self.buckets = self.spark.read.parquet(f"{folder}/layout").first().buckets
        blocks = self.spark.read.schema(f"token string, {_ENTRIES}, bucket int").parquet(f"{folder}/postings")
        self.postings = blocks.where(F.col("bucket") != DOCS).select("token", F.inline("entries"), "bucket")
        self.docs = blocks.where(F.col("bucket") == DOCS).select(F.inline("entries")).drop("tf")
        row = self.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        self.n, self.avgdl = row.n, row.avgdl or 0.0
        return True

    def of(self, tokens: list[str]) -> DataFrame:
        """The postings of some tokens, by document: folders and row groups of others are not read."""
        buckets = [_bucket(F.lit(t), self.buckets) for t in tokens]
        rows = self.postings.where(F.col("bucket").isin(*buckets) & F.col("token").isin(*tokens)).repartition("doc_id")
        return rows.groupBy("token", "doc_id", "dl").agg(F.sum("tf").cast("int").alias("tf"))

    def search(self, query: str, limit: int = 10, sources: DataFrame | None = None, scope: str = "global", formula: str = "scan") -> DataFrame:
        """(doc_id, score) of the best chunks for a query.

        ``sources`` (doc_id, and weight and title if it has them) restricts the chunks before
        ranking; weights multiply before the cut.  With scope ``filtered`` statistics are
        those of the restricted corpus, else of all.  The formula ``scan`` takes each token of the
        query once and an inverse document frequency that is never negative;
        ``fts`` takes repeated tokens as often as they occur and the classic frequency, 1e-6 at
        least.  Ties go by title, then by doc_id.  A query without tokens has no rows.
        """
        if scope not in ("global", "filtered") or formula not in ("scan", "fts"):
            raise ValueError("scope is global or filtered, formula is scan or fts")
        self.refresh()
        times = Counter(tokens_of(query))
        if not times:
            return self.docs.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
        rows, n, avgdl = self.of(list(times)), F.lit(self.n), F.lit(self.avgdl)
        if sources is not None and scope == "filtered":
            kept = sources.select("doc_id")
            rows = rows.join(kept, "doc_id", "left_semi")
            stats = self.docs.join(kept, "doc_id", "left_semi").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        df = rows.groupBy("token").agg(F.count("*").alias("df"))
        # as many rows as the query has tokens
        rows = rows.join(F.broadcast(df), "token")
        if sources is not None and scope == "filtered":
            rows, n, avgdl = rows.join(F.broadcast(stats)), F.col("n"), F.col("avgdl")
        if formula == "fts":
            classic = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
            often = F.element_at(F.create_map(*[F.lit(x) for pair in times.items() for x in pair]), F.col("token"))
            part = bm25_term(F.col("tf"), F.col("dl"), avgdl, classic) * often
        else:
            part = bm25_term(F.col("tf"), F.col("dl"), avgdl, idf(n, F.col("df")))
        ranked = rows.groupBy("doc_id").agg(F.sum(part).alias("score"))
        keys = [F.desc(F.round("score", 9))]
        if sources is not None:
            more = [c for c in ("weight", "title") if c in sources.columns]
            ranked = ranked.join(sources.select("doc_id", *more), "doc_id")
            if "weight" in more:
                ranked = ranked.withColumn("score", F.col("score") * F.col("weight"))
            keys += [F.asc("title")] if "title" in more else []
        return ranked.where("score > 0").orderBy(*keys, F.asc("doc_id")).limit(limit).select("doc_id", "score")


def unit(vector: Column) -> Column:
    """The vector over its length, in double precision; a zero vector stays."""
    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))

    return F.transform(F.array(vector.cast("array<double>")), scaled)[0]


def build_vectors(vectors: DataFrame, path: str, model: str | None = None, dims: int | None = None) -> str:
    """Write unit vectors of one model and width, the newest of each document, and make them current.

    ``vectors`` has doc_id and vector, and model and created_at if it keeps them.  Without
    ``dims`` the width is that of the first vector by doc_id.  Null vectors and other widths
    are left out; zero vectors stay and are never found.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vector").isNotNull())
    if model is not None:
        rows = rows.where(F.col("model") == model)
    if dims is None:
        first = rows.orderBy("doc_id").select(F.size("vector").alias("d")).first()
        dims = first.d if first else 0
    rows = rows.where(F.size("vector") == dims)
    newest = "created_at" if "created_at" in rows.columns else F.lit(0)
    rows = rows.groupBy("doc_id").agg(F.max_by("vector", newest).alias("vector"))
    generation = uuid.uuid4().hex
    rows.select("doc_id", unit(F.col("vector")).alias("unit")).write.parquet(f"{path}/{generation}/units")
    spark.createDataFrame([(dims, model)], "dims int, model string").coalesce(1).write.parquet(f"{path}/{generation}/layout")
    publish(spark, path, generation)
    return generation


class VectorIndex:
    """Open unit vectors; ``hold`` keeps them in the executors' memory for repeated queries."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = TTL, hold: bool = False) -> None:
        self.spark, self.path, self.ttl, self.hold = spark, path, ttl, hold
        self.folder, self.opened, self.units = "", 0.0, None
        self.refresh(force=True)

    def refresh(self, force: bool = False) -> bool:
        """As for keywords; vectors held of an older generation are let go."""
        if not force and time.monotonic() - self.opened < self.ttl:
            return False
        folder, self.opened = current(self.spark, self.path), time.monotonic()
        if folder == self.folder:
            return False
        if self.hold and self.units is not None:
            self.units.unpersist()
        self.folder = folder
        self.dims = self.spark.read.parquet(f"{folder}/layout").first().dims
        self.units = self.spark.read.schema("doc_id long, unit array<double>").parquet(f"{folder}/units")
        if self.hold:
            self.units = self.units.cache()
        return True

    def search(self, query: list[float], limit: int = 10, sources: DataFrame | None = None) -> DataFrame:
        """(doc_id, score) by cosine times weight, above 0; ``sources`` as for keywords.

        A zero query, or one of another width, has no rows.
        """
        self.refresh()
        norm = float(np.linalg.norm(query)) if len(query) else 0.0
        if len(query) != self.dims or norm == 0.0:
            return self.units.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))
        asked = ", ".join(f"{float(x) / norm!r}D" for x in query)
        rows = self.units.select("doc_id", F.expr(f"aggregate(zip_with(unit, array({asked}), (x, y) -> x * y), 0D, (a, b) -> a + b)").alias("score"))
        if sources is not None:
            rows = rows.join(sources.select("doc_id", *[c for c in ("weight",) if c in sources.columns]), "doc_id")
            if "weight" in sources.columns:
                rows = rows.withColumn("score", F.col("score") * F.col("weight"))
        return rows.where("score > 0").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id")).limit(limit).select("doc_id", "score")

    def search_many(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """(query_id, doc_id, score, rank) for each row (query_id, vector) of ``queries``.

        Queries go out in blocks of a stated size, each against all vectors as one matrix
        product a batch; a task passes on its best ``limit`` for each query.
        """
        self.refresh()
        small_batches(self.spark)
        asked = queries.where(F.size("vector") == self.dims).select("query_id", unit(F.col("vector")).alias("unit"))
        block = max(QUERY_BYTES // max(8 * self.dims, 1), 1)
        many = max(-(-asked.count() // block), 1)
        found = None
        for i in range(many):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == i).collect()
            rows = self.units.mapInArrow(_best_rows(part, limit), "query_id long, doc_id long, score double")
            found = rows if found is None else found.unionByName(rows)
        order = "PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id"
        return found.withColumn("rank", F.expr(f"row_number() OVER ({order})")).where(F.col("rank") <= limit)


def _best_rows(asked: list, limit: int):
    ids = np.array([r.query_id for r in asked], np.int64)
    matrix = np.array([r.unit for r in asked], float).T if asked else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), limit)
        for batch in batches:
            if matrix is None or not batch.num_rows:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best.add(batch.column(0).to_numpy(), np.round(rows @ matrix, 9))
        which, docs, scores = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(docs), pa.array(scores)], names=["query_id", "doc_id", "score"])

    return run
