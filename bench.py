"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores of local mode.
Every query runs to its last row into a no-op sink; a small warm-up pass comes first.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marginalia.operators import evaluation, fusion, index, keyword
from marginalia.operators.blockindex import BlockIndex
from marginalia.plans import catalog
from marginalia.runtime import shared_dir
from marginalia.sources import corpus

HEADLINE = [
    "bm25_search", "bm25_weighted", "bm25_batch_topk", "vector_cosine_topk", "rrf_hybrid", "hash_embedding_vectors", "tokenize_documents",
    "language_detect", "chunk_text", "proportional_segments", "context_pack", "eval_metrics", "reembed_diff", "ingest_notes",
    "fts_search", "vector_batch_topk",
]


def percentiles(times: list[float]) -> dict[str, float]:
    held = sorted(times)
    return {"p50_ms": round(1000 * held[len(held) // 2], 1), "p95_ms": round(1000 * held[max(int(len(held) * 0.95) - 1, 0)], 1)}


def latencies(spark: SparkSession, d: str, many: int = 32) -> dict:
    """Warm latency of single queries over stored indexes, batch throughput, build times and quality.

    The queries are whole benchmark texts, the vectors stored ones; quality is graded by the
    labels of the pool of twenty, for comparison between builds only.
    """
    chunks = corpus.chunks(spark, d).select("doc_id", "text")
    vectors = corpus.vectors(spark, d).select("doc_id", "vector")
    root = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    build = {}
    for name, make in (("keyword", lambda: index.build_keywords(chunks, f"{root}/keyword")), ("vector", lambda: index.build_vectors(vectors, f"{root}/vector"))):
        began = time.time()
        make()
        build[f"{name}_build_sec"] = round(time.time() - began, 3)
    began = time.time()
    blocks = BlockIndex(spark, f"{root}/blocks", ttl=1e9, hold=True)
    blocks.append(chunks.join(vectors, "doc_id", "left"))
    build["blocks_build_sec"] = round(time.time() - began, 3)
    words, near = index.KeywordIndex(spark, f"{root}/keyword", ttl=1e9), index.VectorIndex(spark, f"{root}/vector", ttl=1e9, hold=True)
    near.units.count()
    asked = [r.text for r in corpus.table(spark, d, "benchmark").orderBy("item_id").limit(many).collect()]
    point = [list(r.vector) for r in vectors.orderBy("doc_id").limit(len(asked)).collect()]
    modes = {
        "keyword": lambda q, v: words.search(q),
        "vector": lambda q, v: near.search(v),
        "hybrid": lambda q, v: fusion.fuse([words.search(q, 20), near.search(v, 20)]),
        # the way of the engine
        "engine_keyword": lambda q, v: blocks.search(q),
        "engine_vector": lambda q, v: blocks.nearest(v),
        "engine_hybrid": lambda q, v: fusion.fuse([blocks.search(q, 20), blocks.nearest(v, 20)]),
    }
    out = {}
    for name, run in modes.items():
        for q, v in list(zip(asked, point))[:3]:
            run(q, v).collect()
        times = []
        for q, v in zip(asked, point):
            began = time.time()
            run(q, v).collect()
            times.append(time.time() - began)
        out[name] = percentiles(times)
    queries = corpus.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    began = time.time()
    pool = keyword.search_many(chunks, queries, 20).cache()
    n = pool.select("query_id").distinct().count()
    out["batch_queries_per_sec"] = round(n / (time.time() - began), 2)
    grades = pool.join(corpus.table(spark, d, "labels"), "doc_id").select("query_id", "doc_id", F.col("quality").alias("grade"))
    row = evaluation.metrics(pool, grades, 10).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("recall", "mrr", "ndcg")]).first()
    return {**out, "quality": row.asDict(), **build}


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(d.rstrip("/")), "sf0.001")
    found, times = catalog.queries(), {}
    catalog.bm25_search(spark, small if os.path.isdir(small) else d).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        began = time.time()
        found[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(
        json.dumps(
            {"metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "latency": latencies(spark, d), "cpus": int(cpus), "sf": d.rstrip("/").rsplit("/", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
