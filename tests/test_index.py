"""Stored indexes against plain formulas over small corpora."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import tokenize, tokens_of
from marginalia.operators import index, keyword
from marginalia.operators.topk import Best


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choices(words, weights=[30 - i for i in range(30)], k=rnd.randrange(1, 40))) for _ in range(120)]
    return [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "rare Rare word")]


@pytest.fixture(scope="module")
def opened(spark, corpus, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('keywords')}"
    index.build_keywords(spark.createDataFrame(corpus, "doc_id long, text string"), path, 8)
    return index.KeywordIndex(spark, path)


def plain(corpus, query, kept=None, scope="global", formula="scan", weights=None):
    docs = {i: re.findall(r"\w+", (t or "").lower()) for i, t in corpus}
    base = docs if kept is None or scope == "global" else {i: t for i, t in docs.items() if i in kept}
    n, avg = len(base), sum(map(len, base.values())) / max(len(base), 1)
    out = {}
    for i, toks in docs.items():
        if kept is not None and i not in kept:
            continue
        score, tf = 0.0, Counter(toks)
        for t, times in Counter(query.split()).items():
            df = sum(t in x for x in base.values())
            if not tf[t] or not df:
                continue
            idf = max(0.0, math.log(1 + (n - df + 0.5) / (df + 0.5))) if formula == "scan" else max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * times
            score += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(toks) / avg))
        score *= (weights or {}).get(i, 1.0)
        if score > 0:
            out[i] = score
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]


@pytest.mark.parametrize("formula", ["scan", "fts"])
@pytest.mark.parametrize("scope", ["global", "filtered"])
def test_keyword_ranks(spark, corpus, opened, scope, formula):
    kept = {i: 1.0 + i % 3 for i, _ in corpus if i % 4}
    sources = spark.createDataFrame([(i, w) for i, w in kept.items()], "doc_id long, weight double")
    for query in ("w3 w20", "w0 w0 w29", "rare", "nothing"):
        got = [(r.doc_id, r.score) for r in opened.search(query, 10, sources, scope, formula).collect()]
        want = plain(corpus, query, set(kept), scope, formula, kept)
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    got = [(r.doc_id, r.score) for r in opened.search("w3 w20", formula=formula).collect()]
    assert np.allclose([s for _, s in got], [s for _, s in plain(corpus, "w3 w20", formula=formula)])


def test_the_index_ranks_as_the_scan_does(spark, corpus, opened):
    rows = spark.createDataFrame(corpus, "doc_id long, text string")
    a = [(r.doc_id, round(r.score, 9)) for r in keyword.search(rows, "w1 w7 w25").collect()]
    b = [(r.doc_id, round(r.score, 9)) for r in opened.search("w1 w7 w25").collect()]
    assert a == b


def test_a_token_of_many_chunks_is_stored_as_a_block(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/k"
    index.build_keywords(spark.createDataFrame(corpus, "doc_id long, text string").coalesce(1), path, 8)
    held = index.KeywordIndex(spark, path)
    times = {(t, i): n for i, text in corpus for t, n in Counter(re.findall(r"\w+", (text or "").lower())).items()}
    stored = spark.read.parquet(f"{held.folder}/postings")
    assert stored.count() == len({t for t, _ in times}) + 1 and held.docs.count() == len(corpus)
    assert {(r.token, r.doc_id): r.tf for r in held.postings.collect()} == times


def test_a_query_reads_its_own_buckets(opened):
    plan = opened.of(["w3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert "EqualTo(token,w3)" in plan or "In(token, [w3])" in plan
    assert opened.search("!!!").count() == 0
    with pytest.raises(ValueError):
        opened.search("w1", scope="other")


def test_query_tokens_are_those_of_the_index(spark):
    texts = ["Été 2x_y", "日本語テキスト ok", "語", "", "İx ß", "a-b c'd"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize(F.col("t")).alias("toks")).collect()
    assert all(list(r.toks) == tokens_of(r.t) for r in rows)


def test_a_new_generation_is_seen_after_the_time_to_live(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index.build_keywords(spark.createDataFrame([(1, "one")], "doc_id long, text string"), path, 4)
    slow, quick = index.KeywordIndex(spark, path), index.KeywordIndex(spark, path, ttl=0.0)
    index.build_keywords(spark.createDataFrame([(2, "one two")], "doc_id long, text string"), path, 4)
    assert [r.doc_id for r in slow.search("one").collect()] == [1]
    assert [r.doc_id for r in quick.search("one").collect()] == [2]
    assert slow.refresh(force=True) and [r.doc_id for r in slow.search("one").collect()] == [2]
    with pytest.raises(Exception):
        index.KeywordIndex(spark, f"file://{tmp_path}/none")


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(60, 5))
    rows = [(i, [float(x) for x in v], "m", i) for i, v in enumerate(table)]
    rows += [(3, [9.0] * 5, "m", -1), (100, [1.0] * 4, "m", 0), (101, None, "m", 0), (102, [0.0] * 5, "m", 0), (103, [1.0] * 5, "other", 0)]
    stored = spark.createDataFrame(rows, "doc_id long, vector array<double>, model string, created_at long")
    path = f"file://{tmp_path}/vectors"
    index.build_vectors(stored, path, "m")
    opened = index.VectorIndex(spark, path, hold=True)
    assert opened.dims == 5 and opened.units.count() == 61
    query = rng.normal(size=5)
    cos = table @ query / np.linalg.norm(table, axis=1) / np.linalg.norm(query)
    want = [i for i in np.argsort(-cos, kind="stable") if cos[i] > 0][:10]
    got = opened.search(query.tolist()).collect()
    assert [r.doc_id for r in got] == want and np.allclose([r.score for r in got], cos[want])
    few = spark.createDataFrame([(int(i), 2.0 if i == want[4] else 1.0) for i in want[2:8]], "doc_id long, weight double")
    assert opened.search(query.tolist(), 3, few).first().doc_id == want[4]
    assert opened.search([0.0] * 5).count() == 0 and opened.search([1.0]).count() == 0
    many = spark.createDataFrame([(k, rng.normal(size=5).tolist()) for k in range(7)] + [(8, [1.0])], "query_id long, vector array<double>")
    found = opened.search_many(many, 4).collect()
    for r in many.where("query_id < 7").collect():
        one = opened.search(list(r.vector), 4).collect()
        own = [x for x in sorted(found, key=lambda x: x["rank"]) if x.query_id == r.query_id]
        assert [x.doc_id for x in own] == [x.doc_id for x in one] and np.allclose([x.score for x in own], [x.score for x in one], atol=1e-8)
    a = index.version(stored, "created_at").first()
    assert (a.n, a.created, a.updated) == (65, "59", None)


def test_the_best_of_many_candidates():
    rng = np.random.default_rng(5)
    for limit in (1, 3, 50):
        best, seen = Best(4, limit), []
        for i in range(30):
            docs = np.arange(40) * 31 % 997 + 1000 * i
            scores = np.round(rng.random((40, 4)) * rng.choice([1.0, 0.0], (40, 4), p=[0.8, 0.2]), 1)
            best.add(docs, scores)
            seen += [(q, -scores[r, q], docs[r]) for r in range(40) for q in range(4) if scores[r, q] > 0]
        want = [x for q in range(4) for x in sorted(s for s in seen if s[0] == q)[:limit]]
        assert sorted(zip(*[a.tolist() for a in best.rows()])) == sorted((q, d, -s) for q, s, d in want)


def test_batches_rank_as_single_queries_do(spark, corpus):
    rows = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    asked = [(f"q{i}", t) for i, t in enumerate(["w1 w2", "w0", "rare w29", "", "none", "w3 w3 w4", None])]
    found = keyword.search_many(rows, spark.createDataFrame(asked, "query_id string, text string"), 7, block=2).collect()
    for q, t in asked:
        want = [(r.doc_id, r.score) for r in keyword.search(rows, t or "", 7).collect()]
        got = [(r.doc_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-8)
    assert keyword.search_many(rows.limit(0), spark.createDataFrame(asked, "query_id string, text string")).count() == 0
