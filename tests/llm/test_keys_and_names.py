"""Row keys that do not mix texts up, and columns of any name."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, gif_media, mixing, queries, suffix_dedup, toxicity, url_filter


@pytest.fixture(scope="module")
def colliding(spark):
    """Two texts of 90 bytes that Spark's 32-bit hash does not tell apart."""
    rows = spark.range(250_000).select(F.concat(F.lpad(F.col("id").cast("string"), 10, "0"), F.repeat(F.lit(" word"), 16)).alias("text"))
    pair = rows.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).where(F.size("t") > 1).first()
    return list(pair.t[:2])


def test_texts_without_an_id_are_told_apart(spark, colliding):
    a, b = colliding
    unlike = "".join(chr(97 + i * 7 % 26) + chr(97 + i * i % 23) for i in range(41))
    docs = spark.createDataFrame([(None, a), (None, b), (None, unlike), (7, b), (7, a[:50])], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(docs.where(F.col("text") != b), 40).collect()}
    assert got[None, 82].n_removed == 0 and got[None, len(a)].n_removed > 0
    # a repeats bytes of its own; tokens go by text
    p = mixing.posteriors(docs, ["x"], [0.0], spark.createDataFrame([], "word string, logs array<double>"))
    assert sorted((r.doc_id or 0, r.tokens) for r in p.collect()) == [(0, 1), (0, 17), (0, 17), (7, 9), (7, 17)]


def test_unique_text_of_a_colliding_pair_stays(spark, colliding):
    """One of two rows without an id is repeated elsewhere; the other, of the same 32-bit hash, keeps all its bytes."""
    a, b = colliding
    rows = [(None, a), (None, b), (3, a)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 88).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, 90), (3, 90)]


def test_columns_with_dots_and_quotes(spark):
    odd = "x.y`z"
    docs = spark.createDataFrame([(1, "a text", "kept")], "doc_id long, text string, o string").withColumnRenamed("o", odd)
    row = byte_bpe.encode_documents(docs, queries.vocabulary, queries.pattern()).first()
    assert row[odd] == "kept"
    coded = spark.createDataFrame([([1, 2], "kept")], "ids array<int>, o string").withColumnRenamed("o", odd)
    assert byte_bpe.decode_documents(coded, queries.vocabulary, queries.pattern()).first()[odd] == "kept"
    assert toxicity.score_documents(docs, toxicity.Model(np.zeros(1 << toxicity.HASH_BITS), 0.0)).first()[odd] == "kept"
    pages = spark.createDataFrame([("http://a.com/", "kept")], "url string, o string").withColumnRenamed("o", odd)
    assert url_filter.filter_urls(pages, queries.URL_RULES).first()[odd] == "kept"
    media = spark.createDataFrame([(bytearray(gif_media.write_gif(bytes(64))), "kept")], "media binary, o string").withColumnRenamed("o", odd)
    assert gif_media.frames_of(media).first()[odd] == "kept"


def test_byte_bpe_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_documents(empty, queries.vocabulary, queries.pattern()).collect() == []
    assert byte_bpe.decode_documents(spark.createDataFrame([], "ids array<int>"), queries.vocabulary, queries.pattern()).collect() == []


def test_toxicity_fit_against_plain_gradient_steps():
    """The objective of the fit, written out with dense arrays, is not lessened by further plain steps."""
    rng = np.random.default_rng(3)
    words = ["awful", "vermin", "house", "river", "bread", "women", "men", "stone"]
    labels = rng.integers(0, 2, 80)
    texts = [" ".join([*rng.choice(words[2:], 5), *(["awful"] if y else [])]) for y in labels]
    how = {"counterfactual": 1.0, "sparsity": 2e-4, "evidence": 0.0}
    fitted = toxicity.fitted(texts, labels.tolist(), rounds=3000, **how)
    swap = toxicity.swaps(toxicity.IDENTITY_TERMS)
    with np.errstate(over="ignore"):
        slot, off, _ = toxicity.features(pa.array(texts))
        slot2, off2, _ = toxicity.features(pa.array(texts), swap=swap)
        moved = toxicity.features(pa.array(texts), named=swap)[2]
    used = np.unique(slot)

    def dense(slots, offsets):
        out = np.zeros((len(texts), len(used)))
        for i in range(len(texts)):
            own = np.intersect1d(slots[offsets[i] : offsets[i + 1]], used)
            out[i, np.searchsorted(used, own)] = 1
        return out

    x, x2, y = dense(slot, off), dense(slot2, off2), labels.astype(float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    pairs = max(moved.sum(), 1)

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (moved * ((x - x2) @ w) ** 2).sum() / pairs + how["sparsity"] * np.abs(w).sum()

    # the fitted intercept holds the threshold; the loss is taken at the best one for the weights
    w = fitted.weights[used]
    best = min(loss(w, b) for b in np.linspace(-12, 12, 2401))
    start, b = np.zeros(len(used)), 0.0
    for _ in range(20000):
        z = x @ start + b
        g = weight * (1 / (1 + np.exp(-z)) - y)
        d = moved * ((x - x2) @ start) * 2 / pairs
        step = start - 0.05 * (x.T @ g + (x - x2).T @ d)
        start, b = np.sign(step) * np.maximum(np.abs(step) - 0.05 * how["sparsity"], 0), b - 0.05 * g.sum()
    assert best <= loss(start, b) + 2e-3
