"""A corpus pipeline of five stages over ``documents``; each reads what the one before has written.

1. toxicity: documents that the counterfactual-regularised model rejects go.
2. n-gram Jaccard join: of each class of near copies (5 words, 0.8) the least doc_id stays.
3. suffix-array dedup: bytes of strings that occur more than once go; every document stays.
4. mixing: documents come as often as their rates say, so that languages draw nearer; no
   document falls below one copy.
5. byte-level BPE: token ids, with their digest.

Rows with nulls pass every stage; a null text has no tokens.  An empty table gives an
empty one.  Columns beside those of ``documents`` stay up to the mixing stage, whatever
their names; the last stage names its own.  Rows that repeat in all columns are near copies of
each other, so the second stage leaves one; rows of null or empty texts stay as often as
they are there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, mixing, ngram_join, suffix_dedup, toxicity
from marginalia.llm.queries import language_and_quality, pattern, vocabulary
from marginalia.runtime import shared_dir, swept

#: Bytes of a repeated string: some fifty words of five letters are longer.
REPEATED = 240

#: Languages are drawn together by this power of their share.
TEMPER = 0.3


def _plain(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns beside doc_id and text under names of no one else, and what gives all of them back."""
    named = {c: c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]), [F.col(n).alias(c) for c, n in named.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(*toxicity.labelled_sample(whole, labels))
    rows, back = _plain(docs)
    return toxicity.score_documents(rows, model).where("predicted = 0").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates_removed(docs, 5, 80, 100)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, back = _plain(docs)
    cleaned = suffix_dedup.remove_repeats(rows, REPEATED).withColumn("text", F.col("kept")).select(*back)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def _nearer(have: dict[str, float]) -> dict[str, float]:
    """Target tokens: good text of the smaller languages more often, none less than now."""
    most = max((n for d, n in have.items() if d.endswith("-good")), default=0.0)
    return {d: n * max(most / n, 1.0) ** TEMPER if d.endswith("-good") and n > 0 else n for d, n in have.items()}


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mixing.mix_rates(docs.select("doc_id", "text"), language_and_quality(docs, labels), totals=_nearer, least=1.0, most=4.0)
    return mixing.mixed(docs, rates)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "lang", "source", "text")
    return byte_bpe.encode_documents(rows, vocabulary, pattern(), ("n_tokens", "ids", "ids_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL cannot express the fitted stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    The folders go when the session ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    swept(spark, root)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
