"""The queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir, swept
from . import byte_bpe, conversation, gif_media, imatch, mixing, ngram_join, quality, spelling, suffix_dedup, token_order, toxicity, url_filter, warc

#: Rules of the URL query: (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def vocabulary() -> str:
    """Where this machine keeps the rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def language_and_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents: language and label of quality."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.where("lang IS NOT NULL").select("doc_id", "lang").join(known, "doc_id").select(
        "doc_id", F.concat_ws("-", "lang", F.when(F.col("quality") == 1, "good").otherwise("poor")).alias("domain")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mixing.mix_rates(docs.select("doc_id", "text"), language_and_quality(docs, labels))
    return rates.select("doc_id", "tokens", "domains", "p", "rate", "copies")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_documents(spark, sf_dir), vocabulary, pattern(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_digests(gif_media.store_texts(_documents(spark, sf_dir)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's 400 bytes, and beside them the words of shared passages of over 50 words, which may be shorter."""
    cleaned = suffix_dedup.remove_repeats(_documents(spark, sf_dir), 400, digest=True, shared=51)
    return cleaned.withColumnRenamed("kept", "kept_sha256")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records as they are read back from their bytes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = warc.round_trip(warc.responses_of(pages))
    headers = F.array_join(F.transform("source_headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return rows.withColumn("source_headers", headers).withColumn("block", F.sha2("block", 256)).withColumnRenamed("block", "block_sha256")


def op6_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).drop("url")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = toxicity.fit(*toxicity.labelled_sample(docs, labels))
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_token_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots as they are read back from the shards that are written into the shared folder."""
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sequences, n = token_order.assign_slots(_documents(spark, sf_dir), key=20240101)
    token_order.write_shards(sequences, path, n)
    swept(spark, path)
    return token_order.shard_rows(spark, path, n)


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_documents(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(_documents(spark, sf_dir), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return quality.score_documents(docs, labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    damaged = conversation.damaged(rows)
    summary, lines = conversation.repair(damaged)
    out = rows.select("conv_id").distinct()
    for more in (conversation.gaps(damaged), summary, conversation.line_digests(lines)):
        named = more.withColumnRenamed("conv_id", "c")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.vocabulary(_documents(spark, sf_dir), every=31))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mixing, op2_byte_bpe, op3_gif_media, op4_suffix_dedup, op5_warc, op6_url_trie, op7_toxicity,
            op8_token_order, op9_imatch, op10_ngram_join, op11_quality, op12_conversation, op13_spelling,
        )
    }


_OP6 = """
WITH rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
rest AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
),
front AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS front FROM rest),
parts AS (
  SELECT page_id,
    translate(regexp_extract(front, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_replace(front, '^[^/]*', '') AS path
  FROM front
),
fits AS (
  SELECT p.page_id, r.rule_host || r.rule_path AS rule, r.verdict,
    row_number() OVER (
      PARTITION BY p.page_id ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC
    ) AS nth
  FROM (SELECT DISTINCT * FROM parts) p
  JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.nth = 1
"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return {"op6_url_trie": _OP6.format(rules=rules)}
