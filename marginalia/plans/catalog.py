"""The query catalogue: each entry applies operators of the engine to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import detect, tagged
from ..functions.text import (
    citation_label, classify_url, clean_html_blocks, clean_html_flat, hash_embedding, links, replace_time,
    seconds_from_duration, slugify, timestamp_url, tokenize,
)
from ..operators import entities as entity_ops
from ..operators import evaluation, filters, ingest, keyword, maintenance, planning, retrieval, segmentation, summary, vector
from ..runtime import materialise
from ..sources import captions, corpus

#: The query of the single-query entries, and its translation.
QUERY, TRANSLATED = "The erly with tion of", "der und ein von erly"

#: Documents whose vectors stand for the embedded queries.
QUERY_VECTOR, TRANSLATED_VECTOR = 3, 4

#: Upper bounds of the range look-up.
BOUNDS = [(50, 1), (120, 2), (300, 3), (510, 4)]

#: Rules for trees: playlist, tree, priority.
TREE_RULES = [("p0", "news", 1), ("p1", "talks", 1), ("p2", "archive", 5), ("p3", "news", 2)]

_CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _millis(column: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _CATALOG[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import importing  # noqa: F401  registers its own

    return dict(_CATALOG)


def _scored(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select("doc_id", F.round("score", digits).alias("score"))


def _vector_of(spark: SparkSession, d: str, doc_id: int) -> list[float]:
    row = corpus.vectors(spark, d).where(F.col("doc_id") == doc_id).select("vector").first()
    return list(row.vector) if row else [0.0] * 64


@query
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    """English or untagged chunks by BM25 with the statistics of the filtered corpus."""
    return _scored(keyword.search(corpus.chunks(spark, d).transform(filters.language("en", True)).select("doc_id", "text"), QUERY))


@query
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    toks = corpus.table(spark, d, "documents").select("doc_id", tokenize(F.col("text")).alias("toks"))
    return toks.select("doc_id", F.size("toks").alias("n_tokens"), F.md5(F.array_join("toks", " ")).alias("digest"))


@query
def token_df_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document and collection frequency of every token."""
    post = keyword.postings(corpus.chunks(spark, d))
    return post.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def bm25_filtered_lang(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(spark, d).transform(filters.language("de")).transform(filters.tree("src3"))
    return _scored(keyword.search(rows.select("doc_id", "text"), TRANSLATED))


@query
def bm25_weighted(spark: SparkSession, d: str) -> DataFrame:
    weights = corpus.sources(spark, d).select("doc_id", "title", "weight")
    rows = corpus.chunks(spark, d).select("doc_id", "text").join(weights, "doc_id")
    return _scored(keyword.search(rows, QUERY))


@query
def bm25_global_stats(spark: SparkSession, d: str) -> DataFrame:
    """English chunks ranked with the statistics of the whole corpus."""
    rows = corpus.chunks(spark, d)
    return _scored(keyword.search(rows.transform(filters.language("en")).select("doc_id", "text"), QUERY, corpus=rows.select("doc_id", "text")))


def _batch(spark: SparkSession, d: str, limit: int) -> DataFrame:
    asked = corpus.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return keyword.search_many(corpus.chunks(spark, d), asked, limit)


@query
def bm25_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of every benchmark text, in one job."""
    return _batch(spark, d, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def vector_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _scored(vector.search(corpus.vectors(spark, d).select("doc_id", "vector"), _vector_of(spark, d, QUERY_VECTOR)))


@query
def vector_weighted_filtered(spark: SparkSession, d: str) -> DataFrame:
    kept = corpus.sources(spark, d).where(F.col("tree").isin("src1", "src2", "src3")).select("doc_id", "weight")
    rows = corpus.vectors(spark, d).select("doc_id", "vector").join(kept, "doc_id")
    return _scored(vector.search(rows, _vector_of(spark, d, QUERY_VECTOR)))


@query
def hash_embedding_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(spark, d).select("doc_id", hash_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(8)])


@query
def hash_vector_search(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(spark, d).select("doc_id", hash_embedding(F.col("text")).alias("vector"))
    return _scored(vector.search(rows, hash_embedding(F.lit(QUERY))))


@query
def mixed_model_guard(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of another width among the stored ones are no candidates."""
    rows = corpus.vectors(spark, d).select("doc_id", "vector")
    foreign = rows.where("doc_id % 2 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.slice("vector", 1, 16).alias("vector"))
    return _scored(vector.search(vector.one_model(rows.unionByName(foreign), 64), _vector_of(spark, d, QUERY_VECTOR)))


@query
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.search(corpus.chunks(spark, d), corpus.vectors(spark, d).select("doc_id", "vector"), [(QUERY, _vector_of(spark, d, QUERY_VECTOR))])
    return _scored(found, 9)


@query
def rrf_translated_multi_run(spark: SparkSession, d: str) -> DataFrame:
    asked = [(QUERY, _vector_of(spark, d, QUERY_VECTOR)), (TRANSLATED, _vector_of(spark, d, TRANSLATED_VECTOR))]
    return _scored(retrieval.search(corpus.chunks(spark, d), corpus.vectors(spark, d).select("doc_id", "vector"), asked), 9)


def _detected(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "documents").select("doc_id", "lang", detect(F.col("text")).alias("found"))


@query
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d).select("doc_id", "found.language", F.round("found.confidence", 6).alias("confidence"))


@query
def language_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d).groupBy("lang", F.col("found.language").alias("language")).agg(F.count("*").alias("n"))


@query
def language_tagging(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d).groupBy(tagged(F.col("found")).alias("language")).agg(F.count("*").alias("n"))


@query
def dominant_language(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.language_counts(corpus.chunks(spark, d).where("language IS NOT NULL")).limit(1)


@query
def corpus_languages(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.language_counts(corpus.chunks(spark, d))


@query
def language_guard_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunks(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("language") == "fr").alias("matching"))


def _counts(spark: SparkSession, d: str) -> dict[str | None, int]:
    """A row for each language: the few numbers that the policy decides on."""
    return {r.language: r.n for r in retrieval.language_counts(corpus.chunks(spark, d)).collect()}


@query
def language_policy(spark: SparkSession, d: str) -> DataFrame:
    """What each policy filters by for a German question, and for a given language that no source has."""
    counts, found = _counts(spark, d), retrieval.detected(spark, "Was sagen die Quellen über das Buch und wie")
    cases = [("any", None), ("auto", None), ("strict", None), ("auto", "fr"), ("strict", "xx")]
    rows = [(p, e, *vars(retrieval.decide(counts, p, e, found)).values()) for p, e in cases]
    return spark.createDataFrame(rows, "policy string, given string, language string, undetermined boolean")


@query
def query_language_notice(spark: SparkSession, d: str) -> DataFrame:
    counts, rows = _counts(spark, d), []
    for text in ("!!!", "что говорит книга об исходе", "where is the book"):
        found = retrieval.notice(counts, len(keyword.query_terms(text)), retrieval.detected(spark, text))
        rows.append((text, found and found["code"], found and found["query_language"], found and ",".join(found["corpus_languages"])))
    return spark.createDataFrame(rows, "query string, code string, query_language string, corpus_languages string")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "documents").select("doc_id", F.col("source").alias("slug"))


@query
def entity_filter_semijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.sources(spark, d).transform(filters.entities(_links(spark, d), ["src3", "src5", "nobody"]))
    return rows.select("source_id", "title", "language")


@query
def source_entities_listing(spark: SparkSession, d: str) -> DataFrame:
    raw = _links(spark, d).select("doc_id", F.lit("org").alias("type"), "slug", F.lit(None).cast("string").alias("entity_label"), F.upper("slug").alias("label"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("role"))
    return entity_ops.normalise(raw).groupBy("entity_type", "slug", "label", "role").agg(F.count("*").alias("sources"))


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    """The documents' lines as paragraphs, with blank lines between, in chunks."""
    text = F.regexp_replace("text", "\n", "\n\n")
    held = corpus.chunks(spark, d).select("doc_id", text.alias("text")).select("doc_id", F.posexplode(segmentation.chunk_text(F.col("text"), 700)).alias("n", "c"))
    return held.select("doc_id", (F.col("n") + 1).alias("chunk_index"), F.col("c.body").alias("body"), "c.start_char", "c.end_char")


@query
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).select("doc_id", "chunk_index", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


@query
def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _chunked(spark, d).select("doc_id", "chunk_index", "start_char", "end_char")


def _pieces(spark: SparkSession, d: str, variant: str) -> DataFrame:
    rows = corpus.chunks(spark, d).select("doc_id", F.posexplode(segmentation.pieces(F.col("text"), variant)).alias("idx", "body"))
    return rows.select("doc_id", "idx", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


@query
def segments_variant_a(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, "a")


@query
def segments_variant_b(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, "b")


@query
def segments_variant_c(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, "c")


@query
def proportional_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(spark, d).select("doc_id", segmentation.pieces(F.col("text"), "b").alias("parts"))
    timed = rows.select("doc_id", F.posexplode(segmentation.proportional(F.col("parts"), F.lit(100))).alias("idx", "s"))
    return timed.select("doc_id", "idx", "s.start_ms", "s.end_ms")


@query
def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.overlapping(corpus.segments(spark, d), 400, 600, 80)


@query
def caption_cue_packing(spark: SparkSession, d: str) -> DataFrame:
    cue = F.struct("idx", "start_ms", (F.col("start_ms") + 4000).alias("end_ms"), F.col("text").alias("body"))
    grouped = corpus.segments(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(cue)).alias("cues"))
    rows = grouped.select("source", F.posexplode(segmentation.pack_cues(F.col("cues"), 400, 20_000)).alias("idx", "c"))
    return rows.select("source", "idx", "c.start_ms", "c.end_ms", F.length("c.body").alias("n_chars"))


@query
def oversized_cue_split(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.segments(spark, d).select("source", F.col("idx").alias("turn"), F.posexplode(segmentation.split_cue(F.col("text"), F.col("start_ms"), F.col("start_ms") + 4000, 50)).alias("idx", "c"))
    return rows.select("source", "turn", "idx", "c.start_ms", "c.end_ms", "c.body")


@query
def cue_clip_lead(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "events").select("user_id", "event_id", _millis("ts").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 3_600_000)
    return captions.clipped(rows, "user_id", "start_ms, event_id")


@query
def nearest_word_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Views as words, all other events as anchors."""
    rows = corpus.table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("idx"), _millis("ts").alias("start_ms"), "event_type")
    words = rows.where("event_type = 'view'").select("source", F.col("start_ms").alias("word_ms"))
    return segmentation.nearest(rows.where("event_type <> 'view'").drop("event_type"), words, 3_600_000)


def _started() -> Column:
    return F.col("doc_id") * 1000


@query
def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.sources(spark, d)
    label = citation_label(F.col("source_type"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("tree")), F.lit(None).cast("string"), F.col("title"), _started() * 7, F.lit(1))
    return rows.select("doc_id", label.alias("citation"))


@query
def timestamp_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.sources(spark, d)
    return rows.select("doc_id", timestamp_url(F.col("source_type"), F.col("url"), _started()).alias("link"), replace_time(F.concat("url", F.lit("#a")), _started()).alias("replaced"))


@query
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(spark, d)
    hits = keyword.search(rows.select("doc_id", "text"), QUERY, 8)
    packed = retrieval.context_pack(hits.select("doc_id", "score"), corpus.sources(spark, d), rows)
    return packed.withColumn("text", F.md5("text"))


@query
def resolve_source(spark: SparkSession, d: str) -> DataFrame:
    return summary.resolve(corpus.sources(spark, d), "document 10").select("source_id", "title", "match", "weight", "preference")


@query
def summary_context(spark: SparkSession, d: str) -> DataFrame:
    best = summary.resolve(corpus.sources(spark, d), "document 10")
    return summary.context(best, _chunked(spark, d), 5).select("doc_id", "title", "chunk_index", F.md5("body").alias("digest"))


@query
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "pages").select("page_id", clean_html_flat(F.col("html")).alias("flat"), clean_html_blocks(F.col("html")).alias("blocks"))
    return rows.select("page_id", F.length("flat").alias("n_flat"), F.md5("flat").alias("flat"), F.length("blocks").alias("n_blocks"), F.md5("blocks").alias("blocks"))


@query
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "pages").select("page_id", links(F.col("html")).alias("found"))
    return rows.select("page_id", F.size("found").alias("n"), F.array_join(F.array_sort("found"), " ").alias("found"))


@query
def url_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "pages").select("page_id", "url")
    return rows.select("page_id", classify_url(F.col("url")).alias("kind"), replace_time(F.col("url"), F.col("page_id") * 1500).alias("timed"))


@query
def slugify_titles(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "part").select("p_partkey", slugify(F.col("p_name")).alias("slug"))


@query
def durations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, "soon").when(n % 5 == 1, n.cast("string")).when(n % 5 == 2, F.concat_ws(":", n % 90, n % 60)).otherwise(F.concat_ws(":", n % 24, n % 60, n % 59))
    rows = corpus.table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", "raw", seconds_from_duration(F.col("raw")).alias("seconds"))


@query
def season_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 530
    return corpus.table(spark, d, "documents").select("doc_id", maintenance.upper_bound(n, BOUNDS).alias("season"))


@query
def job_log_recent(spark: SparkSession, d: str) -> DataFrame:
    return corpus.jobs(spark, d).orderBy(F.desc("created_at"), F.desc("job_id")).limit(50).select("job_id", "job_type", "owner")


@query
def job_status_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.jobs(spark, d).groupBy("job_type")
    return rows.agg(F.count("*").alias("jobs"), F.count_if(F.col("value") > 50).alias("large"), F.round(F.avg("value"), 6).alias("mean_value"))


@query
def list_sources(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sources(spark, d).orderBy(F.desc("doc_id")).limit(50).select("source_id", "title", "source_type")


@query
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "documents").where("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


@query
def reembed_diff(spark: SparkSession, d: str) -> DataFrame:
    stored = corpus.vectors(spark, d).select("doc_id", "vector")
    fresh = stored.where("doc_id % 10 <> 9").withColumn("vector", F.when(F.col("doc_id") % 3 == 0, F.reverse("vector")).otherwise(F.col("vector")))
    extra = stored.where("doc_id % 50 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    plan = vector.compare_stored(stored, fresh.unionByName(extra))
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("mean"), F.round(F.min("similarity"), 6).alias("least"))


@query
def index_drift(spark: SparkSession, d: str) -> DataFrame:
    ids = corpus.chunks(spark, d).select("doc_id")
    indexed = ids.where("doc_id % 7 <> 0").unionByName(ids.where("doc_id % 100 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id")))
    return maintenance.drift(ids, indexed)


@query
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.first_wins(corpus.table(spark, d, "conversations"), "conv_id", "turn")


@query
def anti_join_missing(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.missing(corpus.table(spark, d, "documents").select("doc_id", "lang"), corpus.table(spark, d, "labels"), ["doc_id"])


@query
def two_hop_lookup(spark: SparkSession, d: str) -> DataFrame:
    labels = corpus.table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.concat_ws("-", "quality", "toxic").alias("title"))
    names = spark.createDataFrame([("1-0", "good"), ("0-0", "poor")], "title string, target string")
    return maintenance.two_hops(corpus.table(spark, d, "documents").select(F.col("doc_id").alias("key")), labels, names)


@query
def queue_with_reasons(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    entries = corpus.table(spark, d, "pages").select(
        n.alias("position"),
        F.when(n % 11 != 0, F.concat(F.lit("v"), n % 97)).alias("video_id"),
        F.when(n % 17 == 0, " ").otherwise(F.concat(F.lit("Talk "), n)).alias("title"),
        ((n % 13) * 10).alias("duration"),
        (n % 7 != 0).alias("resolvable"),
    )
    return planning.queue(entries).select("position", "video_id", "reason", "queue_number")


@query
def tree_assignment(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    lists = F.when(n % 9 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array(F.concat(F.lit("p"), n % 6), F.concat(F.lit("p"), n % 4)))
    members = corpus.table(spark, d, "pages").select(n.alias("item"), F.explode(lists).alias("playlist"))
    return planning.assign_trees(members, F.broadcast(spark.createDataFrame(TREE_RULES, "playlist string, tree string, priority int")), "unsorted")


@query
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@query
def keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "documents").select("doc_id", "source", F.expr("doc_id div 100").alias("generation"))
    return maintenance.keep_generations(rows, 3, "source", "generation")


@query
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the batch run at ten; quality labels are grades for every query alike."""
    run = materialise(_batch(spark, d, 10), "eval-run")
    labels = corpus.table(spark, d, "labels").select("doc_id", F.col("quality").alias("grade"))
    grades = run.join(labels, "doc_id").select("query_id", "doc_id", "grade")
    rows = evaluation.metrics(run, grades, 10, labels)
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    tables = {"documents": corpus.chunks(spark, d), "embeddings": corpus.vectors(spark, d), "labels": corpus.table(spark, d, "labels")}
    left = maintenance.delete_sources(tables, corpus.chunks(spark, d).where("doc_id % 5 = 0"))
    parts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def preference_overlay(spark: SparkSession, d: str) -> DataFrame:
    new = corpus.table(spark, d, "documents").where("doc_id % 4 = 0").select("doc_id", F.lit(3.0).alias("weight"), F.lit("current").alias("preference"))
    return maintenance.with_preferences(corpus.sources(spark, d), new).groupBy("weight", "preference").agg(F.count("*").alias("n"))


@query
def ingest_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "documents").select(F.concat(F.lit("Document "), "doc_id").alias("title"), "text", F.lit(None).cast("string").alias("collection_id"))
    return ingest.notes(rows)["chunks"].select("title", "source_id", "language", "chunk_index", F.length("text").alias("n_chars"))


@query
def vtt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as VTT and parsed again."""
    stamp = F.concat(F.lit("00:"), F.lpad(F.expr("idx div 15").cast("string"), 2, "0"), F.lit(":"), F.lpad(((F.col("idx") % 15) * 4).cast("string"), 2, "0"))
    cue = F.concat(stamp, F.lit(".250 --> "), stamp, F.lit(".750\n"), F.regexp_replace("text", r"\s+", " "))
    rows = corpus.segments(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("idx", cue.alias("cue")))).alias("cues"))
    files = rows.select(F.col("source").alias("file"), F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda c: c["cue"]), "\n\n")).alias("content"))
    return captions.vtt(files).select("file", "idx", "start_ms", "end_ms")
