"""Queries of the import operators, metadata functions and stored indexes over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as meta
from ..operators import entities, importing, importloop, index, maintenance, planning, retrieval, segmentation, vector
from ..runtime import shared_dir, swept
from ..operators.blockindex import BlockIndex
from ..operators.reembed import Reembedding
from ..operators.replacing import ImportedSources
from ..sources import captions, corpus, feeds, readers
from .catalog import QUERY, QUERY_VECTOR, _vector_of, query


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return corpus.table(spark, d, "documents").select("doc_id", *columns)


@query
def fts_search(spark: SparkSession, d: str) -> DataFrame:
    """The stored index with the classic formula and global statistics."""
    path = f"{shared_dir(spark)}/keywords-{uuid.uuid4().hex}"
    swept(spark, path)
    index.build_keywords(corpus.chunks(spark, d), path)
    found = index.KeywordIndex(spark, path).search(f"{QUERY} the", formula="fts")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query
def index_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """The stored index over German sources, with statistics of these alone and weights."""
    path = f"{shared_dir(spark)}/keywords-{uuid.uuid4().hex}"
    swept(spark, path)
    index.build_keywords(corpus.chunks(spark, d), path)
    sources = corpus.sources(spark, d).where("language = 'de'").select("doc_id", "weight", "title")
    found = index.KeywordIndex(spark, path).search("der und ein von erly", sources=sources, scope="filtered")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query
def block_index_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """The index in segments after an append of one document in a hundred and a delete of another, with weights."""
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    swept(spark, path)
    rows = corpus.chunks(spark, d).join(corpus.sources(spark, d).select("doc_id", "title", "weight"), "doc_id")
    held = BlockIndex(spark, path)
    held.append(rows.where("doc_id % 100 <> 3"))
    held.append(rows.where("doc_id % 100 = 3"))
    held.delete(rows.select("doc_id").where("doc_id % 100 = 1"))
    return held.search(f"{QUERY} the").select("doc_id", F.round("score", 6).alias("score"))


@query
def block_index_filters(spark: SparkSession, d: str) -> DataFrame:
    """Bitmaps of tenant, language (or none), tree and entity before the ranks, statistics of what passes."""
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    swept(spark, path)
    entities = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array(F.concat(F.lit("odd-"), F.col("doc_id") % 5)))
    rows = corpus.chunks(spark, d).withColumn("tenant", F.concat(F.lit("t"), F.col("doc_id") % 3)).withColumn("entities", entities)
    held = BlockIndex(spark, path)
    held.append(rows)
    trees = [f"src{i}" for i in range(1, 20, 2)]
    kept = {"tenant": ["t0", "t1"], "language": ["de", None], "tree": trees, "entity": ["even", "odd-3"]}
    return held.search("der und ein von erly", 10, kept).select("doc_id", F.round("score", 6).alias("score"))


@query
def reembed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Counts by action of a re-embedding in ranges that is stopped after two of them and taken up again."""
    path = f"{shared_dir(spark)}/reembed-{uuid.uuid4().hex}"
    swept(spark, path)
    rows, n = corpus.vectors(spark, d).select("doc_id", "vector"), F.col("doc_id") % 5
    turned = F.when(n == 1, F.transform("vector", lambda x: -x)).otherwise(F.col("vector"))
    stored = rows.where(n != 2).select("doc_id", F.lit("m").alias("model"), turned.alias("vector"))
    stored = stored.unionByName(rows.where(n == 3).withColumn("model", F.lit("m"))).unionByName(rows.where(n == 4).withColumn("model", F.lit("old")))
    size = max(rows.count() // 6, 1)
    Reembedding(spark, path, rows, stored, "m", lambda part: part, size).run(2)
    again = Reembedding(spark, path, rows, stored, "m", lambda part: part, size)
    again.run()
    return again.counts()


@query
def replaced_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources after an import of all documents and one of a later version of every tenth, with what each import did."""
    path = f"{shared_dir(spark)}/imported-{uuid.uuid4().hex}"
    swept(spark, path)
    docs = corpus.table(spark, d, "documents").where(F.trim("text") != "").select(F.col("doc_id").cast("string").alias("guid"), F.col("source").alias("tree"), "text")
    held = ImportedSources(spark, path, ["guid", "tree"], 8)

    def part(rows: DataFrame, text) -> tuple[DataFrame, DataFrame]:
        return rows.select("guid", "tree", F.concat(F.lit("Document "), "guid").alias("title")), rows.select(F.col("guid").alias("item"), F.lit(1).alias("chunk_index"), text.alias("text"))

    later = docs.where(F.col("guid").cast("long") % 10 == 3)
    held.run(*part(docs.where(F.col("guid").cast("long") % 20 != 3), F.col("text")), 1, "first")
    done = held.run(*part(later, F.concat("text", F.lit(" (revised)"))), 2, "second")
    rows = held.sources().join(held.chunks(F.length("text").alias("n_chars")), "source_id").join(done, "item", "left")
    return rows.select("item", "version", F.coalesce("action", F.lit("left")).alias("action"), "n_chars")


@query
def import_loop_results(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an episode: done before, incomplete, without transcript, known, unreadable, silent, or imported; the loop ends at the 300th."""
    n = F.col("doc_id")
    rows = _docs(spark, d, "text").withColumn("vtt", F.concat(F.lit("WEBVTT\n\n00:01.000 --> 00:05.000\n"), F.trim(F.regexp_replace("text", r"[\t\n\x0B\f\r]\s*| \s+", " ")), F.lit("\n")))
    items = rows.select(
        n.alias("position"), F.concat(F.lit("g"), n).alias("guid"), F.concat(F.lit("T"), n % 601).alias("title"), F.concat(F.lit("u"), n * 7 % 701).alias("url"),
        F.when(n % 13 > 0, "t.vtt").alias("transcript_url"), F.when(n % 19 == 0, "statistics not complete").alias("incomplete"),
    )
    state = rows.where(n % 5 == 1).select(F.concat(F.lit("g"), n).alias("guid"), F.when(n % 10 == 1, "imported").otherwise("error").alias("status"))
    known = rows.where(n % 17 == 3).select(F.concat(F.lit("s"), n).alias("source_id"), F.concat(F.lit("T"), n).alias("title"), F.concat(F.lit("u"), n + 350).alias("url"))
    again = F.when(n % 2 == 0, F.concat("vtt", F.lit("\n00:05.000 --> 00:09.000\nand so on\n"))).otherwise(F.col("vtt"))
    content = F.when(n % 11 == 2, None).when(n % 11 == 5, "WEBVTT\n").otherwise(again)
    contents = rows.select(F.concat(F.lit("g"), n).alias("guid"), content.alias("content"), F.lit("t.vtt").alias("url"), F.lit(None).cast("string").alias("mime"), F.lit(60).alias("seconds"))
    found = importloop.import_loop(items, state, known, importloop.read_transcripts(contents), "Show", limit=300)
    return found.results.select("position", "guid", "status", "reason", F.col("source_id").isNotNull().alias("has_source"), "n_segments")


@query
def bundle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents and labels through a bundle whose files are hashed and checked: rows and a sum by table."""
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    swept(spark, path)
    maintenance.export_bundle({n: corpus.table(spark, d, n) for n in ("documents", "labels")}, path)
    back = maintenance.import_bundle(spark, path)
    told = maintenance.inspect_bundle(spark, path).select(F.col("table").alias("name"), "rows", "columns")
    sums = back["documents"].agg(F.sum(F.length("text")).alias("total")).withColumn("name", F.lit("documents"))
    sums = sums.unionByName(back["labels"].agg(F.sum("doc_id").alias("total")).withColumn("name", F.lit("labels")))
    return told.join(sums, "name")


@query
def caption_folder(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as caption files, fifty to a file, and read back by the data source."""
    path = f"{shared_dir(spark)}/captions-{uuid.uuid4().hex}"
    swept(spark, path)
    at = F.col("turn") * 4
    time = F.concat(F.lpad(F.floor(at / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((at % 60).cast("string"), 2, "0"))
    rows = corpus.table(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL").withColumn("folder", F.expr("conv_id DIV 50"))
    block = F.concat(time, F.lit(".000 --> "), time, F.lit(".900\n"), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("\n"))
    ordered = rows.repartition("folder").sortWithinPartitions("folder", "conv_id", "turn", "role", "text")
    ordered.select("folder", block.alias("value")).write.partitionBy("folder").text(path)
    found = readers.units(spark, path, "vtt", ending=".txt")
    cues = readers.vtt_cues(found).unionByName(readers.errors(found).select("file", F.lit(0).alias("idx"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.col("error").alias("body")))
    return cues.select(F.regexp_extract("file", r"folder=(\d+)", 1).cast("long").alias("folder"), "idx", "start_ms", F.length("body").alias("n_chars"))


@query
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/units-{uuid.uuid4().hex}"
    swept(spark, path)
    index.build_vectors(corpus.vectors(spark, d).select("doc_id", "vector"), path)
    return index.VectorIndex(spark, path).search(_vector_of(spark, d, QUERY_VECTOR)).select("doc_id", F.round("score", 6).alias("score"))


@query
def vector_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of every vector whose id is divisible by 100."""
    path = f"{shared_dir(spark)}/units-{uuid.uuid4().hex}"
    swept(spark, path)
    rows = corpus.vectors(spark, d).select("doc_id", "vector")
    index.build_vectors(rows, path)
    asked = rows.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return index.VectorIndex(spark, path).search_many(asked, 3).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def vector_decode(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stored as JSON text, every seventh unreadable."""
    raw = F.when(F.col("doc_id") % 7 == 0, "none").otherwise(F.to_json("vector"))
    rows = corpus.vectors(spark, d).select("doc_id", meta.decode_vector(raw, "json").alias("v"))
    return rows.select("doc_id", F.size("v").alias("dims"), F.round(F.expr("aggregate(v, 0D, (a, x) -> a + x)"), 4).alias("total"))


@query
def corpus_version(spark: SparkSession, d: str) -> DataFrame:
    return index.version(corpus.table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id")


@query
def json_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights that only JSON numbers set, and a text beside them."""
    n = F.col("doc_id") % 5
    raw = F.when(n == 0, '{"retrieval_weight": 2}').when(n == 1, '{"retrieval_weight": "2.0"}').when(n == 2, '{"retrieval_weight": -1}').when(n == 3, '{"retrieval_weight": 1.5, "tree": "x"}').otherwise("no json")
    return _docs(spark, d).select("doc_id", meta.json_number_weight(raw).alias("weight"), meta.json_text(raw, "tree").alias("tree"))


@query
def normalized_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d, "text").select("doc_id", meta.normalize_title(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query
def title_versions(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("Show "), F.col("doc_id") % 1200 - 3, F.when(F.col("doc_id") % 4 == 0, "b").otherwise(""), F.when(F.col("doc_id") % 3 == 0, ": Legacy").when(F.col("doc_id") % 3 == 1, " (current)").otherwise(""))
    return _docs(spark, d).select("doc_id", meta.version_metadata(title, "Show").alias("m")).select("doc_id", "m.*")


@query
def document_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors whose label holds ``th``, or whose target does, as documents' links."""
    rows = corpus.table(spark, d, "pages").select("page_id", meta.document_links(F.col("html"), "th", ".pdf").alias("found"))
    return rows.select("page_id", F.size("found").alias("n"), F.array_join("found", " ").alias("found"))


@query
def versioned_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that speak of ``th``, as legacy ones where the text around has ``and``."""
    rows = corpus.table(spark, d, "pages").select("page_id", F.posexplode(meta.versioned_links(F.col("html"), "/", "th", 300, 200, "and")).alias("n", "link"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), "link.version", "link.url")


@query
def episode_pages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    link = F.when(n % 4 == 0, F.concat(F.lit("https://example.org/"), n)).when(n % 4 == 1, "")
    transcripts = F.when(n % 4 == 1, F.array(F.lit("https://example.org/x.vtt"), F.concat(F.lit("https://www.buzzsprout.com/11/"), n, F.lit("/transcript.vtt"))))
    audio = F.when(n % 4 == 2, F.concat(F.lit("https://www.buzzsprout.com/11/episodes/"), n, F.lit("-a.mp3")))
    return _docs(spark, d).select("doc_id", meta.episode_url(link, transcripts, audio).alias("url"))


@query
def tree_and_time_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    rows = _docs(spark, d, "source").select(
        "doc_id", meta.tree_metadata(F.concat(F.lit("The "), F.upper("source"), F.lit("! Show"))).alias("t"),
        meta.timestamp_metadata(F.when(n % 2 == 0, "published_transcript").otherwise("generated_model")).alias("m"),
    )
    return rows.select("doc_id", "t.*", "m.*")


@query
def chronological_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Events by mail dates, numbered for each user from the earliest; unreadable dates come last."""
    stamp = F.date_format(F.expr("cast(ts AS timestamp_ntz)"), "dd MMM yyyy HH:mm:ss")
    raw = F.when(F.col("event_id") % 9 == 0, "some day").otherwise(F.concat(F.lit("Mon, "), stamp, F.lit(" +0000")))
    rows = corpus.table(spark, d, "events").select("event_id", "user_id", meta.date_key(raw).alias("date_key"))
    return rows.withColumn("number", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY date_key, event_id)"))


@query
def glossaries(spark: SparkSession, d: str) -> DataFrame:
    titles = _docs(spark, d, "source").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat(F.lit("Part "), F.col("doc_id") % 40, F.lit(": text")).alias("t")))).alias("rows"))
    return titles.select("source", meta.glossary(F.transform("rows", lambda r: r["t"]), r"^Part (\d+):", "Part ", ["Extra"], 30).alias("glossary"))


@query
def sentence_ends(spark: SparkSession, d: str) -> DataFrame:
    """Turns that end as sentences do, by what is put behind them: quotes of both kinds, white space, commas, nothing."""
    kind = ((F.col("source") + F.col("idx")) % 9).cast("int")
    behind = F.element_at(F.array(*[F.lit(x) for x in ("", '?"', ".\u201d", " and", "'", "! \n ", ",", "\u201d", " \n")]), kind + 1)
    rows = corpus.segments(spark, d).select(kind.alias("kind"), segmentation.ends_sentence(F.concat("text", behind)).alias("ends"))
    return rows.groupBy("kind", "ends").agg(F.count("*").alias("n"))


@query
def serialized_jobs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.jobs(spark, d).select("job_id", F.to_json(F.struct("job_id", "job_type", "owner")).alias("json"))


@query
def stale_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.table(spark, d, "pages").where(importing.any_part(F.col("url"), ["/en/1", "?page=", ".org/de"]))
    return rows.select("page_id", "url")


@query
def caption_identities(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    video = F.when(n % 10 == 0, "short").otherwise(F.concat(F.lit("v"), F.lpad(n.cast("string"), 10, "0")))
    guid = F.when(n % 7 == 0, F.lit("other")).otherwise(F.concat(F.lit("youtube-"), video))
    url = F.concat(F.when(n % 6 == 0, "http").otherwise("https"), F.lit("://www.youtube.com/watch?v="), video)
    tree = F.when(n % 11 == 0, "Bad Tree").otherwise("tree-a")
    return corpus.table(spark, d, "pages").select("page_id", importing.safe_item(tree, video, guid, url).alias("problem"))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed for each source with an item for each document."""
    n = F.col("doc_id").cast("string")
    parts = [
        F.concat(F.lit("<item><title>"), n, F.lit(": Talk &amp; more</title><guid>g-"), n, F.lit("</guid>")),
        F.concat(F.lit("<link>https://example.org/"), n, F.lit("</link><itunes:duration>1:0"), F.col("doc_id") % 10, F.lit("</itunes:duration>")),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<podcast:transcript url="https://example.org/t.txt" type="text/plain"/><podcast:transcript url="https://example.org/t.srt" type="text/srt"/>'))).otherwise(""),
        F.lit("</item>"),
    ]
    items = _docs(spark, d, "source").groupBy(F.col("source").alias("feed")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat(*parts).alias("xml")))).alias("items"))
    head = '<?xml version="1.0"?><rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:podcast="https://podcastindex.org/namespace/1.0"><channel><title>'
    return items.select("feed", F.concat(F.lit(head), "feed", F.lit("</title>"), F.array_join(F.transform("items", lambda x: x["xml"]), ""), F.lit("</channel></rss>")).alias("content"))


@query
def feed_episodes(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.show_episodes(feeds.episodes(_feed(spark, d)))
    return rows.select("feed", "idx", "title", "guid", "link", "seconds", "number", "episode_title", F.size("transcripts").alias("transcripts"))


@query
def feed_transcripts(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.with_transcripts(feeds.episodes(_feed(spark, d)))
    return rows.select("guid", F.col("transcripts")[0]["type"].alias("kind"), F.col("transcripts")[0]["url"].alias("url"))


@query
def feed_guids(spark: SparkSession, d: str) -> DataFrame:
    return feeds.guid_titles(_feed(spark, d)).select("feed", "guid", "title")


@query
def vtt_line_machine(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as captions without blank lines, with cue numbers and notes, parsed again."""
    time = F.concat(F.lit("00:"), F.lpad(F.expr("idx div 15").cast("string"), 2, "0"), F.lit(":"), F.lpad(((F.col("idx") % 15) * 4).cast("string"), 2, "0"))
    cue = F.concat(F.col("idx").cast("string"), F.lit("\n"), time, F.lit(".250 --> "), time, F.lit(".750\n<b>"), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("</b>"), F.when(F.col("idx") % 3 == 0, "\nNOTE aside").otherwise(""))
    rows = corpus.segments(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("idx", cue.alias("cue")))).alias("cues"))
    files = rows.select(F.col("source").alias("file"), F.concat(F.lit("WEBVTT\n"), F.array_join(F.transform("cues", lambda c: c["cue"]), "\n")).alias("content"))
    return captions.vtt_lines(files).select("file", "idx", "start_ms", "end_ms", F.length("body").alias("n_chars"))


@query
def source_configs(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(
        F.col("doc_id").alias("position"), F.concat(F.lit("Name "), "doc_id").alias("name"), F.concat(F.lit("s-"), F.col("doc_id") % 50).alias("slug"),
        F.lit(None).cast("string").alias("feed_url"), F.concat(F.lit("https://example.org/"), "doc_id").alias("url"),
    )
    return importing.source_config(rows, "s-7").unionByName(importing.source_config(rows, "Name 3"))


@query
def manifest_contract(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("doc_id") + 1
    rows = _docs(spark, d).select(
        p.alias("position"), F.when(p % 13 == 0, p + 1).otherwise(p).alias("queue_number"),
        F.concat(F.lit("q"), F.when(p > 999, p.cast("string")).otherwise(F.lpad(p.cast("string"), 3, "0")), F.when(p % 17 == 0, F.lit("_x")).otherwise(F.lit("-x"))).alias("artifact_stem"),
        F.when(p % 19 == 0, " ").otherwise(F.concat(F.lit("g"), F.when(p % 23 == 0, F.lit(0)).otherwise(p))).alias("guid"), F.when(p % 29 == 0, "").otherwise("t").alias("title"),
    )
    return importing.manifest_problems(rows, ["title"])


@query
def artifact_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Three artifacts for every page, in several ways not as they should be."""
    n = F.col("page_id")
    items = corpus.table(spark, d, "pages").select(F.concat(F.lit("s"), n).alias("stem"), n.alias("queue_number"), F.lit("m").alias("model"), n.alias("n"))
    raw = items.where("n % 11 <> 0").select("stem", F.when(F.col("n") % 5 == 0, '{"segments": []}').when(F.col("n") % 7 == 0, '{"segments": [{"text": "a"}]}').otherwise('{"segments": [{"text": "a", "words": [{"start": 0.5}]}]}').alias("content"))
    chunked = items.select("stem", F.when(F.col("n") % 13 == 0, '[{"text": " ", "metadata": {"start": "000"}}]').when(F.col("n") % 17 == 0, '[{"text": "a", "metadata": {}}]').otherwise('[{"text": "a", "metadata": {"start": "000"}}]').alias("content"))
    stats = items.select("stem", F.concat(F.lit('{"complete": '), F.when(F.col("n") % 19 == 0, "false").otherwise("true"), F.lit(', "queue_number": '), F.when(F.col("n") % 23 == 0, F.lit(-1)).otherwise(F.col("n")), F.lit(', "model": "m"}')).alias("content"))
    checked = importing.checked_triplets(items, raw, chunked, stats, ["queue_number", "model"])
    known = items.where("n % 2 = 0").select("stem")
    return importing.artifact_status(items.select("stem"), checked, known)


@query
def import_actions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    rows = _docs(spark, d).select(n.alias("position"), F.concat(F.lit("g"), n).alias("guid"), F.concat(F.lit("T"), n).alias("title"), F.concat(F.lit("u"), n).alias("url"), F.when(n % 3 > 0, "t").alias("transcript_url"))
    state = rows.where("position % 10 = 1").select("guid", F.when(F.col("position") % 20 == 1, "imported").otherwise("error").alias("status"))
    known = rows.where("position % 4 = 2").select("title", F.lit(None).cast("string").alias("url")).unionByName(rows.where("position % 14 = 5").select(F.lit("other").alias("title"), "url"))
    return importing.import_plan(rows, state, known, 40)


@query
def caption_statuses(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    items = _docs(spark, d).select(n.alias("guid"), F.when(n % 9 > 0, F.concat(F.lit("c"), n)).alias("caption_path"))
    files = items.where("guid % 5 > 0").select("caption_path", (F.col("guid") % 4).alias("chunks"))
    held = items.where("guid % 3 = 0").select("guid", (F.col("guid") % 2 + 1).alias("version"))
    return importing.caption_status(items, files, held.unionByName(held.where("guid % 21 = 0")))


@query
def source_owners(spark: SparkSession, d: str) -> DataFrame:
    held = corpus.sources(spark, d).select("source_id", "title", "tree", "language")
    incoming = held.where("language = 'en'").select("title", F.when(F.col("tree") == "src1", "elsewhere").otherwise(F.col("tree")).alias("tree"), "language")
    return importing.owned(incoming, held, ["title", "tree", "language"])


@query
def rekeyed_state(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d, "lang").select(F.concat(F.lit("g"), "doc_id").alias("guid"), F.col("lang").alias("status"), F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 6 > 0, F.col("doc_id") % 97).alias("episode"))
    return importing.rekeyed(rows, "episode")


@query
def applied_results(spark: SparkSession, d: str) -> DataFrame:
    state = _docs(spark, d).select(F.col("doc_id").alias("episode"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("source_id"))
    results = corpus.table(spark, d, "labels").select(F.col("doc_id").alias("episode"), F.when(F.col("toxic") == 1, "error").otherwise("imported").alias("status"), F.concat(F.lit("s"), "doc_id").alias("source_id"))
    return importing.applied(state, results)


@query
def generated_without_published(spark: SparkSession, d: str) -> DataFrame:
    generated = _docs(spark, d, "lang").select(F.col("doc_id").alias("episode"), "lang")
    published = corpus.sources(spark, d).select(F.col("doc_id").alias("episode"), "preference")
    return importing.without_published(generated, published)


@query
def patched_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d, "lang", "source").select(F.col("doc_id").alias("source_id"), F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.col("source")).alias("metadata"))
    patches = rows.where("source_id % 2 = 0").select("source_id", F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("more")).alias("patch"))
    both = importing.patched(rows, patches).select("source_id", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in "abc"])
    kept = importing.patched(rows, patches, keep=True).select("source_id", F.try_element_at("metadata", F.lit("b")).alias("kept_b"))
    return both.join(kept, "source_id")


@query
def inferred_trees(spark: SparkSession, d: str) -> DataFrame:
    rules = [("tree-a", "Document 1", "Show A"), ("tree-b", "Document 2", "Show B")]
    show = F.when(F.col("doc_id") % 5 == 0, "Show B")
    tree = importing.inferred_tree(F.col("title"), show, F.when(F.col("doc_id") % 7 == 0, "tree-b").when(F.col("doc_id") % 7 == 1, "unknown"), rules)
    return corpus.sources(spark, d).select("doc_id", tree.alias("tree"))


@query
def known_corpus(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    rows = corpus.sources(spark, d).select(
        F.when(n % 2 == 0, F.concat(F.lit("https://youtu.be/"), F.lpad(n.cast("string"), 11, "x"))).alias("url"), F.when(n % 3 == 0, F.concat(F.lit("youtube-"), F.lpad((n % 1000).cast("string"), 11, "y"))).alias("guid"),
        F.concat(F.lit("Show: Talk "), n % 100, F.lit(" (Generated Transcript)")).alias("title"), F.when(n % 200 > 20, F.col("tree")).alias("tree"), n.alias("position"),
    )
    ids, titles = importing.corpus_state(rows)
    return ids.select(F.lit("video").alias("kind"), F.col("video_id").alias("name"), F.lit(None).cast("string").alias("tree")).unionByName(titles.select(F.lit("title").alias("kind"), F.col("title").alias("name"), "tree"))


@query
def merged_tabs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    a = _docs(spark, d).select(F.lit("videos").alias("listing"), F.lit(1).alias("listing_order"), n.alias("position"), F.when(n % 50 > 0, F.concat(F.lit("v"), n % 300)).alias("item"), F.concat(F.lit("A"), n).alias("title"))
    b = _docs(spark, d).where("doc_id % 3 = 0").select(F.lit("shorts").alias("listing"), F.lit(2).alias("listing_order"), n.alias("position"), F.concat(F.lit("v"), n % 400).alias("item"), F.concat(F.lit("B"), n).alias("title"))
    merged = importing.merged_listings(a.unionByName(b))
    return merged.select("item", "title", "listing_order", "position", F.array_join("listings", ",").alias("listings"))


@query
def inverted_playlists(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d, "source").select(F.col("source").alias("playlist"), (F.col("doc_id") % 61).alias("video"))
    return importing.inverted(rows, "playlist", "video").select("video", F.array_join("playlists", ",").alias("playlists"))


@query
def offset_slice(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d, "lang").orderBy("doc_id").offset(20).limit(30)


@query
def keyset_pages(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 25 rows by key."""
    rows = _docs(spark, d, "lang")
    last = importing.page_after(rows, "doc_id", None, 25).agg(F.max("doc_id")).first()[0]
    return importing.page_after(rows, "doc_id", last, 25)


@query
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which required fields a metadata object lacks."""
    have = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("guid"), F.lit("title"))).otherwise(F.array(F.lit("title"), F.col("lang")))
    need = F.array(F.lit("guid"), F.lit("title"), F.lit("url"))
    return _docs(spark, d, "lang").select("doc_id", F.array_join(F.array_except(need, have), ",").alias("missing"))


@query
def entity_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d, "source", "lang").select(F.when(F.col("lang") == "en", "person").otherwise("organization").alias("entity_type"), F.col("source").alias("slug"), F.upper("source").alias("label")).distinct()
    return entities.listed(rows)


@query
def episode_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    name = F.concat(F.when(n % 5 == 0, "x").otherwise("e"), n, F.lit("-oai-raw"), F.when(n % 2 == 0, "-chunked").otherwise(""), F.lit(".json"))
    folder = F.when(n % 3 == 0, F.concat(F.lit("show-"), F.lpad((n % 1000).cast("string"), 3, "0"))).when(n % 3 == 1, F.concat(n, F.lit("a"))).otherwise("other-1")
    return _docs(spark, d).select("doc_id", meta.episode_key(name).alias("raw"), meta.item_episode(folder, "show").alias("item"))


@query
def rewritten_paths(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.struct(F.concat(F.lit("data/in/"), "source", F.lit("/pdf/d"), "doc_id", F.lit(".pdf")).alias("path"), F.lit("data/in/x").alias("other")))
    return _docs(spark, d, "source").select("doc_id", meta.rewrite_paths(raw, [(r"data/in/([^/\"]+)/pdf/([^\"]+)\.pdf", "artifacts://$1/items/$2/source.pdf")]).alias("json"))


@query
def exported_transcripts(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("idx") % 4 == 3, "  ").otherwise(F.col("text"))
    rows = corpus.segments(spark, d).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", (F.col("start_ms") + 4000).alias("end_ms"), text.alias("text")))).alias("s"))
    numbered, plain = importing.transcript_export(F.col("s"))
    return rows.select("source", F.size(numbered).alias("segments"), F.element_at(numbered, -1)["segment_index"].alias("last_index"), F.md5(plain).alias("digest"))


@query
def reembedded(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors after a re-embedding that turned every third, with rows of another model pruned."""
    stored = corpus.vectors(spark, d).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "old").otherwise("m").alias("model"), "vector")
    fresh = stored.where("doc_id % 11 <> 5").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.reverse("vector")).otherwise(F.col("vector")).alias("vector"))
    rows = vector.applied_plan(stored, fresh, "m", prune=True)
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum(F.col("vector")[0].cast("double")), 4).alias("first"))


@query
def missing_identities(spark: SparkSession, d: str) -> DataFrame:
    """Users of events that are not among the customers but for every seventh, each once."""
    users = corpus.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return maintenance.missing(users, corpus.table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id")), ["id"])


@query
def resume_points(spark: SparkSession, d: str) -> DataFrame:
    state = _docs(spark, d).select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") < 17, "imported").when(F.col("doc_id") % 2 == 0, "skipped").otherwise("queued").alias("status"))
    return planning.resume_point(state)


@query
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search among the sources of two entities, one name unknown."""
    rows = corpus.chunks(spark, d)
    links = rows.select("doc_id", F.col("tree").alias("slug"))
    found = retrieval.search(rows, corpus.vectors(spark, d), [(QUERY, [])], "keyword", entities=["src3", "src5", "nobody"], links=links)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query
def tenant_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search of one tenant; languages stand for tenants."""
    rows = corpus.chunks(spark, d).withColumn("tenant_id", F.col("language"))
    found = retrieval.search(rows, corpus.vectors(spark, d), [(QUERY, [])], "keyword", tenant="en")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query
def jobs_of_owner(spark: SparkSession, d: str) -> DataFrame:
    return corpus.jobs(spark, d).where("owner = 7").orderBy(F.desc("created_at"), F.desc("job_id")).limit(10).select("job_id", "job_type")


@query
def item_metadata(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "auto_caption").when(F.col("doc_id") % 3 == 1, "published_current").otherwise("other")
    return _docs(spark, d, "source").select("doc_id", importing.item_metadata(kind, source_tree_slug=F.col("source"), guid=F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("g"), "doc_id"))).alias("json"))


@query
def manifest_defaults(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d, "source").select("doc_id", F.col("source").alias("slug"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("Show").alias("show_title"), F.lit(None).cast("string").alias("publisher"), F.when(F.col("doc_id") % 3 == 0, "A").alias("author"))
    return importing.with_defaults(rows, {"show_title": F.col("slug"), "publisher": F.concat(F.col("show_title"), F.lit(" Press")), "author": F.col("publisher")})


@query
def transcript_kinds(spark: SparkSession, d: str) -> DataFrame:
    mime = F.when(F.col("page_id") % 4 == 0, "text/VTT").when(F.col("page_id") % 4 == 1, "application/x-subrip").when(F.col("page_id") % 4 == 2, "application/json")
    return corpus.table(spark, d, "pages").select("page_id", importing.transcript_kind(F.col("url"), mime).alias("kind"))


@query
def batch_locations(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d, "source").select("source").distinct()
    return rows.select("source", importing.batch_locations(F.col("source"), "channel").alias("b")).select("source", "b.*")


@query
def backup_generations(spark: SparkSession, d: str) -> DataFrame:
    """The two newest backups of each source by names with and without fractions of a second."""
    name = F.concat(F.lit("b-20240102T"), F.lpad((F.col("doc_id") % 1000000).cast("string"), 6, "0"), F.when(F.col("doc_id") % 2 == 0, ".5").otherwise(""), F.lit("Z.tar"))
    rows = _docs(spark, d, "source").select("doc_id", "source", maintenance.generation_key(name).alias("generation"))
    return maintenance.keep_generations(rows, 2, "source", "generation").where("kept").select("doc_id", "source", "generation")
