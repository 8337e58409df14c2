"""Importing: what a listing holds, what is known already, what to do with each item and why.

Every plan is a DataFrame with an action or status column, made by joins and ordered
conditions, so that it can be looked at before anything is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import normalize_title

#: Statuses after which an item is not looked at again.
TERMINAL = ("imported", "skipped_existing", "missing_transcript")

#: File names that say what they hold.
KINDS = {
    "source.json": "source_metadata_json",
    "source-tree.json": "source_tree_json",
    "transcript.txt": "transcript_text",
    "transcript.normalized.json": "transcript_normalized_json",
    "import-payload.json": "payload_json",
    "transcript.raw.json": "payload_json",
    "transcript.source.txt": "transcript_source_txt",
    "transcript.source.pdf": "transcript_source_pdf",
    "source-page.html": "source_page_html",
}

#: Files of operating systems that no inventory lists.
CRUFT = (".DS_Store", "Thumbs.db", ".localized")


def source_config(configs: DataFrame, wanted: str) -> DataFrame:
    """The one configuration whose name or slug is ``wanted``, the first by position; it must have a feed_url or url."""
    row = configs.where((F.col("name") == wanted) | (F.col("slug") == wanted)).orderBy("position").limit(1)
    fail = F.raise_error(F.lit(f"source {wanted!r} has neither feed_url nor url")).cast("string")
    return row.withColumn("address", F.coalesce("feed_url", "url", fail))


def manifest_problems(items: DataFrame, required: list[str]) -> DataFrame:
    """(position, problem) of manifest items that break the contract, by the first rule that they break.

    ``items``: position (from 1), queue_number, artifact_stem, guid and the ``required`` texts.
    Numbers are contiguous, stems are safe and begin with their number, identities are unique.
    """
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in required])
    again = {c: F.count("*").over(_by(c)) > 1 for c in ("guid", "artifact_stem")}
    stem = F.concat(F.lit("q"), F.when(F.col("position") > 999, F.col("position").cast("string")).otherwise(F.lpad(F.col("position").cast("string"), 3, "0")), F.lit("-"))
    problem = (
        F.when(~F.col("queue_number").eqNullSafe(F.col("position")), "queue_number")
        .when(~F.coalesce(F.col("artifact_stem").rlike(r"^[a-z0-9][a-z0-9-]*$"), F.lit(False)) | ~F.startswith("artifact_stem", stem), "artifact_stem")
        .when(F.coalesce(F.trim("guid"), F.lit("")) == "", "guid")
        .when(again["guid"] | again["artifact_stem"], "duplicate")
        .when(blank, "missing_text")
    )
    return items.withColumn("problem", problem).where("problem IS NOT NULL").select("position", "problem")


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def checked_triplets(items: DataFrame, raw: DataFrame, chunked: DataFrame, stats: DataFrame, expected: list[str]) -> DataFrame:
    """(stem, complete, reason): do an item's three artifacts (stem, content as JSON) agree with it?

    Reasons, in order: a missing or unreadable artifact, no segments, no chunks, statistics not
    complete, values of ``expected`` that differ, no word times, an empty chunk, a chunk
    without an anchor.
    """
    joined = items
    for name, rows in (("raw", raw), ("chunked", chunked), ("stats", stats)):
        joined = joined.join(rows.select("stem", F.col("content").alias(name)), "stem", "left")
    kinds = "segments array<struct<text:string,words:array<struct<start:double>>>>"
    r = F.from_json("raw", kinds)
    c = F.from_json("chunked", "array<struct<text:string,metadata:map<string,string>>>")
    s = F.from_json("stats", "map<string,string>")
    unread = reduce(lambda a, b: a | b, [F.try_parse_json(F.col(x)).isNull() for x in ("raw", "chunked", "stats")])
    differ = F.filter(
        F.array(*[F.when(~s[k].eqNullSafe(F.col(k).cast("string")), F.lit(k)) for k in expected]), lambda x: x.isNotNull()
    )
    reason = (
        F.when(unread, "missing or invalid artifact")
        .when(F.coalesce(F.size(r["segments"]), F.lit(0)) < 1, "no segments")
        .when(F.coalesce(F.size(c), F.lit(0)) < 1, "no chunks")
        .when(~F.coalesce(s["complete"] == "true", F.lit(False)), "statistics not complete")
        .when(F.size(differ) > 0, F.concat(F.lit("mismatch: "), F.array_join(differ, ", ")))
        .when(F.get(F.get(r["segments"], F.lit(0))["words"], F.lit(0))["start"].isNull(), "no word times")
        .when(F.exists(c, lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) == ""), "an empty chunk")
        .when(F.exists(c, lambda x: ~F.coalesce(F.map_contains_key(x["metadata"], F.lit("start")), F.lit(False))), "no chunk anchors")
        .otherwise("complete")
    )
    return joined.select("stem", (reason == "complete").alias("complete"), reason.alias("reason"))


def artifact_kind(name: Column) -> Column:
    """What a file holds, by its name."""
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(
        F.try_element_at(known, name),
        F.when(name.rlike(r"oai-raw-chunked\.json$"), "oai_raw_chunked_json").when(name.rlike(r"oai-raw\.json$"), "oai_raw_json").when(name.rlike(r"transcribe-stats\.json$"), "transcribe_stats_json"),
        F.lit("other"),
    )


def inventory(spark: SparkSession, root: str, hashed: bool = True) -> DataFrame:
    """(path, tree, item, name, kind, bytes, sha256) of all files under a folder of source trees.

    Contents are hashed where they lie, a file a row; without ``hashed`` only listings are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    rest = F.regexp_replace(F.expr("regexp_replace(path, '^[a-z0-9]+:/*', '')"), F.concat(F.lit("^"), base, F.lit("/")), F.lit(""))
    parts = F.split(rest, "/")
    name = F.element_at(parts, -1)
    rows = files.where(~name.isin(*CRUFT) & ~F.startswith(name, F.lit("._")))
    return rows.select(
        rest.alias("path"), parts[0].alias("tree"), F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(1)) == "items"), F.get(parts, F.lit(2))).alias("item"),
        name.alias("name"), artifact_kind(name).alias("kind"), F.col("length").alias("bytes"), (F.sha2("content", 256) if hashed else F.lit(None).cast("string")).alias("sha256"),
    )


def missing_child(files: DataFrame, name: str) -> DataFrame:
    """(tree) of trees that lack a file of that name at their top, in order."""
    have = files.where((F.col("name") == name) & (F.col("path") == F.concat_ws("/", "tree", "name"))).select("tree")
    return files.select("tree").distinct().join(have, "tree", "left_anti").orderBy("tree")


def guarded(new: DataFrame, existing: int, force: bool = False) -> DataFrame:
    """``new`` manifest records, unless they are none and would replace some: that is an error."""
    if not force and existing > 0 and new.isEmpty():
        raise ValueError(f"an empty manifest would replace one of {existing} records")
    return new


def merged_listings(entries: DataFrame) -> DataFrame:
    """One row an item of several listings (listing, listing_order, position, item, title), with the listings it is in.

    The first listing's title wins; items keep the order of their first place.  Entries without an
    item stand alone.
    """
    at = F.struct("listing_order", "position")
    known = entries.where("item IS NOT NULL").groupBy("item").agg(
        F.min_by("title", at).alias("title"), F.min(at).alias("first"), F.array_sort(F.collect_set(F.struct("listing_order", "listing"))).alias("in")
    )
    alone = entries.where("item IS NULL").select("item", "title", at.alias("first"), F.array(F.struct("listing_order", "listing")).alias("in"))
    rows = known.unionByName(alone)
    return rows.select("item", "title", "first.listing_order", "first.position", F.transform("in", lambda x: x["listing"]).alias("listings"))


def inverted(members: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): from key -> values to value -> keys, in order."""
    return members.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias(f"{key}s"))


def corpus_state(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a corpus has already: (video_id), and (title, tree) of its normalised titles, the first source's tree.

    ``sources``: url, guid, title, tree, position.  Video ids come from URLs and from guids
    ``youtube-...``; titles lose a show before a colon and a version in parentheses.
    """
    by_url = F.nullif(F.regexp_extract("url", r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))
    by_guid = F.nullif(F.regexp_extract("guid", r"^youtube-(.*)$", 1), F.lit(""))
    ids = sources.select(F.explode(F.array(by_url, by_guid)).alias("video_id")).where("video_id IS NOT NULL").distinct()
    bare = F.regexp_replace("title", r"^[^:]+:\s*", "")
    bare = F.regexp_replace(bare, r"\s*\((Generated|Published|Current|Legacy)[^)]*\)\s*$", "")
    named = sources.select(normalize_title(bare).alias("title"), "tree", "position")
    return ids, named.groupBy("title").agg(F.coalesce(F.min_by("tree", "position"), F.lit("(no tree)")).alias("tree"))


def import_plan(episodes: DataFrame, state: DataFrame, known: DataFrame, limit: int | None = None) -> DataFrame:
    """(position, guid, action) for every episode: skip_terminal, missing_transcript, skip_existing, import or later.

    ``episodes``: position, guid, title, url, transcript_url; ``state``: guid, status;
    ``known``: title, url of sources.  With a limit, the first so many that are not skipped as
    done or without a transcript are handled, present ones included; the others wait.
    """
    seen = state.select("guid", F.col("status").alias("old")).dropDuplicates(["guid"])
    titles = known.select("title", F.lit(True).alias("by_title")).distinct()
    urls = known.where("url IS NOT NULL AND url <> ''").select("url", F.lit(True).alias("by_url")).distinct()
    rows = episodes.join(seen, "guid", "left").join(titles, "title", "left").join(urls, "url", "left")
    action = (
        F.when(F.col("old").isin(*TERMINAL), "skip_terminal")
        .when(F.coalesce("transcript_url", F.lit("")) == "", "missing_transcript")
        .when(F.coalesce("by_title", "by_url", F.lit(False)), "skip_existing")
        .otherwise("import")
    )
    rows = rows.select("position", "guid", action.alias("action"))
    if limit is None:
        return rows
    first = rows.where(F.col("action").isin("skip_existing", "import")).orderBy("position").limit(limit).select("position", F.lit(True).alias("now"))
    waits = F.col("action").isin("skip_existing", "import") & F.col("now").isNull()
    return rows.join(F.broadcast(first), "position", "left").select("position", "guid", F.when(waits, "later").otherwise(F.col("action")).alias("action"))


def caption_status(items: DataFrame, files: DataFrame, sources: DataFrame, version: int = 2) -> DataFrame:
    """(guid, status): no_caption, missing_caption_file, empty_caption, conflict, reimported, skipped_existing or imported.

    ``items``: guid, caption_path; ``files``: caption_path, chunks (how many); ``sources``: guid,
    version of what an earlier import made.  More than one such source is a conflict.
    """
    old = sources.groupBy("guid").agg(F.count("*").alias("times"), F.max("version").alias("had"))
    rows = items.join(files.select("caption_path", "chunks"), "caption_path", "left").join(old, "guid", "left")
    status = (
        F.when(F.coalesce("caption_path", F.lit("")) == "", "no_caption")
        .when(F.col("chunks").isNull(), "missing_caption_file")
        .when(F.col("chunks") == 0, "empty_caption")
        .when(F.col("times") > 1, "conflict")
        .when(F.col("times") == 1, F.when(F.col("had").eqNullSafe(F.lit(version)), "skipped_existing").otherwise("reimported"))
        .otherwise("imported")
    )
    return rows.select("guid", status.alias("status"))


def artifact_status(items: DataFrame, checked: DataFrame, known: DataFrame) -> DataFrame:
    """(stem, status, reason): skipped_incomplete with its reason, reconcile what is there, import the rest."""
    rows = items.join(checked, "stem", "left").join(known.select("stem", F.lit(True).alias("there")).distinct(), "stem", "left")
    status = F.when(~F.coalesce("complete", F.lit(False)), "skipped_incomplete").when(F.col("there"), "reconcile").otherwise("import")
    return rows.select("stem", status.alias("status"), F.when(~F.coalesce("complete", F.lit(False)), F.coalesce("reason", F.lit("missing"))).alias("reason"))


def owned(incoming: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(source_id, owner): sources that agree with an incoming item on all keys are ``importer``'s, others ``foreign``.

    Only foreign ones that share the first key are listed: those an import must refuse to change.
    """
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    rows = sources.alias("s").join(incoming.select(*keys).distinct().alias("i"), same[0])
    mine = reduce(lambda a, b: a & b, same)
    return rows.groupBy(F.col("s.source_id").alias("source_id")).agg(F.when(F.max(mine.cast("int")) == 1, "importer").otherwise("foreign").alias("owner"))


def rekeyed(state: DataFrame, key: str) -> DataFrame:
    """State by another key of its items (guid, position, status, key): the last item of a key wins."""
    return state.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("guid", "status"), "position").alias("row")).select(key, "row.*")


def applied(state: DataFrame, results: DataFrame) -> DataFrame:
    """State (episode, status, source_id) after an import's results; an episode whose import failed stays as it was."""
    good = results.where("status <> 'error'").select("episode", F.col("status").alias("new_status"), F.col("source_id").alias("new_id"))
    rows = state.join(good, "episode", "left")
    return rows.select("episode", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_id", "source_id").alias("source_id"))


def without_published(generated: DataFrame, published: DataFrame, key: str = "episode") -> DataFrame:
    """Generated items for which no published one of the current version exists."""
    return generated.join(published.where("preference = 'current'").select(key), key, "left_anti")


def patched(rows: DataFrame, patches: DataFrame, keep: bool = False) -> DataFrame:
    """``rows`` (source_id, metadata) with the patches (source_id, patch) merged into their metadata (maps of texts).

    The patch wins, or with ``keep`` what is there already.
    """
    both = rows.join(patches.select("source_id", "patch"), "source_id", "left")
    old, new = F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.coalesce("patch", F.create_map().cast("map<string,string>"))
    first, second = (new, old) if keep else (old, new)
    merged = F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)
    return both.withColumn("metadata", merged).drop("patch")


def inferred_tree(title: Column, show: Column, tree: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The tree that a source has, or that a rule (tree, title's beginning, show) gives it; null without."""
    by = F.coalesce(*[F.when(F.startswith(title, F.lit(begins)) | (show == named), F.lit(slug)) for slug, begins, named in rules])
    return F.coalesce(F.when(tree.isin(*[r[0] for r in rules]), tree), by)


def page_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows by key after a value (None: from the start)."""
    left = rows if after is None else rows.where(F.col(key) > after)
    return left.orderBy(key).limit(size)


def transcript_export(segments: Column) -> tuple[Column, Column]:
    """A payload's segments numbered from 0, and their texts, blank ones left out, with blank lines between."""
    numbered = F.transform(
        segments, lambda s, i: F.struct(i.alias("segment_index"), s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), F.coalesce(s["text"], F.lit("")).alias("text"))
    )
    texts = F.filter(F.transform(segments, lambda s: F.trim(F.coalesce(s["text"], F.lit("")))), lambda t: t != "")
    return numbered, F.concat(F.array_join(texts, "\n\n"), F.lit("\n"))


def safe_item(tree: Column, video_id: Column, guid: Column, url: Column) -> Column:
    """The first way in which a caption item's identity is not safe or not consistent; null if it is."""
    host = F.regexp_extract(url, r"^https://([^/?#:]+)", 1)
    v = F.regexp_extract(url, r"[?&]v=([^&#]*)", 1)
    return (
        F.when(~F.coalesce(tree.rlike(r"^[a-z0-9][a-z0-9-]{0,127}$"), F.lit(False)), "source_tree_slug")
        .when(~F.coalesce(video_id.rlike(r"^[A-Za-z0-9_-]{11}$"), F.lit(False)), "video_id")
        .when(~guid.eqNullSafe(F.concat(F.lit("youtube-"), video_id)), "guid")
        .when(~F.coalesce(host.isin("youtube.com", "www.youtube.com") & (v == video_id), F.lit(False)), "canonical_url")
    )


def any_part(text: Column, parts: list[str]) -> Column:
    """Does the text hold any of the parts?  Parts are plain text."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


#: Weights of sources by where their text comes from (a parameter of ``item_metadata``).
WEIGHTS = {"auto_caption": 0.8, "generated": 0.9, "published": 1.0, "published_current": 2.0, "published_legacy": 0.7}


def item_metadata(provenance: Column, weights: dict[str, float] | None = None, **fields: Column) -> Column:
    """The JSON metadata of an imported item: provenance, its weight (1 if it has none) and the fields that are not null."""
    known = F.create_map(*[F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair])
    weight = F.coalesce(F.try_element_at(known, provenance), F.lit(1.0))
    return F.to_json(F.struct(provenance.alias("transcript_provenance"), weight.alias("retrieval_weight"), *[c.alias(k) for k, c in fields.items()]))


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with empty and null fields replaced; a default may use the fields before it, with their own in place."""
    for name, default in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), default))
    return rows


def transcript_kind(url: Column, mime: Column) -> Column:
    """How a transcript is read: vtt, srt, json, html or text, by its type, else by its URL's ending."""
    kind, path = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""))
    by_type = F.when(F.contains(kind, F.lit("vtt")), "vtt").when(F.contains(kind, F.lit("srt")) | F.contains(kind, F.lit("subrip")), "srt").when(F.contains(kind, F.lit("json")), "json").when(F.contains(kind, F.lit("html")), "html")
    by_path = F.when(F.endswith(path, F.lit(".vtt")), "vtt").when(F.endswith(path, F.lit(".srt")), "srt").when(F.endswith(path, F.lit(".json")), "json").when(path.rlike(r"\.html?$"), "html")
    return F.coalesce(by_type, by_path, F.lit("text"))


def listed_episode(listing: DataFrame, wanted: Column | str, key: str = "track_id") -> DataFrame:
    """The entry of a supplied listing with that identifier, at most one."""
    return listing.where(F.col(key).cast("string") == (F.lit(wanted) if isinstance(wanted, str) else wanted)).orderBy(key).limit(1)


def batch_locations(slug: Column, prefix: str) -> Column:
    """struct<manifest, audio, artifacts, namespace> of one channel's batch."""
    return F.struct(
        F.concat(F.lit(f"{prefix}/"), slug, F.lit("/queue.json")).alias("manifest"), F.concat(F.lit(f"{prefix}/"), slug, F.lit("/audio")).alias("audio"),
        F.concat(F.lit(f"{prefix}/"), slug, F.lit("/artifacts")).alias("artifacts"), F.concat(F.lit(f"{prefix}-"), slug).alias("namespace"),
    )


class Registry:
    """Connectors by name: callables with the capabilities that they state."""

    def __init__(self) -> None:
        self._known: dict[str, dict] = {}

    def add(self, name: str, **capabilities) -> None:
        self._known[name] = capabilities

    def get(self, name: str, capability: str):
        """A connector's callable; an unknown name or capability is an error."""
        if name not in self._known:
            raise ValueError(f"no connector named {name!r}")
        if capability not in self._known[name]:
            raise ValueError(f"connector {name!r} has no {capability}")
        return self._known[name][capability]


class FixtureTranscripts:
    """A transcription provider that reads a prepared JSON transcript."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def transcribe(self, audio: str | None = None) -> DataFrame:
        return self.spark.read.option("multiLine", True).json(self.path)
