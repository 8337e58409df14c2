"""Import loops as plans: a listing, what is known and what was read become sources, chunks and a status for each item.

An item that fails is a row with its reason, and the rest goes on.  What one item brings in
is known to those after it: of items that share a title or an address only the first
that succeeds is imported, just as if they came one after another.  A limit stops the loop at a position.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html_blocks
from ..runtime import materialise
from ..sources import captions
from ..sources.feeds import UNTITLED_ITEM
from .importing import TERMINAL, transcript_kind
from .ingest import transcripts
from .segmentation import pieces, proportional

_SEGMENT = "struct<start_ms:bigint,end_ms:bigint,text:string>"

#: Reasons of errors.
UNREAD, SILENT = "transcript could not be read", "transcript has no segments"


class Loop(NamedTuple):
    """``results`` (position, guid, status, reason, source_id, n_segments) and ``made``, the rows of each table to append."""

    results: DataFrame
    made: dict[str, DataFrame]


def read_transcripts(contents: DataFrame) -> DataFrame:
    """(guid, segments, error) of transcripts (guid, content, url, mime, seconds): captions by cue, pages and texts in proportion to time.

    A null content is an error, as is one without segments; the other rows are not touched by it.
    """
    is_vtt = F.coalesce(transcript_kind(F.col("url"), F.col("mime")) == "vtt", F.lit(False))
    rows = contents.select("guid", "content", "seconds", is_vtt.alias("is_vtt"))
    # each kind has its own column, so that a text is not cleaned as the other kind as well
    rows = rows.withColumn("captions", F.when(F.col("is_vtt"), F.col("content"))).withColumn("page", F.when(~F.col("is_vtt"), F.col("content")))
    rows = captions.with_cues(rows, "captions", "cues")
    # bound by an array of one: entities are decoded in a worker, which no lambda may call
    page = F.array(pieces(clean_html_blocks(F.col("page")), "a"))
    plain = F.transform(page, lambda parts: proportional(parts, F.coalesce("seconds", F.lit(0))))[0]
    told = F.transform(plain, lambda s: F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), s["body"].alias("text")))
    rows = rows.select("guid", F.col("content").isNull().alias("unread"), F.when(F.col("is_vtt"), F.col("cues").cast(f"array<{_SEGMENT}>")).otherwise(told.cast(f"array<{_SEGMENT}>")).alias("segments"))
    error = F.when(F.col("unread"), UNREAD).when(F.coalesce(F.size("segments"), F.lit(0)) < 1, SILENT)
    return rows.select("guid", F.when(error.isNull(), F.col("segments")).alias("segments"), error.alias("error"))


def first_come(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """The rows that are kept when each comes in ``order`` and goes if one kept before shares any of ``keys`` with it; null keys are shared by none.

    In a round every row that is the first under all its keys is kept, and what shares a key with it
    goes; the first row of all is among them, so the rounds end.  Few are needed unless keys
    form long chains.
    """
    left, kept = materialise(rows, "first-come"), []
    while not left.isEmpty():
        marked = left
        for k in keys:
            marked = marked.join(left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"first_{k}")), k, "left")
        first = reduce(lambda a, b: a & b, [F.col(f"first_{k}").isNull() | (F.col(f"first_{k}") == F.col(order)) for k in keys])
        won = materialise(marked.where(first).select(*rows.columns), "first-come-won")
        kept.append(won)
        rest = left.join(won.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(won.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        left = materialise(rest.select(*rows.columns), "first-come")
    return reduce(DataFrame.unionByName, kept) if kept else left


def source_title(show: str, title: Column, kind: str) -> Column:
    """What the source of an episode is called."""
    return F.concat(F.lit(f"{show}: "), F.coalesce(title, F.lit(UNTITLED_ITEM)), F.lit(f" ({kind} Transcript)"))


def _held(rows: DataFrame, sources: DataFrame, name: str, value: str) -> DataFrame:
    """``rows`` with the least ``value`` of the sources that share the title or the address, as ``name``."""
    for k in ("title", "url"):
        found = sources.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(k).agg(F.min(value).alias(f"{name}_{k}"))
        rows = rows.join(found, k, "left")
    return rows.withColumn(name, F.coalesce(f"{name}_title", f"{name}_url")).drop(f"{name}_title", f"{name}_url")


def import_loop(
    items: DataFrame, state: DataFrame, known: DataFrame, read: DataFrame, show: str, tenant: str = "local",
    limit: int | None = None, count_skips: bool = True, numbers: tuple[int | None, int | None] = (None, None), terminal: tuple[str, ...] = TERMINAL,
) -> Loop:
    """Go through ``items`` by position and import what has to be.

    ``items``: position, guid, title, url, transcript_url, and if they have them ``number`` (for the range
    ``numbers``, both ends included) and ``incomplete`` (why an item is not whole, null if it is).  Of rows
    that share a guid the first counts; without one they are no items.  ``state``: guid, status of earlier runs; ``known``:
    source_id, title, url of the sources there are; ``read``: guid, segments, error.

    Statuses: already_done (a terminal status before), skipped_incomplete, missing_transcript,
    skipped_existing, error, imported, not_reached.  The loop ends with the ``limit``-th import,
    or with ``count_skips`` the ``limit``-th import or existing one.
    """
    has = set(items.columns)
    low, high = numbers
    if low is not None or high is not None:
        n = F.col("number")
        items = items.where((F.lit(True) if low is None else n >= low) & (F.lit(True) if high is None else n <= high))
    at = F.struct("position", "guid")
    one = F.struct(F.coalesce("title", F.lit(UNTITLED_ITEM)).alias("title"), F.nullif("url", F.lit("")).alias("url"), "transcript_url", (F.col("incomplete") if "incomplete" in has else F.lit(None).cast("string")).alias("incomplete"))
    rows = items.where("guid IS NOT NULL").groupBy("guid").agg(F.min("position").alias("position"), F.min_by(one, "position").alias("i")).select("guid", "position", "i.*")
    rows = rows.withColumn("at", at).join(state.groupBy("guid").agg(F.max(F.col("status").isin(*terminal)).alias("over")), "guid", "left")
    rows = _held(rows, known, "there", "source_id")
    # texts are written as they are read, by no shuffle; what is decided needs counts and reasons, and only the imported ones' texts are fetched
    count = F.coalesce(F.size("segments"), F.lit(0)).cast("long")
    reads = read.select("guid", "segments", "error", count.alias("n_segments"), F.xxhash64("segments").alias("mark"))
    reads = materialise(reads.where("guid IS NOT NULL"), "loop-read")
    told = reads.groupBy("guid").agg(F.min(F.struct(F.coalesce("error", F.lit("")).alias("order"), "mark", "error", "n_segments")).alias("r"))
    rows = rows.join(told, "guid", "left").withColumn("n_segments", F.coalesce("r.n_segments", F.lit(0)))
    rows = rows.withColumn("error", F.when(F.col("r").isNull(), UNREAD).otherwise(F.coalesce("r.error", F.when(F.col("n_segments") < 1, SILENT))))
    status = (
        F.when(F.coalesce("over", F.lit(False)), "already_done")
        .when(F.col("incomplete").isNotNull(), "skipped_incomplete")
        .when(F.coalesce("transcript_url", F.lit("")) == "", "missing_transcript")
        .when(F.col("there").isNotNull(), "skipped_existing")
        .when(F.col("error").isNotNull(), "error")
        .otherwise("candidate")
    )
    narrow = materialise(rows.withColumn("mark", F.col("r.mark")).drop("r").withColumn("status", status), "loop-items")
    won = first_come(narrow.where("status = 'candidate'").select("at", "title", "url"), "at", ["title", "url"])
    named = won.withColumn("first", F.col("at"))
    narrow = _held(narrow.join(won.select("at", F.lit(True).alias("won")), "at", "left"), named, "first", "first")
    # of candidates that lost and of errors: was the source there when their turn came?
    late = F.col("status").isin("candidate", "error") & F.col("won").isNull() & F.col("first").isNotNull() & (F.col("first") < F.col("at"))
    narrow = narrow.withColumn("status", F.when(F.col("won"), "imported").when(late, "skipped_existing").otherwise(F.col("status")))
    narrow = materialise(narrow, "loop-decided")
    if limit is not None:
        counted = narrow.where(F.col("status").isin("imported", *(["skipped_existing"] if count_skips else [])))
        last = counted.select("at").orderBy("at").limit(limit).agg(F.max("at").alias("at"), F.count("*").alias("n")).first()
        if limit < 1:
            narrow = narrow.withColumn("status", F.lit("not_reached"))
        elif last.n == limit:
            end = F.struct(F.lit(last["at"].position).cast(narrow.schema["position"].dataType).alias("position"), F.lit(last["at"].guid).alias("guid"))
            narrow = narrow.withColumn("status", F.when(F.col("at") > end, "not_reached").otherwise(F.col("status")))
    new = narrow.where("status = 'imported'").select("guid", "mark", "title", "url").join(reads.select("guid", "mark", "segments"), ["guid", "mark"]).dropDuplicates(["guid"])
    made = transcripts(new.select(F.lit(show).alias("show_title"), F.col("title").alias("episode_title"), F.col("url").alias("episode_url"), F.lit(None).cast("string").alias("language"), "segments"), tenant)
    made = {**made, "sources": made["sources"].join(new.select("title", "url"), "title").withColumn("show", F.lit(show))}
    ids = made["sources"].select("source_id", "title", "url")
    rest = _held(narrow, ids, "made_id", "source_id")
    shown = F.col("status").isin("imported", "skipped_existing")
    reason = F.when(F.col("status") == "error", F.col("error")).when(F.col("status") == "skipped_incomplete", F.col("incomplete"))
    results = rest.select(
        "position", "guid", "status", reason.alias("reason"), F.when(shown, F.coalesce("there", "made_id")).alias("source_id"),
        F.when(F.col("status") == "imported", F.col("n_segments")).alias("n_segments"),
    )
    return Loop(results, made)


def next_state(state: DataFrame, results: DataFrame) -> DataFrame:
    """State (guid, status, reason, source_id) after a run: what was handled has its new status, the rest is as before."""
    new = results.where("status NOT IN ('already_done', 'not_reached')").select("guid", F.struct("status", "reason", "source_id").alias("new"))
    old = state.select("guid", F.struct("status", "reason", "source_id").alias("old"))
    return old.join(new, "guid", "full").select("guid", F.coalesce("new", "old").alias("s")).select("guid", "s.*")
