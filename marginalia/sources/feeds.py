"""Feeds: RSS texts to typed episode rows, parsed by Spark's own XML functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_html_blocks, seconds_from_duration

_TEXTS = ["title", "link", "guid", "description", "pubDate", "content:encoded", "itunes:duration", "itunes:season", "itunes:episode"]
_ITEM = T.StructType(
    [
        *(T.StructField(name, T.StringType()) for name in _TEXTS),
        T.StructField("enclosure", T.StructType([T.StructField("_url", T.StringType())])),
        T.StructField("podcast:transcript", T.ArrayType(T.StructType([T.StructField("_url", T.StringType()), T.StructField("_type", T.StringType())]))),
    ]
)

#: Transcript kinds from the best on; others come last.
PRIORITY = {"text/vtt": 0, "application/srt": 1, "text/srt": 1, "application/json": 2, "text/html": 3, "text/plain": 4}

#: Titles of items and channels without one.
UNTITLED_ITEM, UNTITLED_CHANNEL = "Untitled episode", "Untitled podcast"


def episodes(feeds: DataFrame) -> DataFrame:
    """Rows of RSS texts (feed, content): titles, links, times and transcripts, the best kind first.

    A missing title becomes ``Untitled episode``; the guid falls back to link, then title.
    Texts that are no RSS give no rows.
    """
    body = F.regexp_replace("content", r"^\s*<\?xml[^>]*\?>", "")
    items = F.regexp_extract_all(body, F.lit(r"(?s)(<item\b[^>]*>.*?</item>)"), F.lit(1))
    return episodes_of(feeds.select("feed", F.posexplode(items).alias("n", "raw")))


def episodes_of(items: DataFrame) -> DataFrame:
    """The same of items (feed, n, raw) as they stand in a feed."""
    # each item is parsed alone; the namespaces that its names use are declared for it
    head = '<item xmlns:itunes="i" xmlns:podcast="p" xmlns:content="c" xmlns:atom="a" xmlns:media="m" xmlns:dc="d">'
    rows = items.select("feed", "n", F.from_xml(F.regexp_replace("raw", r"^<item\b[^>]*>", head), _ITEM).alias("i"))

    def text(name: str):
        return F.nullif(F.trim(F.col(f"i.`{name}`")), F.lit(""))

    rank = F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p])
    ordered = F.array_sort(
        F.transform(
            F.coalesce(F.col("i.`podcast:transcript`"), F.array().cast("array<struct<_url:string,_type:string>>")),
            lambda t, i: F.struct(F.coalesce(F.try_element_at(rank, F.lower(t["_type"])), F.lit(9)).alias("rank"), i.alias("at"), t["_url"].alias("url"), t["_type"].alias("type")),
        )
    )
    return rows.select(
        "feed",
        F.col("n").alias("idx"),
        F.coalesce(text("title"), F.lit(UNTITLED_ITEM)).alias("title"),
        text("link").alias("link"),
        F.coalesce(text("guid"), text("link"), text("title")).alias("guid"),
        F.col("i.enclosure._url").alias("audio_url"),
        seconds_from_duration(F.coalesce(text("itunes:duration"), F.lit(""))).alias("seconds"),
        text("itunes:season").try_cast("int").alias("season"),
        text("itunes:episode").try_cast("int").alias("episode"),
        clean_html_blocks(F.coalesce(text("content:encoded"), text("description"))).alias("notes"),
        F.transform(ordered, lambda t: F.struct(t["url"].alias("url"), t["type"].alias("type"))).alias("transcripts"),
    )


def channels(feeds: DataFrame) -> DataFrame:
    """(feed, title, link) of each channel; a text without one is an error."""
    head = F.regexp_replace(F.regexp_extract("content", r"(?s)<channel\b[^>]*>(.*?)(?:<item\b|</channel>)", 1), r"(?s)<image\b.*?</image>", "")
    checked = F.when(F.col("content").rlike(r"<channel\b"), head).otherwise(F.raise_error(F.lit("no channel in the feed")).cast("string"))

    def tag(name: str):
        raw = F.regexp_extract(checked, rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return F.nullif(F.trim(F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit(""))

    return feeds.select("feed", F.coalesce(tag("title"), F.lit(UNTITLED_CHANNEL)).alias("title"), tag("link").alias("link"))


def with_transcripts(items: DataFrame) -> DataFrame:
    """Episodes that offer a transcript."""
    return items.where(F.size("transcripts") > 0)


def show_episodes(items: DataFrame, show: str | None = None) -> DataFrame:
    """Episodes with ``number``, ``episode_title`` and ``date_key``, by the habits of shows.

    The number is the feed's, else that of the link's last part, else what stands before a
    colon in the title; that beginning, and ``show`` before a number, leave the title.
    """
    by_link = F.nullif(F.regexp_extract("link", r"/(-?\d+[a-z]?)/?$", 1), F.lit(""))
    head = F.regexp_extract("title", r"^([^:]*):", 1)
    number = F.coalesce(F.col("episode").cast("string"), by_link, F.nullif(F.trim(head), F.lit("")), F.col("title"))
    title = F.col("title") if show is None else F.regexp_replace("title", f"^{re.escape(show)}\\s+", "")
    begin = F.concat(F.lit("^"), F.regexp_replace(number, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"\s*:\s*"))
    bare = F.trim(F.regexp_replace(title, begin, F.lit("")))
    return items.withColumn("number", number).withColumn("episode_title", F.coalesce(F.nullif(bare, F.lit("")), F.col("title")))


def guid_titles(feeds: DataFrame) -> DataFrame:
    """(feed, guid, title) of items by pattern alone, for feeds that are no sound XML; CDATA or plain."""
    items = feeds.select("feed", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?s)(<item\b[^>]*>.*?</item>)"), F.lit(1))).alias("n", "raw"))

    def tag(name: str):
        inner = F.regexp_extract("raw", rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return F.trim(F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))

    return items.select("feed", "n", tag("guid").alias("guid"), tag("title").alias("title")).where("guid <> ''")
