"""Functions on titles, links, dates and metadata of sources."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .text import slugify

@pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().casefold())


def normalize_title(text: Column) -> Column:
    """Accents folded to ASCII, case folded, other characters to single spaces."""
    return F.trim(F.regexp_replace(_folded(text), "[^a-z0-9]+", " "))


def json_text(metadata: Column, key: str) -> Column:
    """A value of a JSON object as text; null where there is none."""
    return F.get_json_object(metadata, f"$.{key}")


def json_number_weight(metadata: Column, key: str = "retrieval_weight") -> Column:
    """A positive JSON number; else, numeric text included, 1."""
    value = F.try_variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    number = F.get_json_object(metadata, f"$.{key}").try_cast("double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (number > 0), number).otherwise(F.lit(1.0))


#: What a title says of its version, its label and its weight.
VERSIONS = [("legacy", 0.7), ("current", 2.0)]


def version_metadata(title: Column, show: str) -> Column:
    """struct<number, item_id, label, weight> of titles like ``Show 12a ... legacy``; nulls where the title says nothing."""
    pattern = rf"\b{re.escape(show)}\s+(-?\d+)([A-Za-z]?)\b"
    number = F.regexp_extract(title, pattern, 1).try_cast("int")
    padded = F.when(number < 0, F.concat(F.lit("-"), F.lpad(F.abs(number).cast("string"), 2, "0"))).otherwise(
        F.when(number > 999, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0"))
    )
    item = F.concat(F.lit(f"{show.lower()}-"), padded, F.lower(F.regexp_extract(title, pattern, 2)))
    told = [(F.contains(F.lower(title), F.lit(name)), name, weight) for name, weight in VERSIONS]
    label = F.when(told[0][0], told[0][1]).when(told[1][0], told[1][1])
    weight = F.when(told[0][0], told[0][2]).when(told[1][0], told[1][2])
    return F.struct(number.alias("number"), F.when(number.isNotNull(), item).alias("item_id"), label.alias("label"), weight.alias("weight"))


#: Begin of an anchor, a quoted target in its tag, and its label.
_BEGIN = r"(?i)(?=<a\s)"
_TARGET = r"""(?i)^<a\s(?:[^>]*\s)?href\s*=\s*(?:"([^">]+)"|'([^'>]+)')[^>]*>"""
_LABEL = r"(?is)^<a\s[^>]*>(.*?)</a>"


def _anchor(piece: Column) -> list[Column]:
    """Target and label, without tags, of a piece of a page that begins with an anchor; empty if it does not."""
    label = F.regexp_replace(F.regexp_extract(piece, _LABEL, 1), r"<[^>]+>", " ")
    target = F.concat(F.regexp_extract(piece, _TARGET, 1), F.regexp_extract(piece, _TARGET, 2))
    return [target.alias("href"), label.alias("label"), piece.rlike(_LABEL).alias("closed")]


def _plain(text: Column) -> Column:
    """The text with the character references that attributes need: ampersand, quotes and angle brackets."""
    for reference, character in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def document_links(page: Column, word: str = "transcript", suffix: str = ".pdf") -> Column:
    """Distinct targets of anchors to documents, in order.

    The label, without its tags, has the word, or the target has word and suffix; the target has either.
    """
    found = F.transform(F.split(page, _BEGIN), lambda piece: F.struct(*_anchor(piece)))

    def fits(x: Column) -> Column:
        has_word, has_suffix = F.contains(F.lower(x["href"]), F.lit(word)), F.contains(F.lower(x["href"]), F.lit(suffix))
        return (x["href"] != "") & x["closed"] & (has_word | has_suffix & F.contains(F.lower(x["label"]), F.lit(word)))

    return F.array_distinct(F.transform(F.filter(found, fits), lambda x: x["href"]))


def versioned_links(page: Column, host: str, word: str = "transcript", before: int = 1200, after: int = 800, mark: str = "legacy") -> Column:
    """array<struct<version, url>>: links to a host that speak of the word, and which version the text around them names.

    A fold over the pieces of a page, which begin at its anchors, keeps how far it has come; the text around
    is ``before`` characters ahead of an anchor's begin and ``after`` from it on, without tags.  Where it has the mark
    the version is legacy, else current.  If the first two of the distinct links have one version, the first is
    current, the second legacy.  Null gives null.
    """
    none = F.array().cast("array<struct<at:int,href:string,label:string,closed:boolean>>")

    def step(done: Column, piece: Column) -> Column:
        raw, label, closed = _anchor(piece)
        href = _plain(raw).alias("href")
        wanted = closed & F.contains(href, F.lit(host))
        one = F.array(F.struct(done["at"].alias("at"), href, label, closed))
        return F.struct((done["at"] + F.length(piece)).alias("at"), F.when(wanted, F.concat(done["found"], one)).otherwise(done["found"]).alias("found"))

    met = F.aggregate(F.split(page, _BEGIN), F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]

    def told(x: Column) -> Column:
        begin = F.greatest(x["at"] - before, F.lit(0))
        around = F.regexp_replace(F.substring(page, begin + 1, x["at"] + after - begin), r"<[^>]+>", " ")
        legacy = F.contains(F.lower(around), F.lit(mark))
        return F.struct(F.when(legacy, "legacy").otherwise("current").alias("version"), x["href"].alias("url"))

    spoken = F.filter(met, lambda x: F.contains(F.lower(F.concat_ws(" ", x["href"], x["label"])), F.lit(word)))
    links = F.array_distinct(F.transform(spoken, told))
    alike = F.coalesce(F.get(links, F.lit(0))["version"] == F.get(links, F.lit(1))["version"], F.lit(False))
    turned = F.transform(links, lambda x, i: F.struct(F.when(alike & (i == 0), "current").when(alike & (i == 1), "legacy").otherwise(x["version"]).alias("version"), x["url"].alias("url")))
    return F.when(page.isNotNull(), turned)


def first_link_to(page: Column, *parts: str) -> Column:
    """The first anchor target that holds one of the parts; null without."""
    targets = F.regexp_extract_all(page, F.lit(r"""(?is)<a\s+[^>]*href=["']([^"']+)["']"""), F.lit(1))
    return F.get(F.filter(targets, lambda t: F.greatest(*[F.contains(t, F.lit(p)) for p in parts], F.lit(False))), F.lit(0))


#: How a hosting service names an episode's page in the URLs of its transcripts and audio files.
PAGE_IN_TRANSCRIPT = r"(https://www\.buzzsprout\.com/\d+/\d+)"
PAGE_IN_AUDIO = r"(https://www\.buzzsprout\.com/\d+)/episodes/(\d+)"


def episode_url(link: Column, transcripts: Column, audio: Column) -> Column:
    """The link, else a page named by the first transcript URL that names one, else by the audio URL, else empty."""
    named = F.filter(F.transform(F.coalesce(transcripts, F.array().cast("array<string>")), lambda u: F.regexp_extract(F.coalesce(u, F.lit("")), PAGE_IN_TRANSCRIPT, 1)), lambda u: u != "")
    held = F.coalesce(audio, F.lit(""))
    by_audio = F.when(held.rlike(PAGE_IN_AUDIO), F.concat_ws("/", F.regexp_extract(held, PAGE_IN_AUDIO, 1), F.regexp_extract(held, PAGE_IN_AUDIO, 2)))
    return F.coalesce(F.nullif(link, F.lit("")), F.get(named, F.lit(0)), by_audio, F.lit(""))


def tree_metadata(show: Column, kind: str = "podcast") -> Column:
    """struct<source_tree_slug, source_tree_type> of a show's title."""
    return F.struct(slugify(show, 80, "podcast").alias("source_tree_slug"), F.lit(kind).alias("source_tree_type"))


def timestamp_metadata(provenance: Column) -> Column:
    """struct<timestamp_provenance, timestamp_precision, citation_anchor>; an unknown provenance is an error."""
    published, generated = provenance == "published_transcript", F.startswith(provenance, F.lit("generated_"))
    fail = F.raise_error(F.concat(F.lit("unsupported transcript provenance: "), F.coalesce(provenance, F.lit("null")))).cast("string")
    return F.struct(
        F.when(published, "proportional_estimate").when(generated, "asr_segment").otherwise(fail).alias("timestamp_provenance"),
        F.when(published, "approximate").when(generated, "segment").otherwise(fail).alias("timestamp_precision"),
        F.lit("chunk_start").alias("citation_anchor"),
    )


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_DATE = r"(?i)^\s*(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|GMT|UT|UTC|Z)?\s*$"

#: Where dates that cannot be read stand: after all others.
LAST_DATE = "9999-12-31T23:59:59+00:00"


def date_key(text: Column) -> Column:
    """A mail date (``Tue, 02 Jan 2024 03:04:05 +0000``) as ISO text with its offset; others come last."""
    def part(i: int) -> Column:
        return F.regexp_extract(text, _DATE, i)

    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part(2)))
    zone = F.when(part(7).rlike(r"^[+-]"), F.concat(F.substring(part(7), 1, 3), F.lit(":"), F.substring(part(7), 4, 2))).when(part(7) == "", "").otherwise("+00:00")
    seconds = F.when(part(6) == "", "00").otherwise(part(6))
    iso = F.concat(part(3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), seconds)
    real = F.expr("true") & (month > 0) & F.try_to_timestamp(iso).isNotNull()
    return F.when(F.coalesce(text.rlike(_DATE), F.lit(False)) & real, F.concat(iso, zone)).otherwise(F.lit(LAST_DATE))


def glossary(titles: Column, pattern: str, prefix: str = "", extra: list[str] | None = None, words: int = 150) -> Column:
    """Distinct terms that a pattern (one group) finds in an array of titles, after ``extra`` ones, cut to a budget of words."""
    found = F.filter(F.transform(titles, lambda t: F.trim(F.regexp_extract(t, pattern, 1))), lambda t: t != "")
    terms = F.concat(F.array(*[F.lit(x) for x in extra or []]).cast("array<string>"), F.transform(F.array_distinct(found), lambda t: F.concat(F.lit(prefix), t)))
    text = F.concat(F.array_join(terms, ". "), F.lit("."))
    split = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(split) > words, F.array_join(F.slice(split, 1, words), " ")).otherwise(text)


@pandas_udf(T.ArrayType(T.DoubleType()))
def _from_bytes(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").astype(float).tolist())


def decode_vector(raw: Column, kind: str) -> Column:
    """A stored vector as array<double>, from an ``array``, ``json`` text or ``binary`` little-endian floats; null where it is none."""
    if kind == "array":
        return raw.cast("array<double>")
    if kind == "binary":
        return _from_bytes(raw)
    if kind != "json":
        raise ValueError("a vector is stored as array, json or binary")
    values = F.from_json(raw, "array<double>")
    return F.when(raw.rlike(r"^\s*\[") & ~F.exists(values, lambda x: x.isNull()), values)


def rewrite_paths(text: Column, rules: list[tuple[str, str]]) -> Column:
    """JSON text whose string values that match a rule as a whole are replaced; ``rules`` are (pattern, replacement)."""
    for pattern, to in rules:
        text = F.regexp_replace(text, rf'"{pattern}"', f'"{to}"')
    return text


def episode_key(name: Column) -> Column:
    """The episode of a recogniser's file, ``e012-...``; 999 stands for -1; null for other names."""
    n = F.regexp_extract(name, r"^e(\d+)-oai-raw(?:-chunked)?\.json$", 1).try_cast("int")
    return F.when(n == 999, -1).otherwise(n)


def item_episode(folder: Column, show: str) -> Column:
    """The episode of an item's folder: ``show-012`` as ``12``, ``12`` and ``12a`` as they are."""
    padded = F.regexp_extract(folder, rf"^{re.escape(show)}-(\d{{3}})$", 1)
    return F.coalesce(F.when(padded != "", padded.cast("int").cast("string")), F.nullif(F.regexp_extract(folder, r"^(\d+[a-z]?)$", 1), F.lit("")))
