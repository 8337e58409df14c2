"""Text functions as Column expressions: they stay in the JVM and in the optimiser's sight."""

from __future__ import annotations

import hashlib
import html
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

#: Scripts written without spaces between words.
CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"

#: Letters of scripts to which English stemming does not apply.
NOT_LATIN = r"[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"

#: Words that count as another.
SYNONYMS = {
    "feline": "cat",
    "felines": "cat",
    "kitty": "cat",
    "kitten": "cat",
    "canine": "dog",
    "canines": "dog",
    "puppy": "dog",
}


def tokenize(text: Column, maybe: Column | None = None) -> Column:
    """Runs of letters and digits, lower-cased; runs in scripts without spaces become bigrams.

    Null gives null.  Where ``maybe`` is false, the text is known to have no such script.
    """
    cjk = text.rlike(CJK) if maybe is None else maybe & text.rlike(CJK)
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.lower)

    def split(run: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(CJK) & (F.length(run) > 1), grams).otherwise(F.array(run))

    return F.when(cjk, F.flatten(F.transform(runs, split))).otherwise(runs)


_RUN, _CJK = regex.compile(r"[\p{L}\p{N}]+"), regex.compile(r"[\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF]")


def tokens_of(text: str) -> list[str]:
    """The tokens of one short text, such as a query, on the driver: as ``tokenize`` has them."""
    out: list[str] = []
    for run in _RUN.findall(text):
        run = run.lower()
        out += [run[i : i + 2] for i in range(len(run) - 1)] if len(run) > 1 and _CJK.search(run) else [run]
    return out


def ascii_tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def normalized_tokens(text: Column) -> Column:
    """Tokens with synonyms replaced and, outside other scripts, one final s taken off."""
    known = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])

    def norm(token: Column) -> Column:
        stem = F.when(~token.rlike(NOT_LATIN) & (F.length(token) > 1), F.regexp_replace(token, "s$", "")).otherwise(token)
        return F.coalesce(F.try_element_at(known, token), stem)

    return F.transform(tokenize(text), norm)


def slugify(text: Column, most: int | None = None, default: str | None = None) -> Column:
    """Lower case, other characters than a-z and 0-9 to single hyphens, none at the ends."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if most is not None:
        slug = F.regexp_replace(F.substring(slug, 1, most), "-+$", "")
    return slug if default is None else F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def safe_name(text: Column, most: int = 80, default: str = "podcast") -> Column:
    """A slug for files and trees: references decoded first, cut to a length, never empty."""
    return slugify(unescape(text), most, default)


#: A character reference, as HTML texts have them with and without the semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@pandas_udf(T.ArrayType(T.StringType()))
def _decoded(found: pd.Series) -> pd.Series:
    return found.map(lambda refs: None if refs is None else [html.unescape(r) for r in refs])


def unescape(text: Column) -> Column:
    """All character references decoded, each once.

    Only the references themselves go through Python; the text between them does not.
    """
    refs = F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1))
    between = F.split(text, REFERENCE)
    woven = F.zip_with(between, _decoded(refs), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(woven, "")).otherwise(text)


def _collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\x0B\f\r\x{A0}]+", " "), "^ | $", "")


def references(texts: Column) -> tuple[Column, Column]:
    """The distinct character references in an array of texts, and what each decodes to; for ``woven``."""
    none = F.array().cast("array<string>")
    found = F.transform(texts, lambda t: F.when(F.contains(t, F.lit("&")), F.regexp_extract_all(t, F.lit(f"({REFERENCE})"), F.lit(1))).otherwise(none))
    refs = F.array_distinct(F.flatten(found))
    return refs, _decoded(refs)


def woven(text: Column, decoded: Column) -> Column:
    """``unescape`` where lambdas may call it: ``decoded`` maps references to what they decode to."""
    parts = F.zip_with(F.split(text, REFERENCE), F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1)), lambda a, r: F.concat(a, F.coalesce(F.try_element_at(decoded, r), F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


#: White space, and what has it in other runs than single spaces.
_BLANKS = " \t\n\x0b\f\r\xa0"
_RUNS = r"[\t\n\x0B\f\r\x{A0}][ \t\n\x0B\f\r\x{A0}]*| [ \t\n\x0B\f\r\x{A0}]+"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends.

    Texts are matched only where bytes show that there is something to change.
    """
    runs = F.when(_any([F.contains(text, F.lit(x)) for x in ("  ", *_BLANKS[1:])]), F.regexp_replace(text, _RUNS, " ")).otherwise(text)
    # "$" is also before a last line separator
    edge = _any([F.startswith(runs, F.lit(" ")), *[F.endswith(runs, F.lit(f" {x}")) for x in ("", "\x85", "\u2028", "\u2029")]])
    return F.when(edge, F.regexp_replace(runs, "^ | $", "")).otherwise(runs)


def without_tags(page: Column) -> Column:
    """CDATA unwrapped, tags to spaces."""
    stripped = F.regexp_replace(F.regexp_replace(page, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"(?s)<[^>]+>", " ")
    return F.when(F.contains(page, F.lit("<")), stripped).otherwise(page)


def clean_html_flat(page: Column) -> Column:
    """CDATA unwrapped, tags to spaces, entities decoded, white space collapsed."""
    return _collapse(unescape(without_tags(page)))


def clean_html_blocks(page: Column) -> Column:
    """As clean_html_flat, but with a line for each paragraph or break; blank lines go."""
    body = F.regexp_replace(page, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"), r"(?i)</p\s*>", "\n\n")
    lines = F.transform(F.split(unescape(F.regexp_replace(body, r"(?s)<[^>]+>", " ")), "\n"), _collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def links(page: Column) -> Column:
    """Distinct targets of anchors, in order."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r'(?i)<a\b[^>]*?href="([^"]*)"'), F.lit(1)))


def seconds_from_duration(text: Column) -> Column:
    """[[H:]M:]S of digits to seconds, anything else to 0."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda x: x.cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    return F.when(F.trim(text).rlike(r"^\d{1,9}(:\d{1,9}){0,2}$"), total).otherwise(F.lit(0).cast("long"))


def timestamp_ms(text: Column) -> Column:
    """[H:]M:S[.,]fraction to milliseconds; null where it is none."""
    pattern = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d+))?\s*$"

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit("0"))

    whole = (part(1).cast("long") * 60 + part(2).cast("long")) * 60 + part(3).cast("long")
    return F.when(text.rlike(pattern), whole * 1000 + F.rpad(part(4), 3, "0").cast("long"))


def format_timestamp(ms: Column) -> Column:
    """HH:MM:SS from one hour on, else MM:SS."""
    s = F.floor(ms / 1000)
    short = F.concat(F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(s >= 3600, F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), short)).otherwise(short)


def mmss(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def mmss_to_ms(text: Column, index: Column) -> Column:
    """MMSS (three digits at least) to milliseconds; else two minutes for each index."""
    head = F.substring(text, F.lit(1), F.length(text) - 2).try_cast("long")
    tail = F.substring(text, F.length(text) - 1, F.lit(2)).try_cast("long")
    return F.when(text.rlike(r"^\d{3,}$"), (head * 60 + tail) * 1000).otherwise(index * 120000)


def citation_label(source_type: Column, show: Column, channel: Column, title: Column, start_ms: Column, index: Column) -> Column:
    """``container, title, time`` for timed sources, else ``title, chunk N``."""
    empty = F.lit("")
    container = F.coalesce(F.nullif(show, empty), F.nullif(channel, empty), title)
    timed = source_type.isin("podcast_episode", "youtube_video") & start_ms.isNotNull()
    return F.when(timed, F.concat_ws(", ", container, title, format_timestamp(start_ms))).otherwise(
        F.concat(title, F.lit(", chunk "), index.cast("string"))
    )


def timestamp_url(source_type: Column, url: Column, start_ms: Column) -> Column:
    """The URL with ``t`` in seconds; null for untimed sources and missing parts."""
    timed = source_type.isin("podcast_episode", "youtube_video") & start_ms.isNotNull() & (url != "")
    sign = F.when(F.instr(url, "?") > 0, "&").otherwise("?")
    return F.when(timed, F.concat(url, sign, F.lit("t="), F.floor(start_ms / 1000).cast("string")))


def replace_time(url: Column, start_ms: Column) -> Column:
    """The URL with its ``t`` parameter replaced by whole seconds; the fragment stays last."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^t(=|$)"))
    stamp = F.concat(F.lit("t="), F.floor(start_ms / 1000).cast("string"), F.lit("s"))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(kept, F.array(stamp)), "&"), fragment)


def weight(raw: Column) -> Column:
    """A positive number or numeric text; else 1."""
    value = raw.try_cast("double")
    return F.when(value > 0, value).otherwise(F.lit(1.0))


def episode_number(text: Column) -> Column:
    """First number standing alone, with one letter after it at most."""
    return F.nullif(F.regexp_extract(F.lower(text), r"\b(-?\d+[a-z]?)\b", 1), F.lit(""))


def classify_url(url: Column) -> Column:
    """apple_episode, apple_podcast, rss_feed or unknown_url, by host, path and query."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    apple = F.contains(host, F.lit("podcasts.apple.com")) & path.rlike(r"/id\d+")
    return (
        F.when(apple & url.rlike(r"^[^#]*[?&]i=[^&#]"), "apple_episode")
        .when(apple, "apple_podcast")
        .when(path.rlike(r"(\.xml|/feed)$") | F.contains(path, F.lit("rss")), "rss_feed")
        .otherwise("unknown_url")
    )


_NOT_LATIN = regex.compile(r"[\u0400-\u04FF\u0590-\u05FF\u0600-\u06FF\u0900-\u097F\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF]")

#: Distinct tokens whose hashes a worker remembers before it starts anew.
REMEMBERED = 200_000


def normalized_token(token: str) -> str:
    """One token as ``normalized_tokens`` makes it."""
    if token in SYNONYMS:
        return SYNONYMS[token]
    return token[:-1] if len(token) > 1 and token.endswith("s") and not _NOT_LATIN.search(token) else token


@lru_cache(maxsize=8)
def _hashed_units(dims: int):
    """Texts to signed counts by their tokens' hashes, to unit length; a token is hashed once a worker."""
    known: dict[str, int] = {}

    def code(token: str) -> int:
        digest = hashlib.sha256(normalized_token(token).encode()).digest()
        return int.from_bytes(digest[:4], "big") % dims * 2 + digest[4] % 2

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        sums = np.zeros((len(texts), dims))
        for i, text in enumerate(texts.to_pylist()):
            tokens = tokens_of(text or "")
            fresh = set(tokens).difference(known)
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = set(tokens)
            known.update((t, code(t)) for t in fresh)
            count = np.bincount(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)), minlength=2 * dims).reshape(dims, 2)
            sums[i] = count[:, 0] - count[:, 1]
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        units = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
        lost = pa.array(~texts.is_valid().to_numpy(zero_copy_only=False)) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * dims, pa.int32()), pa.array(units.ravel()), mask=lost)

    return run


def hash_embedding(text: Column, dims: int = 8) -> Column:
    """A unit vector that adds a signed one for each normalised token; zeros without tokens, null for null.

    The token's SHA-256 gives the place (first four bytes modulo ``dims``) and the sign
    (parity of the fifth byte: even is plus).  It runs over Arrow batches, where each distinct
    token is hashed once.
    """
    return _hashed_units(dims)(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector, an error for unequal lengths."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def value(x: Column, y: Column) -> Column:
        norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        angle = F.when(norms == 0, F.lit(0.0)).otherwise(dot(x, y) / F.nullif(norms, F.lit(0.0)))
        return F.when(F.size(x) == F.size(y), angle).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))

    # the struct is a binding: each vector is computed once
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: value(p["a"], p["b"]))[0]


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)), never below 0; 0 without documents or hits."""
    return F.when((n > 0) & (df > 0), F.greatest(F.lit(0.0), F.log(1 + (n - df + 0.5) / (df + 0.5)))).otherwise(F.lit(0.0))


def bm25_term(tf: Column, dl: Column, avgdl: Column, idf_: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """One term's part of the score; 0 where the term is absent."""
    length = 1 - b + b * dl / F.nullif(avgdl, F.lit(0.0))
    return F.when(tf > 0, idf_ * tf * (k1 + 1) / (tf + k1 * length)).otherwise(F.lit(0.0))
