"""Chunkers: order-dependent folds over arrays, one row at a time, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ARROW_BYTES, ARROW_ROWS, small_batches


def strip(text: Column) -> Column:
    # one match, not one try at every character
    return F.regexp_extract(text, r"(?Us)^\s*((?:.*\S)?)", 1)


def _fold(units: Column, begin: Column, step, finish) -> Column:
    return F.aggregate(units, begin, step, finish)


def pack(units: Column, most: int, join: str = " ") -> Column:
    """Greedy packing: a unit joins the current piece while both fit in ``most`` characters.

    Units are not split; empty ones are skipped.  Pieces are kept as an array and the
    current one as text, so the cost does not grow with the square of the text.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, u: Column) -> Column:
        full = F.length(acc["cur"]) + F.length(u) + len(join) > most
        return (
            F.when(u == "", acc)
            .when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), u.alias("cur")))
            .when(full, F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), u.alias("cur")))
            .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(join), u).alias("cur")))
        )

    return _fold(units, state, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def chunk_text(text: Column, most: int = 700, between: str = r"\n(?U)\s*\n") -> Column:
    """array<struct<body, start_char, end_char>>: paragraphs packed with blank lines between.

    A longer paragraph stays whole.  start_char is where the first paragraph stands (from
    0); end_char adds the length of the packed body, whose separators may be shorter
    than those in the text.
    """
    paragraphs = F.filter(F.transform(F.split(text, between), strip), lambda p: p != "")
    state = F.struct(
        F.array().cast("array<struct<body:string,start_char:int,end_char:int>>").alias("done"),
        F.lit(None).cast("string").alias("cur"),
        F.lit(0).alias("at"),
        F.lit(1).alias("cursor"),
    )

    def piece(acc: Column) -> Column:
        return F.struct(acc["cur"].alias("body"), acc["at"].alias("start_char"), (acc["at"] + F.length(acc["cur"])).cast("int").alias("end_char"))

    def step(acc: Column, p: Column) -> Column:
        found = F.call_function("locate", p, text, acc["cursor"])
        after = (found + F.length(p)).cast("int")
        start = (found - 1).cast("int")
        return (
            F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), p.alias("cur"), start.alias("at"), after.alias("cursor")))
            .when(
                F.length(acc["cur"]) + 2 + F.length(p) > most,
                F.struct(F.concat(acc["done"], F.array(piece(acc))).alias("done"), p.alias("cur"), start.alias("at"), after.alias("cursor")),
            )
            .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit("\n\n"), p).alias("cur"), acc["at"].alias("at"), after.alias("cursor")))
        )

    return _fold(paragraphs, state, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(piece(acc)))))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])(?U)\s+")


def pieces(text: Column, variant: str) -> Column:
    """Pieces of a plain transcript.

    a: paragraphs at blank lines, packed to 1200 characters each on its own, 10 at least.
    b: lines packed to 1200 characters across, 20 at least.
    c: lines packed to 1000 characters across, of any length.
    A paragraph over 1800 characters is cut at sentence ends first.
    """
    def units(p: Column) -> Column:
        return F.transform(F.when(F.length(p) > 1800, sentences(p)).otherwise(F.array(p)), strip)

    if variant == "a":
        parts = F.filter(F.transform(F.split(text, r"\n(?U)\s*\n+"), lambda p: F.regexp_replace(strip(p), r"(?U)\s+", " ")), lambda p: p != "")
        return F.filter(F.flatten(F.transform(parts, lambda p: pack(units(p), 1200))), lambda x: F.length(x) >= 10)
    parts = F.filter(F.transform(F.split(text, r"\n+"), strip), lambda p: p != "")
    packed = pack(F.flatten(F.transform(parts, units)), 1200 if variant == "b" else 1000)
    return F.filter(packed, lambda x: F.length(x) >= 20) if variant == "b" else packed


def proportional(parts: Column, seconds: Column) -> Column:
    """array<struct<start_ms, end_ms, body>>: times in proportion to lengths.

    A piece begins where the last ended and takes a second at least; the last ends with
    the whole, of a millisecond at least.
    """
    total_ms = F.greatest(seconds.cast("long") * 1000, F.lit(1).cast("long"))
    chars = F.greatest(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.length(x)), F.lit(1).cast("long"))
    state = F.struct(
        F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,body:string>>").alias("done"),
        F.lit(0).cast("long").alias("seen"),
        F.lit(0).cast("long").alias("last"),
    )

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + F.length(x)
        ends = F.when(F.size(acc["done"]) == F.size(parts) - 1, total_ms).otherwise(
            F.greatest(acc["last"] + 1000, F.floor(total_ms * seen / chars).cast("long"))
        )
        return F.struct(F.concat(acc["done"], F.array(F.struct(acc["last"].alias("start_ms"), ends.alias("end_ms"), x.alias("body")))).alias("done"), seen.alias("seen"), ends.alias("last"))

    return _fold(parts, state, step, lambda acc: acc["done"])


def split_cue(body: Column, start_ms: Column, end_ms: Column, most: int = 1200, longest_ms: int = 90_000) -> Column:
    """array<struct<start_ms, end_ms, body>>: equal slices of a cue that is too long in characters or time."""
    span = F.greatest(end_ms - start_ms, F.lit(0)).cast("long")
    parts = F.greatest(F.lit(1), F.ceil(F.length(body) / most), F.ceil(span / longest_ms)).cast("long")
    width = F.ceil(F.length(body) / parts)

    def piece(i: Column) -> Column:
        return F.struct(
            F.floor(start_ms + span * i / parts).cast("long").alias("start_ms"),
            F.floor(start_ms + span * (i + 1) / parts).cast("long").alias("end_ms"),
            F.trim(F.substring(body, (i * width + 1).cast("int"), width.cast("int"))).alias("body"),
        )

    whole = F.array(F.struct(start_ms.cast("long").alias("start_ms"), end_ms.cast("long").alias("end_ms"), body.alias("body")))
    cut = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), piece), lambda x: x["body"] != "")
    return F.when(parts == 1, whole).otherwise(cut)


def pack_cues(cues: Column, most: int = 1200, longest_ms: int = 90_000) -> Column:
    """Cues (start_ms, end_ms, body), in order, packed until characters or time would be exceeded."""
    kind = "array<struct<start_ms:bigint,end_ms:bigint,body:string>>"
    state = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<start_ms:bigint,end_ms:bigint,body:string>").alias("cur"))

    def step(acc: Column, c: Column) -> Column:
        cur = acc["cur"]
        full = (F.length(cur["body"]) + 1 + F.length(c["body"]) > most) | (c["end_ms"] - cur["start_ms"] > longest_ms)
        own = F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), c["body"].alias("body"))
        both = F.struct(cur["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), F.concat(cur["body"], F.lit(" "), c["body"]).alias("body"))
        return (
            F.when(cur.isNull(), F.struct(acc["done"].alias("done"), own.alias("cur")))
            .when(full, F.struct(F.concat(acc["done"], F.array(cur)).alias("done"), own.alias("cur")))
            .otherwise(F.struct(acc["done"].alias("done"), both.alias("cur")))
        )

    return _fold(cues, state, step, lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


#: The endings that close a sentence.
SENTENCE_ENDS = (".", "?", "!", ".”", '?"', '!"', ".'", "?'", "!'")


def ends_sentence(text: Column) -> Column:
    """Does the text, without white space after it, end as a sentence does?"""
    held = F.regexp_replace(text, r"(?U)\s+$", "")
    return reduce(lambda a, b: a | b, [F.endswith(held, F.lit(e)) for e in SENTENCE_ENDS])


class Windows:
    """Boundaries of overlapping windows over units of text, by binary search in prefix sums.

    ``place[i]`` counts the characters before unit i when all units are joined by single
    spaces, so the length of units a..b is place[b] - place[a] - 1.
    """

    def __init__(self, units: list[str], target: int, most: int, overlap: int) -> None:
        self.place = np.concatenate([[0], np.cumsum([len(u) + 1 for u in units])])
        closed = [i + 1 for i, u in enumerate(units) if u.rstrip().endswith(SENTENCE_ENDS)]
        self.closed = np.array(closed, np.int64)
        self.target, self.most, self.overlap = target, most, overlap
        self.enough = max(400, target * 65 // 100)

    def _first(self, begin: int, chars: int) -> int:
        """The first end with which a window from ``begin`` has so many characters at least."""
        return max(int(np.searchsorted(self.place, self.place[begin] + 1 + chars, "left")), begin + 1)

    def _last(self, begin: int, chars: int) -> int:
        """The last end with which it has so many at most; ``begin`` if none."""
        return max(int(np.searchsorted(self.place, self.place[begin] + 1 + chars, "right")) - 1, begin)

    def end(self, begin: int) -> int:
        """Where the window from ``begin`` ends.

        The first sentence end at target length or beyond; else, if units are left over,
        the last sentence end of sufficient length, the last one before the target, the
        first unit end beyond the target, or the last unit that fits.
        """
        units = len(self.place) - 1
        limit = max(self._last(begin, self.most), begin + 1)
        inside = self.closed[np.searchsorted(self.closed, begin, "right") : np.searchsorted(self.closed, limit, "right")]
        full = inside[inside >= self._first(begin, max(self.target, self.enough))]
        if len(full):
            return int(full[0])
        if limit == units:
            return units
        for fits in (inside[inside >= self._first(begin, self.enough)], inside[inside <= self._last(begin, self.target)]):
            if len(fits):
                return int(fits[-1])
        return min(self._first(begin, self.target), limit)

    def overlap_from(self, begin: int) -> int:
        """The unit from which the end of the window before is repeated: one unit at least, more while they fit."""
        if begin == 0 or self.overlap <= 0:
            return begin
        return min(int(np.searchsorted(self.place, self.place[begin] - 1 - self.overlap, "left")), begin - 1)


def windowed(units: Iterable[tuple[int | None, str]], target: int, most: int, overlap: int) -> Iterator[tuple]:
    """(start, body, overlap_chars) of the windows over one transcript's (start, text), as they come.

    A boundary depends on the units up to ``most`` characters on, so what is held is one window's
    units, one more, and those that the next window repeats.
    """
    held: list[tuple[int | None, str]] = []
    back = own = 0  # units repeated from before, and characters of the others

    def cut() -> tuple:
        nonlocal back, own
        whole = Windows([t for _, t in held], target, most, overlap)
        stop = whole.end(back)
        row = held[back][0], " ".join(t for _, t in held[:stop]), int(whole.place[back])
        first = whole.overlap_from(stop)
        own -= int(whole.place[stop] - whole.place[back])
        del held[:first]
        back = stop - first
        return row

    for start, text in units:
        held.append((start, text))
        own += len(text) + 1
        while own - 1 > most and len(held) - back > 1:
            yield cut()
    while len(held) > back:
        yield cut()


def overlapping(segments: DataFrame, target: int = 1800, most: int = 2400, overlap: int = 250) -> DataFrame:
    """(source, chunk, start_ms, body, overlap_chars) of segments (source, idx, start_ms, text).

    A transcript is cut into windows near ``target`` characters, at sentence ends where
    possible; each repeats the end of the one before.  start_ms is that of the first word
    (``word_ms``, if the segments have it) of the window's own part, else of its segment.
    The choice of a boundary looks back and ahead, so segments stream through a task in the order of
    Spark's sort; it holds a batch and a window, however long a transcript is.  Blank segments are left out.
    """

    def spoken(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for source, at, text in zip(*(b.column(c).to_pylist() for c in ("source", "at", "text"))):
                text = " ".join((text or "").split())
                if text:
                    yield source, at, text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for source, rows in groupby(spoken(batches), lambda r: r[0]):
            for chunk, (at, body, repeated) in enumerate(windowed((r[1:] for r in rows), target, most, overlap)):
                out.append((source, chunk, at, body, repeated))
                size += len(body)
                if len(out) == ARROW_ROWS or size > ARROW_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    names = ["source", "chunk", "start_ms", "body", "overlap_chars"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    small_batches(segments.sparkSession)
    at = F.coalesce("word_ms", "start_ms") if "word_ms" in segments.columns else F.col("start_ms")
    rows = segments.select(F.col("source").cast("long").alias("source"), "idx", at.cast("long").alias("at"), "text")
    dealt = rows.repartition("source").sortWithinPartitions("source", F.col("idx").asc_nulls_last(), "at", "text")
    return dealt.mapInArrow(run, "source long, chunk long, start_ms long, body string, overlap_chars long")


def nearest(anchors: DataFrame, words: DataFrame, tolerance: int = 1000) -> DataFrame:
    """(source, idx, start_ms, anchor_ms): the nearest word start of the same source within the tolerance.

    The words of neighbouring time cells alone are compared: an equi-join on
    (source, cell), not a product of all words and anchors.
    """
    width = tolerance + 1
    cells = anchors.withColumn("cell", F.explode(F.array(*[F.floor(F.col("start_ms") / width) + d for d in (-1, 0, 1)])))
    held = words.select(F.col("source").alias("s"), F.col("word_ms"), F.floor(F.col("word_ms") / width).alias("c"))
    near = cells.join(held, (F.col("source") == F.col("s")) & (F.col("cell") == F.col("c"))).where(F.abs(F.col("word_ms") - F.col("start_ms")) <= tolerance)
    best = near.groupBy("source", "idx").agg(F.min_by("word_ms", F.struct(F.abs(F.col("word_ms") - F.col("start_ms")), "word_ms")).alias("anchor_ms"))
    return anchors.join(best, ["source", "idx"], "left").select("source", "idx", "start_ms", "anchor_ms")
