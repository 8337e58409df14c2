"""Words in passages that documents share: runs of ``size`` words that are in another document too.

Windows of ``size`` words meet as windows of bytes do in ``suffix_dedup``: by the least-hashed
group of words inside, their anchor, and the words of all consecutive windows of one anchor,
its context.  So:

1. anchors are counted; only those in more than one place go on;
2. a context that another document holds too is shared as a whole;
3. of anchors with several contexts, the windows of each context are compared by hash: of a
   shared context those in two of the documents, of others those in the one that holds it.

The texts are read once for each step and not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, materialise, small_batches
from .keyfilter import key_filter
from .textvec import NOT_SPACE, PrefixHash, anchors, blocks, flat, mix, words

_U = np.uint64

#: Bytes of texts handled at once.
_BYTES = 1 << 20

#: Stands for a null doc_id in keys; no id that tables count up to.
_NO_ID = -7046029254386353131


def _word_anchors(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """(row, first word, windows - 1, anchor, context, word hashes, place of the first word) of blocks of (doc_id, text_hash, body)."""
    data, off = flat(batch.column(2))
    for i, j in blocks(off, _BYTES):
        sub, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
        begin, end, count = words(sub, cut, NOT_SPACE)
        each = mix(PrefixHash(sub).of(begin, end) + (end - begin).astype(_U))
        at = np.concatenate([[0], np.cumsum(count)])
        first, last, _, h = anchors(each, at, size, max(size // 2, 1))
        again = PrefixHash(mix(each + _U(0x9E3779B97F4A7C15)))
        context = mix(again.of(first, last + size) + (last - first).astype(_U))
        row = np.searchsorted(at, first, "right") - 1
        yield row + i, first - at[row], last - first, h, context, again, first


def _key(ids: np.ndarray, texts: np.ndarray, h: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Of a context in one document, wherever it is there."""
    return mix(mix(mix(h + mix(context)) + ids.view(_U)) + texts.view(_U))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).fill_null(_NO_ID).to_numpy(), batch.column(1).to_numpy()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchors_alone(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for *_, h, _, _, _ in _word_anchors(batch, size):
                    yield pa.RecordBatch.from_arrays([_long(h)], names=["anchor"])

    return run


def _places(size: int, may_hold):
    """The rows of anchors that may be in several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, texts = _ids(batch)
                for row, start, more, h, context, _, _ in _word_anchors(batch, size):
                    on = np.flatnonzero(may_hold(h))
                    row, start, more, h, context = row[on], start[on], more[on], h[on], context[on]
                    pick = pa.array(row)
                    columns = [batch.column(0).take(pick), batch.column(1).take(pick), _long(h), _long(context)]
                    columns += [pa.array(start.astype(np.int32)), pa.array(more.astype(np.int32)), _long(_key(ids[row], texts[row], h, context))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "anchor", "context", "start", "more", "key"])

    return run


def _windows(size: int, may_hold):
    """Every window of the anchors' rows that may be among those to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, texts = _ids(batch)
                for row, start, more, h, context, hashes, first in _word_anchors(batch, size):
                    on = np.flatnonzero(may_hold(_key(ids[row], texts[row], h, context)))
                    many = more[on] + 1
                    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    place = np.repeat(first[on], many) + nth
                    pick = pa.array(np.repeat(row[on], many))
                    columns = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array((np.repeat(start[on], many) + nth).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, _long(mix(hashes.of(place, place + size)))], names=["doc_id", "text_hash", "start", "window"])

    return run


def _covered(spans: Column) -> Column:
    """Words inside the sorted (start, end) ranges, those in several counted once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    add = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["until"]))).alias("n"), F.greatest(acc["until"], x["end"]).alias("until")
    )
    return F.aggregate(spans, start, add, lambda acc: acc["n"].cast("long"))


def shared_words(rows: DataFrame, size: int = 51) -> DataFrame:
    """(doc_id, text_hash, n_shared_words) of the texts that share ``size`` words in a row with another.

    ``rows`` are (doc_id, text_hash, body); words are runs of other bytes than space and
    0x09-0x0D.  A word counts if any shared run holds it.  Texts are told apart by doc_id and
    text_hash, so rows equal in both are one document; what one document repeats by itself
    alone is not shared.  Windows of words, and the documents that hold one, are told apart by 64-bit hashes.
    """
    small_batches(rows.sparkSession)
    rows = rows.select("doc_id", "text_hash", "body").where(F.octet_length("body") >= 2 * size - 1)
    known = rows.mapInArrow(lean(_anchors_alone(size)), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    known = materialise(known, "passage-known")
    places = rows.mapInArrow(
        lean(_places(size, key_filter(known, F.col("anchor")))), "doc_id long, text_hash long, anchor long, context long, start int, more int, key long"
    )
    places = materialise(places, "passage-places")
    contexts = places.groupBy("anchor", "context").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    contexts = materialise(contexts, "passage-contexts")
    whole = places.join(contexts.where("lo < hi").select("anchor", "context"), ["anchor", "context"], "left_semi")
    spans = whole.select("doc_id", "text_hash", "start", (F.col("start") + F.col("more") + size).alias("end"))
    several = contexts.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1").select("anchor")
    asked = contexts.join(several, "anchor", "left_semi").select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key"))
    asked = materialise(asked, "passage-asked")
    windows = materialise(rows.mapInArrow(lean(_windows(size, key_filter(asked, F.col("key")))), "doc_id long, text_hash long, start int, window long"), "passage-windows")
    who = F.xxhash64("doc_id", "text_hash")
    met = windows.groupBy("window").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo < hi").select("window")
    met = windows.join(met, "window", "left_semi").select("doc_id", "text_hash", "start", (F.col("start") + size).alias("end"))
    found = spans.unionByName(met).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return found.select("doc_id", "text_hash", _covered(F.col("spans")).alias("n_shared_words"))
