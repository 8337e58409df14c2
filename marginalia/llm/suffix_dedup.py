"""Removal of byte strings that occur more than once, by hash-compared suffix sorting.

A window is ``size`` bytes.  Its anchor is the least-hashed k-gram inside, which depends
on the window's bytes alone: equal windows have equal anchors at equal offsets.  The
windows of one anchor are consecutive and their bytes, the anchor's context, hold at
most two window lengths.  So:

1. one pass gives (anchor hash, context digest) for every anchor of every text;
2. a context that occurs again is a repeat as a whole;
3. of anchors with several contexts, one row of each goes to a task, which sorts the
   suffixes that begin at the anchor: a mergesort whose comparisons find the common
   extension by binary search over prefix hashes.  The order of the suffixes beginning
   one byte further left follows by a stable sort on that byte.  Equal windows are
   neighbours in it; equality by hash is verified on the bytes;
4. an anchor with more contexts than one task should hold is split first.  Windows at
   nearby offsets from the anchor share a core of bytes, so the contexts are cut into
   pieces for offsets 0..w-1, w..2w-1 and so on, and meet by the bytes of the core.
   Whole pieces that recur are repeats, others are sorted as in 3; where one core still
   has too many, w is halved, down to single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, materialise, parallelism, small_batches
from .keyfilter import key_filter, parted
from .passages import shared_words
from .textvec import POS_BITS, PrefixHash, anchors, blocks, flat

#: Contexts of one anchor that are sorted together; more are split by the bytes around it.
GROUP_ROWS = 2_000

#: Contexts sorted together, over several anchors.
_SORT_ROWS = 4096

_ANCHORS = "doc_id long, text_hash long, anchor long, context long, start int, windows int, at int"


def _anchor_rows(size: int, k: int):
    names = ["doc_id", "text_hash", "anchor", "context", "start", "windows", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, off = flat(batch.column(2))
                for i, j in blocks(off, 1 << 19):
                    sub, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
                    first, last, at, h = anchors(sub, cut, size, k)
                    view = memoryview(np.ascontiguousarray(sub))
                    digest = b"".join(
                        [hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + size).tolist())]
                    )
                    doc = np.searchsorted(cut, first, "right") - 1
                    pick = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pick),
                            batch.column(1).take(pick),
                            pa.array(h.view(np.int64)),
                            pa.array(np.frombuffer(digest, np.int64)),
                            pa.array((first - cut[doc]).astype(np.int32)),
                            pa.array((last - first).astype(np.int32)),
                            pa.array((at - first).astype(np.int32)),
                        ],
                        names=names,
                    )

    return run


class _Sorter:
    """Suffixes of concatenated contexts, compared by hash."""

    def __init__(self, data: np.ndarray, end: np.ndarray) -> None:
        self.data, self.end, self.hash = data, end, PrefixHash(data)

    def common(self, a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray) -> np.ndarray:
        """Length of the common extension of data[a:ea] and data[b:eb], by binary search."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(ea - a, eb - b)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = self.hash.of(a, a + mid) == self.hash.of(b, b + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)

    def less(self, a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Is data[a:ea] before data[b:eb]?  Where they are equal, ``tie``."""
        n = self.common(a, ea, b, eb)
        x, y = a + n, b + n
        byte_x = np.where(x < ea, self.data[np.minimum(x, len(self.data) - 1)].astype(np.int16), -1)
        byte_y = np.where(y < eb, self.data[np.minimum(y, len(self.data) - 1)].astype(np.int16), -1)
        return np.where(byte_x == byte_y, tie, byte_x < byte_y)

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (equal numbers, adjacent), by mergesort."""
        n = len(start)
        order = np.arange(n)
        g0 = np.searchsorted(group, group, "left")
        g1 = np.searchsorted(group, group, "right")
        width, largest = 1, int((g1 - g0).max())
        here = np.arange(n)
        while width < largest:
            # each element looks up its place in the sibling run; ties keep the left run first
            run = (here - g0) // width
            left = run % 2 == 0
            sib = g0 + np.where(left, run + 1, run - 1) * width
            low = np.minimum(sib, g1)
            high = np.minimum(sib + width, g1)
            base = low.copy()
            s, e = start[order], self.end[order]
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) >> 1
                before = self.less(s[mid], e[mid], s[live], e[live], ~left[live])
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
            first = g0 + run // 2 * 2 * width
            to = first + (here - (g0 + run * width)) + (low - base)
            moved = np.empty_like(order)
            moved[to] = order
            order = moved
            width *= 2
        return order


def repeated_windows(contexts: list[bytes], at: list[int], group: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, left of the anchor, of the first and last repeated window of every context (-1: none).

    ``at`` is the anchor's place in its context; contexts of equal group number are adjacent.
    """
    n = len(contexts)
    lengths = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    end = np.cumsum(lengths)
    begin = end - lengths
    anchor = begin + np.array(at)
    least_o = np.maximum(anchor + size - end, 0)
    most_o = anchor - begin
    far, near = np.full(n, -1), np.full(n, -1)
    group_ = np.array(group)
    sorter = _Sorter(data, end)
    order = sorter.sort(anchor, group_)
    pairs: dict[tuple[int, int], list[int]] = {}
    for o in range(int(most_o.max()) + 1):
        if o:
            order = order[most_o[order] >= o]
            if len(order) < 2:
                break
            key = group_[order] * 256 + data[anchor[order] - o]
            order = order[np.argsort(key, kind="stable")]
        a, b = order[:-1], order[1:]
        both = np.flatnonzero((group_[a] == group_[b]) & (least_o[a] <= o) & (least_o[b] <= o))
        if not len(both):
            continue
        a, b = a[both], b[both]
        x, y = anchor[a] - o, anchor[b] - o
        same = np.flatnonzero(sorter.hash.of(x, x + size) == sorter.hash.of(y, y + size))
        for i, j in zip(a[same].tolist(), b[same].tolist()):
            seen = pairs.get((i, j))
            if seen is None:
                pairs[i, j] = [o, o]
            else:
                seen[1] = o
    view = memoryview(data)
    for (i, j), (o0, o1) in pairs.items():
        # a pair equal at two offsets is equal between them; the bytes decide
        ok = view[anchor[i] - o1 : anchor[i] - o0 + size] == view[anchor[j] - o1 : anchor[j] - o0 + size]
        for o in (o0, o1) if ok else [o for o in range(o0, o1 + 1) if view[anchor[i] - o : anchor[i] - o + size] == view[anchor[j] - o : anchor[j] - o + size]]:
            for c in (i, j):
                far[c] = max(far[c], o)
                near[c] = o if near[c] < 0 else min(near[c], o)
    return far, near


_FOUND = "doc_id long, text_hash long, start int, end int"


def _sort_rows(size: int):
    """Rows sorted by key (doc_id, text_hash, key, start, at, bytes) -> repeated byte ranges."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        names = {}
        group = [names.setdefault(r[2], len(names)) for r in rows]
        far, near = repeated_windows([r[5] for r in rows], [r[4] for r in rows], group, size)
        hit = np.flatnonzero(far >= 0).tolist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in hit], pa.int64()),
                pa.array([rows[i][1] for i in hit], pa.int64()),
                pa.array([rows[i][3] + rows[i][4] - int(far[i]) for i in hit], pa.int32()),
                pa.array([rows[i][3] + rows[i][4] - int(near[i]) + size for i in hit], pa.int32()),
            ],
            names=["doc_id", "text_hash", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if len(held) >= _SORT_ROWS and row[2] != held[-1][2]:
                        yield solve(held)
                        held = []
                    held.append(row)
            if held:
                yield solve(held)

    return run


def _sorted_spans(rows: DataFrame, size: int) -> DataFrame:
    """Repeated ranges among the rows (doc_id, text_hash, key, start, at, raw) that share a key."""
    dealt = rows.select("doc_id", "text_hash", "key", "start", "at", "raw").repartition(parallelism(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lean(_sort_rows(size)), _FOUND)


def _pieces(rows: DataFrame, size: int, width: int) -> DataFrame:
    """The rows cut into pieces for ``width`` offsets each, keyed by the bytes that all windows of a piece share."""
    least, j = F.greatest(F.col("at") + size - F.length("raw"), F.lit(0)), F.col("j")
    each = rows.withColumn("least", least).withColumn("j", F.explode(F.expr(f"sequence(least div {width}, at div {width})")))
    each = each.withColumn("far", F.least("at", (j + 1) * width - 1)).withColumn("near", F.greatest("least", j * width))
    core = f"substring(raw, cast(at - j * {width} + 1 AS int), {size - width + 1})"
    return each.select(
        "doc_id",
        "text_hash",
        F.expr(f"xxhash64(key, j, {core})").alias("key"),
        F.expr("cast(start + at - far AS int)").alias("start"),
        F.col("far").cast("int").alias("at"),
        F.expr(f"substring(raw, cast(at - far + 1 AS int), cast({size} + far - near AS int))").alias("raw"),
    )


def _split_spans(hot: DataFrame, size: int, group_rows: int) -> DataFrame:
    """Repeated ranges among contexts whose anchors have more of them than ``group_rows``."""
    width = 1 << max((size // 2).bit_length() - 1, 0)
    found = hot.sparkSession.createDataFrame([], _FOUND)
    while True:
        pieces = materialise(_pieces(hot, size, width), "repeat-pieces")
        alike = pieces.groupBy("key", F.md5("raw").alias("digest")).agg(
            F.count("*").alias("times"), F.min(F.struct("doc_id", "text_hash", "start", "at", "raw")).alias("row")
        )
        alike = materialise(alike, "repeat-alike")
        same = (F.col("key") == F.col("k")) & (F.md5("raw") == F.col("digest"))
        again = pieces.join(alike.where("times > 1").select(F.col("key").alias("k"), "digest"), same, "left_semi")
        found = found.unionByName(again.select("doc_id", "text_hash", "start", (F.col("start") + F.length("raw")).alias("end")))
        several = alike.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
        cut = alike.join(several, "key").select("key", "many", "row.*")
        if width == 1:
            return found.unionByName(_sorted_spans(cut, size))
        found = found.unionByName(_sorted_spans(cut.where(F.col("many") <= group_rows), size))
        hot = cut.where(F.col("many") > group_rows)
        if hot.isEmpty():
            return found
        width //= 2


def repeated_spans(docs: DataFrame, size: int = 400, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, text_hash, spans) for each text with bytes inside a repeated ``size``-byte string.

    ``spans`` is an array of (start, end) byte ranges that may overlap.  A string counts
    as repeated if it starts anywhere else, in the same text or another row.  Texts
    shorter than ``size``, empty and null ones have no row.  Rows equal in doc_id and
    text share one result row, made as if each was a text of its own.  ``size`` is at
    least 1 and at most half of what one anchor search covers (else ValueError).
    """
    if not 0 < size <= 1 << POS_BITS - 1:
        raise ValueError(f"size must be between 1 and {1 << POS_BITS - 1}")
    small_batches(docs.sparkSession)
    k = max(size // 8, 1)
    rows = _keyed(docs)
    long_enough = rows.where(F.octet_length("body") >= size)
    found = materialise(long_enough.mapInArrow(lean(_anchor_rows(size, k)), _ANCHORS), "repeat-anchors")
    # one row of each context; equal rows are summed before they are dealt out
    contexts = found.groupBy("anchor", "context").agg(
        F.count("*").alias("times"), F.min(F.struct("doc_id", "text_hash", "start", "windows", "at")).alias("row")
    )
    contexts = materialise(contexts, "repeat-contexts")
    again = contexts.where("times > 1").select("anchor", "context")
    whole = found.join(again, ["anchor", "context"], "left_semi").select(
        "doc_id", "text_hash", "start", (F.col("start") + F.col("windows") + F.lit(size)).alias("end")
    )
    # anchors with several contexts: bytes of one row of each
    several = contexts.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1")
    picked = contexts.join(several, "anchor").select(
        F.col("anchor").alias("key"), "many", F.col("row.doc_id").alias("d"), F.col("row.text_hash").alias("t"), "row.start", "row.windows", "row.at"
    )
    picked = materialise(picked, "repeat-picked")
    asked, _ = parted(rows.withColumn("h", F.xxhash64("doc_id", "text_hash")), key_filter(picked.select("d", "t").distinct(), F.xxhash64("d", "t")))
    cut = asked.join(picked, _same()).select(
        "doc_id", "text_hash", "key", "start", "at", F.expr(f"substring(cast(body AS binary), start + 1, windows + {size})").alias("raw"), "many"
    )
    spans = whole.unionByName(_sorted_spans(cut.where(F.col("many") <= group_rows), size))
    if not picked.where(F.col("many") > group_rows).isEmpty():
        spans = spans.unionByName(_split_spans(materialise(cut.where(F.col("many") > group_rows), "repeat-hot"), size, group_rows))
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _keyed(docs: DataFrame, *rest: str) -> DataFrame:
    """The texts with the key that joins go by; made alike everywhere, so that Spark deals them out once."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("body"), *rest)


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))


def _merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cleaned(batch: pa.RecordBatch, digest: bool) -> pa.RecordBatch:
    """(doc_id, text, spans, rest) -> what is left of each text."""
    out: list[tuple] = []
    for body, spans in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
        raw = body or b""
        gone = _merge(spans or [])
        kept, at = [], 0
        for a, b in gone:
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        left = b"".join(kept)
        text = None if body is None else left.decode("utf-8", "ignore")
        out.append((len(raw), len(raw) - len(left), len(gone), *([hashlib.sha256(left).hexdigest()] if digest else []), text))
    done = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)] + [pa.array([r[i] for r in out], pa.string()) for i in range(3, 4 + digest)]
    names = ["doc_id", *batch.schema.names[3:], "n_bytes", "n_removed", "n_spans", "kept", *(["text"] if digest else [])]
    return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], *done], names=names)


def _clean_rows(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cleaned(batch, digest)

    return run


def _clear_rows(digest: bool, may_hold: Callable[[np.ndarray], np.ndarray]):
    """(doc_id, text, h, rest) -> the texts that have no spans, as they are cleaned: by one worker, not one to sort them out and one to clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clear = batch.filter(pa.array(~may_hold(batch.column(2).to_numpy())))
            none = pa.nulls(clear.num_rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = [clear.column(0), clear.column(1), none, *clear.columns[3:]]
            yield _cleaned(pa.RecordBatch.from_arrays(columns, names=[*clear.schema.names[:2], "spans", *clear.schema.names[3:]]), digest)

    return run


def remove_repeats(docs: DataFrame, size: int = 400, group_rows: int = GROUP_ROWS, digest: bool = False, shared: int = 0) -> DataFrame:
    """The documents with every byte of a repeated ``size``-byte string removed.

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and ``kept``: the remaining
    text (a character cut by a removal goes too; null stays null) or, with ``digest``,
    the lowercase hex SHA-256 of the remaining bytes, beside that text as ``text``.
    With ``shared``, n_shared_words is added last: the text's words in runs of that many
    words that another document has too, whatever their bytes.  These are counted, not removed.
    Else ``text`` is left out; other columns stay, but for columns with the names that are added, which are replaced.
    Every row stays, whatever is left of it.
    """
    added = {"n_bytes", "n_removed", "n_spans", "kept", "spans", "text_hash"} | ({"n_shared_words"} if shared else set())
    rest = [c for c in docs.columns if c not in added | {"doc_id", "text"}]
    spans = repeated_spans(docs, size, group_rows)
    if shared:
        counted = shared_words(_keyed(docs), shared).select("doc_id", "text_hash", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "n_shared_words")
        spans = spans.withColumn("n_shared_words", F.lit(None).cast("long")).unionByName(counted)
        spans = spans.groupBy("doc_id", "text_hash").agg(F.first("spans", True).alias("spans"), F.max("n_shared_words").alias("n_shared_words"))
    spans = spans.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    spans = materialise(spans, "repeat-spans")
    held = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"rest_{i}") for i, c in enumerate(rest)])
    body = _keyed(held, *[f"rest_{i}" for i in range(len(rest))])
    # texts without repeats are not shuffled
    may_hold = key_filter(spans, F.xxhash64("d", "t"))
    body = body.withColumn("h", F.xxhash64("doc_id", "text_hash"))
    own = [F.col(f"rest_{i}").alias(c) for i, c in enumerate(rest)]
    near_own = own + ([F.coalesce("n_shared_words", F.lit(0).cast("long")).alias("n_shared_words")] if shared else [])
    near = parted(body, may_hold)[0].join(spans, _same(), "left").select("doc_id", "body", "spans", *near_own)
    kinds = {f.name: f.dataType.simpleString() for f in near.schema.fields}
    names = rest + (["n_shared_words"] if shared else [])
    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in names), "n_bytes long, n_removed long, n_spans long, kept string", *(["text string"] if digest else [])])
    clear_own = own + ([F.lit(0).cast("long").alias("n_shared_words")] if shared else [])
    clear = body.select("doc_id", "body", "h", *clear_own).mapInArrow(lean(_clear_rows(digest, may_hold)), schema)
    done = near.mapInArrow(lean(_clean_rows(digest)), schema).unionByName(clear)
    return done.select(*[F.col(f"`{c}`") for c in done.columns if c != "n_shared_words"], "n_shared_words") if shared else done
