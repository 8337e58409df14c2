"""Quality: Bradley-Terry scores learned from preference pairs, cut at a quantile.

A text has a few measures of its form (``MEASURES``).  Each is read off a piecewise linear
curve whose knots are quantiles of the texts of either label, so a text's worth u is a sum of
curves and linear in their heights.  A text of label 1 is preferred to one of label 0;
the chance of that is 1 / (1 + exp(-(u - v))), and the heights minimise

    mean over pairs of log(1 + exp(-(u - v))) + ridge * |heights|**2

by Newton steps.  Pairs meet by hash buckets, about as many as the texts of the larger label,
so every labelled text takes part and no bucket grows.  A step is one aggregation over the
pairs, of which the driver sees a matrix of fixed size.

The cut is the quantile of the labelled texts' worth at the share of label 0 among them,
over all of them.  A score is the chance of being preferred to a text at the cut, on odds
moved so that the cut has the score ``threshold``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, materialise, small_batches
from .textvec import ALNUM, LOWER, NOT_SPACE, PrefixHash, blocks, flat, mix, words

_U = np.uint64

#: What is measured of a text, in this order.
MEASURES = (
    "log_words", "upper_share", "letter_share", "digit_share", "symbol_share", "stop_share", "bare_tokens", "short_words",
    "word_bytes", "log_line_bytes", "distinct_words", "distinct_pairs", "distinct_triples", "echoed_words", "repeated_lines",
)

#: Knots of a measure's curve that each label gives.
KNOTS = 6

#: Newton steps at most.
STEPS = 25

#: The smallest share of ranks by which the cut keeps away from the quantile on both sides.
MARGIN = 0.005


def _class(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(text.encode(), np.uint8)] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_STOP = _class(".,")
_SYMBOL = ~ALNUM & NOT_SPACE & ~_STOP & (np.arange(256) > 32)
_LETTER = ALNUM & ~_DIGIT
_IN_LINE = ~_class("\n")


def _distinct(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """How many different hashes (of 40 bits) each document has."""
    key = np.unique(doc.astype(_U) << _U(40) | h & _U((1 << 40) - 1))
    return np.bincount((key >> _U(40)).astype(np.int64), minlength=docs)


def measures(texts: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` a text; null counts as empty, and an empty text has all 0."""
    data, off = flat(texts)
    out = [np.zeros((0, len(MEASURES)))]
    with np.errstate(over="ignore"):
        for i, j in blocks(off):
            out.append(_measured(data[off[i] : off[j]], off[i : j + 1] - off[i]))
    return np.concatenate(out)


def _measured(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[off[1:]] - total[off[:-1]]

    letters = count(_LETTER)
    token, token_end, tokens = words(data, off, NOT_SPACE)
    owner = np.repeat(np.arange(n), tokens)
    inside = np.concatenate([[0], np.cumsum(ALNUM[data])])
    bare = np.bincount(owner[inside[token_end] == inside[token]], minlength=n)
    low = LOWER[data]
    prefix = PrefixHash(low)
    start, end, many = words(low, off, ALNUM)
    doc = np.repeat(np.arange(n), many)
    h = mix(prefix.of(start, end) + (end - start).astype(_U))
    some = np.maximum(many, 1)
    two = np.flatnonzero(doc[1:] == doc[:-1])
    three = np.flatnonzero(doc[2:] == doc[:-2])
    pair = mix(h[two] * _U(3) + h[two + 1])
    triple = mix(mix(h[three] * _U(3) + h[three + 1]) * _U(5) + h[three + 2])
    line, line_end, lines = words(data, off, _IN_LINE)
    row = np.repeat(np.arange(n), lines)
    lh = mix(prefix.of(line, line_end) + (line_end - line).astype(_U))
    cols = [
        np.log1p(tokens),
        count(_UPPER) / np.maximum(letters, 1),
        letters / size,
        count(_DIGIT) / size,
        count(_SYMBOL) / size,
        count(_STOP) / size,
        bare / np.maximum(tokens, 1),
        np.bincount(doc[end - start <= 3], minlength=n) / some,
        np.bincount(doc, weights=(end - start).astype(float), minlength=n) / some,
        np.log1p(np.diff(off) / np.maximum(lines, 1)),
        _distinct(doc, h, n) / some,
        _distinct(doc[two], pair, n) / np.maximum(many - 1, 1),
        _distinct(doc[three], triple, n) / np.maximum(many - 2, 1),
        np.bincount(doc[two][h[two] == h[two + 1]], minlength=n) / np.maximum(many - 1, 1),
        1 - _distinct(row, lh, n) / np.maximum(lines, 1),
    ]
    return np.where((np.diff(off) > 0)[:, None], np.stack(cols, axis=1), 0.0)


@dataclass
class Model:
    """Knots and heights of each measure's curve, the cut, and the one score that holds where nothing could be learned."""

    knots: list[list[float]]
    heights: list[list[float]]
    cut: float = 0.0
    only: float | None = None
    threshold: float = 0.3

    def worth(self, rows: np.ndarray) -> np.ndarray:
        return sum((np.interp(rows[:, m], k, h) for m, (k, h) in enumerate(zip(self.knots, self.heights))), np.zeros(len(rows)))

    def score(self, worth: Column) -> Column:
        if self.only is not None:
            return F.lit(float(self.only))
        odds = float(np.log(self.threshold / (1 - self.threshold)))
        return 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(self.cut - odds) - worth))))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def measured(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, and ``measures`` (array of double) for it, written to the shared folder.

    A column named measures is replaced.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "measures")]
    held = docs.select("text", *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column(0))
            flat_rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(MEASURES), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], flat_rows], names=[*batch.schema.names[1:], "measures"])

    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields[1:]), "measures array<double>"])
    done = materialise(held.mapInArrow(lean(run), kinds), "quality-measures")
    return done.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(rest)], "measures")


def labelled(rows: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label, measures) of the labelled documents, written to the shared folder.

    A doc_id that is labelled more than once counts once, with the larger label; of rows that
    share a doc_id the least measures count.  Null labels and doc_ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = rows.groupBy("doc_id").agg(F.min("measures").alias("measures"))
    return materialise(own.join(known, "doc_id").where("label IN (0, 1)"), "quality-labelled")


def _knots(known: DataFrame) -> list[list[float]]:
    at = ", ".join(f"{i / (KNOTS - 1)!r}D" for i in range(KNOTS))
    asked = [F.expr(f"percentile_approx(measures[{m}], array({at}), 10000)").alias(f"k{m}") for m in range(len(MEASURES))]
    rows = known.groupBy("label").agg(*asked).collect()
    out = []
    for m in range(len(MEASURES)):
        found = sorted({x for r in rows for x in r[f"k{m}"]})
        out.append(found if len(found) > 1 else [found[0], found[0] + 1.0])
    return out


def _spread(rows: np.ndarray, knots: list[list[float]]) -> np.ndarray:
    """Weights of the knots at each row's measures: what a curve through heights is linear in."""
    out = []
    for m, k in enumerate(knots):
        x = np.clip(rows[:, m], k[0], k[-1])
        out += [np.interp(x, k, np.eye(len(k))[i]) for i in range(len(k))]
    return np.stack(out, axis=1)


def pairs(known: DataFrame, good: int, poor: int) -> DataFrame:
    """(better, worse): measures of a text of label 1 and of one of label 0 that share a bucket.

    There are as many buckets as texts of the rarer label, so a bucket holds a few texts,
    and there are about as many pairs as texts of the other label.
    """
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("pair")), F.lit(max(min(good, poor), 1))).alias("bucket")
    one = known.where("label = 1").select(bucket, F.col("measures").alias("better"))
    other = known.where("label = 0").select(bucket, F.col("measures").alias("worse"))
    return one.join(other, "bucket").select("better", "worse")


def _sums(met: DataFrame, knots: list[list[float]], heights: np.ndarray) -> np.ndarray:
    """Gradient, curvature (upper triangle), loss and number of pairs, summed over all pairs."""
    width = len(heights)
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + len(upper[0]) + 2)
        for batch in batches:
            d = _spread(_rows(batch.column(0)), knots) - _spread(_rows(batch.column(1)), knots)
            z = d @ heights
            lost = 1 / (1 + np.exp(np.clip(z, -60, 60)))
            total[:width] -= lost @ d
            total[width:-2] += ((d * (lost * (1 - lost))[:, None]).T @ d)[upper]
            total[-2] += np.logaddexp(0, -z).sum()
            total[-1] += len(z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    found = met.mapInArrow(lean(run), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width + len(upper[0]) + 2)
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out


def fit(known: DataFrame, threshold: float = 0.3, ridge: float = 2e-4, tolerance: float = 1e-6) -> Model:
    """The model of ``labelled`` rows.

    With one label only, every text gets the share of label 1; without labels 0.5.
    """
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, poor = counts.get(1, 0), counts.get(0, 0)
    if not good or not poor:
        return Model([], [], only=good / (good + poor) if good + poor else 0.5, threshold=threshold)
    small_batches(known.sparkSession)
    knots = _knots(known)
    met = materialise(pairs(known, good, poor), "quality-pairs")
    width = sum(map(len, knots))
    upper = np.triu_indices(width)
    w = np.zeros(width)

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = _sums(met, knots, x)
        n = max(s[-1], 1.0)
        h = np.zeros((width, width))
        h[upper] = s[width:-2] / n
        h = h + np.triu(h, 1).T + 2 * ridge * np.eye(width)
        return s[-2] / n + ridge * float(x @ x), s[:width] / n + 2 * ridge * x, h

    loss, slope, curve = at(w)
    for _ in range(STEPS):
        step, length = np.linalg.solve(curve, slope), 1.0
        if float(slope @ step) < tolerance:
            break
        while length > 1e-3:
            new = at(w - length * step)
            if new[0] <= loss - 1e-4 * length * float(slope @ step):
                break
            length /= 2
        else:
            break
        w, (loss, slope, curve) = w - length * step, new
    heights, i = [], 0
    for k in knots:
        heights.append([float(x) for x in w[i : i + len(k)]])
        i += len(k)
    model = Model(knots, heights, threshold=threshold)
    model.cut = quantile_cut(with_worth(known.select("measures"), model), poor / (good + poor))
    return model


def with_worth(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (of measured) with ``worth`` in place of ``measures``."""
    small_batches(rows.sparkSession)
    rest = [c for c in rows.columns if c not in ("measures", "worth")]
    held = rows.select("measures", *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.worth(_rows(batch.column(0))))], names=[*batch.schema.names[1:], "worth"])

    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields[1:]), "worth double"])
    return held.mapInArrow(lean(run), kinds).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(rest)], "worth")


def quantile_cut(worths: DataFrame, share: float, margin: float = MARGIN) -> float:
    """The worth below which ``share`` of all rows lie: midway between the quantiles ``margin`` to either side.

    Where good and poor text stand apart, that is a value in the gap between them.
    """
    asked = ", ".join(f"{min(max(x, 0.0), 1.0)!r}D" for x in (share - margin, share + margin))
    row = worths.agg(F.expr(f"percentile_approx(worth, array({asked}), 10000)").alias("q")).first()
    return float(sum(row.q) / 2) if row.q else 0.0


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``docs`` without ``text``, with score (0 to 1) and predicted (1 from ``threshold`` on).

    Only the text counts, and ``labels`` (doc_id and the label's column) for learning.  Null and empty
    texts have the score of a text without words.  Every row stays, repeated ones too;
    columns named score, predicted, measures or worth are replaced.
    """
    drop = ("score", "predicted", "worth")
    rows = measured(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in drop]))
    model = fit(labelled(rows.select("doc_id", "measures"), labels, label), threshold)
    scored = with_worth(rows, model).withColumn("score", model.score(F.col("worth")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("worth")
