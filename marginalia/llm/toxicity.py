"""Toxicity: a sparse logistic model whose scores do not hang on who is named.

Features are the presence of words, of word beginnings and of word pairs' hashes
(2**HASH_BITS slots).  For every labelled text that names a group, a counterpart with
the identity terms swapped is made; training adds to the log loss

    counterfactual * mean((z(text) - z(counterpart))**2) + sparsity * |weights|_1

so a weight that differs between groups is paid for, while the sparse weights leave the
noise of long neutral texts at zero.  Labels are read from a sample of stated size; the
fitted weights have a fixed size and go out by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, materialise, own_names, plain_names, relieve, small_batches, trim
from .textvec import ALNUM, PrefixHash, blocks, flat, mix, words

_U = np.uint64

#: Slots for hashed features.
HASH_BITS = 18

#: Texts of each label that a fit reads at most: a stated sample, taken by a hash of doc_id.
SAMPLE = {1: 2500, 0: 5000}

#: Bytes of these texts, of each label, that come to the driver at most: whole texts in the order of the sample.
SAMPLE_BYTES = 16_000_000

#: Groups of terms that may stand for one another (a parameter; these are plain examples).
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("she", "he"),
    ("christian", "muslim", "jewish", "hindu", "buddhist"),
    ("christians", "muslims", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("young", "old"),
    ("deaf", "blind", "disabled"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
)


def _word_hash(terms: list[str]) -> np.ndarray:
    data, off = flat(pa.array(terms))
    return mix(PrefixHash(data).of(off[:-1], off[1:]))


def features(texts: pa.Array, swap: dict[int, int] | None = None, named: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature slots of every text: (slots, n+1 offsets, texts with an identity term).

    With ``swap``, identity terms count as their counterparts; with ``named`` they are
    only reported.  Whole words are compared.
    """
    data, off = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    slots, sizes, changed = [], [], []
    low = _U((1 << HASH_BITS) - 1)
    known = swap or named or {}
    keys = np.array(sorted(known), _U)
    values = np.array([known[int(k)] for k in keys], _U)
    for i, j in blocks(off):
        sub, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
        start, end, count = words(sub, cut, ALNUM)
        prefix = PrefixHash(sub)
        whole = mix(prefix.of(start, end))
        doc = np.repeat(np.arange(j - i), count)
        hit = np.zeros(len(whole), bool)
        if len(keys) and len(whole):
            at = np.minimum(np.searchsorted(keys, whole), len(keys) - 1)
            hit = keys[at] == whole
            if swap:
                whole = np.where(hit, values[at], whole)
        changed.append(np.bincount(doc[hit], minlength=j - i) > 0)
        parts, owners = [whole], [doc]
        for k in (4, 5, 6):
            some = np.flatnonzero((end - start > k) & ~(hit & bool(swap)))
            parts.append(mix(prefix.of(start[some], start[some] + k) + _U(k)))
            owners.append(doc[some])
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        parts.append(mix(whole[pair] * _U(3) + whole[pair + 1]))
        owners.append(doc[pair])
        key = np.unique(np.concatenate(owners).astype(_U) << _U(HASH_BITS) | (np.concatenate(parts) & low))
        slots.append((key & low).astype(np.int64))
        sizes.append(np.bincount((key >> _U(HASH_BITS)).astype(np.int64), minlength=j - i))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (
        np.concatenate(slots) if slots else np.zeros(0, np.int64),
        np.concatenate([[0], np.cumsum(size)]),
        np.concatenate(changed) if changed else np.zeros(0, bool),
    )


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def _evidence(a: np.ndarray, seen: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of each slot's presence against the label.

    ``a`` and ``seen`` count the texts of label 1, and all texts, that have the slot.
    """
    n, pos = len(y), float(y.sum())

    def part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    rest, share = n - seen, pos / n
    return 2 * (part(a, seen * share) + part(seen - a, seen * (1 - share)) + part(pos - a, rest * share) + part(rest - pos + a, rest * (1 - share)))


@dataclass
class Model:
    """Weights of the slots and the intercept."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        slot, off, _ = features(texts)
        z = _sums(self.weights[slot], off) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[int, int]:
    """Word hash of every identity term -> that of the next in its group."""
    out: dict[int, int] = {}
    for group in groups:
        h = [int(x) for x in _word_hash(list(group))]
        out.update(zip(h, h[1:] + h[:1]))
    return out


def fit(texts: list[str], labels: list[int], **how) -> Model:
    """``fitted``, after which the driver gives back the memory that the fit took."""
    model = fitted(texts, labels, **how)
    trim()
    return model


def fitted(
    texts: list[str],
    labels: list[int],
    groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    counterfactual: float = 1.0,
    sparsity: float = 2e-4,
    rounds: int = 150,
    evidence: float = 15.0,
    threshold: float = 0.7,
) -> Model:
    """Fit by accelerated proximal gradient (deterministic).

    Only slots whose likelihood-ratio statistic with the label reaches ``evidence`` take
    part (all of them if none does).  Classes weigh alike.  The intercept is set so that
    the best cut on the fitted texts falls on ``threshold``.  Without texts of both labels the model gives one score, the
    share of label 1, to all texts (0 without texts).
    """
    y = np.array(labels, float)
    n = len(y)
    swap = swaps(groups)
    if not n or y.min() == y.max():
        share = min(max(y.mean() if n else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << HASH_BITS), float(np.log(share / (1 - share))))
    # two passes over batches of texts: all slots are counted, then the telling ones alone are kept
    a, seen = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    moved = np.zeros(n, bool)

    def slots_of(rows: np.ndarray, **how) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(rows), 128):
            part = rows[i : i + 128]
            slot, off, changed = features(pa.array([texts[k] or "" for k in part], pa.large_string()), **how)
            yield slot, np.repeat(part, np.diff(off)), changed

    def kept(rows: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray]:
        found = [(place[slot], row) for slot, row, _ in slots_of(rows, **how)]
        slots = [p[p >= 0] for p, _ in found] or [np.zeros(0, np.int64)]
        owners = [r[p >= 0] for p, r in found] or [np.zeros(0, np.int64)]
        return np.concatenate(slots).astype(np.int64), np.concatenate(owners).astype(np.int64)

    everything = np.arange(n)
    with np.errstate(over="ignore"):
        for i, (slot, row, changed) in enumerate(slots_of(everything, named=swap)):
            moved[128 * i : 128 * i + len(changed)] = changed
            a += np.bincount(slot, weights=y[row], minlength=1 << HASH_BITS)
            seen += np.bincount(slot, minlength=1 << HASH_BITS)
        used = np.flatnonzero(_evidence(a, seen, y) >= evidence)
        if not len(used):
            used = np.flatnonzero(seen)
        width = len(used)
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[used] = np.arange(width)
        slot, row = kept(everything)
        # only texts that name a group have a counterpart
        slot2, row2 = kept(np.flatnonzero(moved), swap=swap)
    pairs = max(int(moved.sum()), 1)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    # columns scaled by their frequency keep the step size independent of text length
    scale = 1 / np.sqrt(np.bincount(slot, weights=weight[row], minlength=width) + 1e-3)

    def product(w: np.ndarray, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.bincount(r, weights=w[s], minlength=n)

    def gradient(v: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        w = v * scale
        z = product(w, slot, row) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = np.bincount(slot, weights=g[row], minlength=width)
        if counterfactual and moved.any():
            d = np.where(moved, z - b - product(w, slot2, row2), 0.0) * (2 * counterfactual / pairs)
            grad += np.bincount(slot, weights=d[row], minlength=width) - np.bincount(slot2, weights=d[row2], minlength=width)
        return grad * scale, float(g.sum())

    # largest curvature by power iteration
    x = np.ones(width)
    top = 1.0
    for _ in range(12):
        w = x * scale
        z = product(w, slot, row)
        h = np.bincount(slot, weights=(0.25 * weight * z)[row], minlength=width)
        if counterfactual and moved.any():
            d = np.where(moved, z - product(w, slot2, row2), 0.0) * (2 * counterfactual / pairs)
            h += np.bincount(slot, weights=d[row], minlength=width) - np.bincount(slot2, weights=d[row2], minlength=width)
        x = h * scale
        top = float(np.linalg.norm(x))
        x /= top or 1.0
    step = 1 / (1.1 * top + 0.5)
    v = u = np.zeros(width)
    b = c = 0.0
    t = 1.0
    for _ in range(rounds):
        grad, slope = gradient(u, c)
        moved_v = u - step * grad
        new = np.sign(moved_v) * np.maximum(np.abs(moved_v) - step * sparsity * scale, 0)
        new_b = c - step * slope
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / t2 * (new - v), new_b + (t - 1) / t2 * (new_b - b)
        v, b, t = new, new_b, t2
    weights = np.zeros(1 << HASH_BITS)
    weights[used] = v * scale
    # put the cut that parts the labels best (the middle of its plateau) at the threshold
    z = product(v * scale, slot, row) + b
    order = np.argsort(z, kind="stable")
    gain = np.concatenate([[0.0], np.cumsum(np.where(y[order] > 0, -1 / y.sum(), 1 / (n - y.sum())))])
    zs = np.concatenate([[z.min() - 1], z[order], [z.max() + 1]])
    gain[1:-1][zs[1:-2] == zs[2:-1]] = -np.inf  # no cut between equal scores
    best = int(np.argmax(gain))
    cut = (zs[best] + zs[best + 1]) / 2
    return Model(weights, float(b + np.log(threshold / (1 - threshold)) - cut))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: dict[int, int] | None = None, most_bytes: int = SAMPLE_BYTES
) -> tuple[list, list]:
    """Texts and labels of at most ``sample[l]`` documents of each label l, the first by hash of doc_id.

    Rows with a null label, doc_id or text are left out; a doc_id labelled more than once
    counts once, with the larger label; of rows that share a doc_id the least text counts.
    Of each label, the first texts that ``most_bytes`` hold together are taken, whole.
    """
    sample = sample or SAMPLE
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked = None
    for value, most in sample.items():
        one = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = one if picked is None else picked.unionByName(one)
    # a few thousand ids at most: the sizes in ``sample`` bound what is broadcast
    rows = docs.where("text IS NOT NULL").select("doc_id", F.col("text").alias("body")).join(F.broadcast(picked), "doc_id")
    rows = materialise(rows.groupBy("doc_id", "label").agg(F.min("body").alias("body")), "toxic-sample")
    # as many short rows as the sample has, then the texts, one file of them at a time
    sizes = rows.select("doc_id", "label", F.octet_length("body").alias("bytes")).orderBy("label", F.xxhash64("doc_id"), "doc_id").collect()
    taken, upto = set(), {}
    for r in sizes:
        upto[r.label] = upto.get(r.label, 0) + r.bytes
        if upto[r.label] <= most_bytes:
            taken.add((r.doc_id, r.label))
    found = sorted((r.doc_id, r.body, r.label) for r in rows.select("doc_id", "body", "label").toLocalIterator() if (r.doc_id, r.label) in taken)
    relieve(docs.sparkSession, always=True)  # the JVM's copies go before the fit takes its own memory
    return [r[1] for r in found], [r[2] for r in found]


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    Only the text counts; null and empty texts get the score of the intercept.  Columns
    named score and predicted are replaced.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs, named = plain_names(docs.drop("score", "predicted"), "text")
    rest = docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                s = held.value.score(pc.fill_null(batch.column(at), ""))
                cols = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*rest, "score", "predicted"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in rest), "score double, predicted int"])
    return own_names(docs.mapInArrow(lean(run), schema), named)
