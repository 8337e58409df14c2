"""Mixing of sources to target weights by soft membership, in DataFrame functions only.

1. A labelled table names the domain of some documents.  A multinomial naive Bayes
   model over its most telling words predicts domain posteriors for every document.
2. Every document has a rate r >= 0, its expected number of copies.  Projected
   gradient steps fit the rates so that the expected tokens of each domain,
   sum(r * tokens * posterior), meet the targets in the least-squares sense.

The gradient of a document depends on the others through the residual alone, one number
for each domain.  A step moves the documents that are not held at a bound against their
gradients, scaled by token counts, document by document, and by the inverse of the joint
token matrix of the domains over them, and projects onto the bounds.  One aggregation makes
that matrix, one more tries several damped steps at once and takes the best.  Steps lessen
the squared residuals until the targets are met or a bound by duality shows that
the rest cannot be met.
Rates follow from the last steps, which are kept as small literals; per-document state is
written every few rounds only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise, relieve

#: Labelled documents that the classifier reads at most, the first by hash of doc_id.
SAMPLE = 6000

#: Words in the classifier, the most telling ones: bounds what is broadcast.
VOCABULARY = 4096

#: Domains at most: a row of the joint token matrix for each comes to the driver.
MAX_DOMAINS = 64


#: Damping of the steps that are tried, as shares of the matrix's mean diagonal, and their lengths.
TRIED = ((1e-9, 1.0), (1e-4, 1.0), (1e-3, 1.0), (1e-2, 1.0), (1e-1, 1.0), (1e-1, 5.0), (1.0, 5.0), (1.0, 1.0))

#: How near a bound a document is held there if its gradient points outwards.
NEAR = 1e-3


def _words(text: str) -> str:
    return f"split(lower({text}), '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+')"


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> tuple[list[str], list[float], DataFrame]:
    """(domains, log priors, model): model has a row (word, logs), logs by domain.

    ``labelled`` has doc_id and domain.  Rows with nulls are left out; a document with
    several domains counts for each; of rows that share a doc_id the least text counts.
    Words count once a document.  Without labelled documents there are no domains.
    """
    known = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").select("doc_id", "domain").distinct()
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id"), F.col("text").alias("body")).join(F.broadcast(picked), "doc_id")
    rows = materialise(rows.groupBy("doc_id", "domain").agg(F.min("body").alias("body")), "mix-sample")
    sizes = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    total = sum(sizes.values())
    counts = (
        rows.select("domain", F.explode(F.array_distinct(F.expr(_words("body")))).alias("word"))
        .where("word <> ''")
        .groupBy("word", "domain")
        .agg(F.count("*").alias("n"))
    )
    wide = counts.groupBy("word").agg(*[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)] or [F.lit(0).alias("n0")])
    logs = [F.log((F.col(f"n{i}") + 0.5) / F.lit(float(sizes[d] + 1))) for i, d in enumerate(domains)]
    seen = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))
    mean = F.log((seen + 0.5) / F.lit(float(total + 1)))
    # how far the word's presence moves the posteriors of the documents that hold it
    gain = sum((F.col(f"n{i}") * F.abs(x - mean) for i, x in enumerate(logs)), F.lit(0.0))
    model = wide.where(seen >= 5).select("word", F.array(*[(x - mean) for x in logs] or [F.lit(0.0)]).alias("logs"), gain.alias("gain"))
    best = model.orderBy(F.desc("gain"), "word").limit(vocabulary).select("word", "logs")
    priors = [math.log(sizes[d] / total) for d in domains]
    return domains, priors, materialise(best, "mix-model")


def posteriors(docs: DataFrame, domains: list[str], priors: list[float], model: DataFrame) -> DataFrame:
    """row, tokens and p (array by domain) for all documents, beside doc_id.

    tokens counts words between ASCII white space.  A document without known words has
    the priors.  Evidence is averaged over the words and weighted as if it had
    a few dozen of them, so long documents keep soft memberships.
    """
    k = len(domains)
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.expr(_words("coalesce(text, '')")).alias("words"))
    each = rows.select("doc_id", "text_hash", F.explode(F.filter("words", lambda w: w != "")).alias("word"))
    # the vocabulary has a stated size
    found = each.join(F.broadcast(model), "word", "left").groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("tokens"), F.count("logs").alias("known"), *[F.sum(F.col("logs")[i]).alias(f"s{i}") for i in range(k)]
    )
    weight = F.least(F.col("known"), F.lit(30)) / F.greatest(F.col("known"), F.lit(1))
    logs = F.array(*[F.lit(priors[i]) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * weight for i in range(k)])
    found = found.withColumn("l", logs)
    found = found.withColumn("e", F.expr("transform(l, x -> exp(x - array_max(l)))"))
    return found.select(
        "doc_id", "text_hash", "tokens", F.expr("transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b))").alias("p")
    )


def _solve(matrix: list[list[float]], right: list[float], damping: float) -> list[float]:
    """Gaussian elimination with pivoting; ``damping`` is added to the diagonal."""
    n = len(right)
    a = [[*row, b] for row, b in zip(matrix, right)]
    for i in range(n):
        a[i][i] += damping
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return [a[i][n] / a[i][i] for i in range(n)]


#: Steps after which the rates are written, so that a rate folds over no more.
_WRITE = 16


def _array(values: list[float]) -> str:
    return "array(" + ", ".join(f"{x!r}D" for x in values) + ")"


def _dot(other: str) -> str:
    return f"aggregate(zip_with(p, {other}, (x, y) -> x * y), 0D, (a, b) -> a + b)"


def _held(rate: str, slope: str, most: float | None, least: float) -> tuple[str, str]:
    """SQL: is a document held at its lower bound, and at its upper one?"""
    high = "false" if most is None else f"{rate} >= {most - NEAR!r}D AND {slope} < 0"
    return f"{rate} <= {least + NEAR!r}D AND {slope} > 0", high


def _moved(rate: str, move: str, slope: str, most: float | None, least: float) -> str:
    """SQL of a rate after a step."""
    low, high = _held(rate, slope, most, least)
    free = f"greatest({least!r}D, {rate} - {move})"
    if most is None:
        return f"if({low}, {least!r}D, {free})"
    return f"CASE WHEN {low} THEN {least!r}D WHEN {high} THEN {most!r}D ELSE least({most!r}D, {free}) END"


def _rate(steps: list[tuple[list[float], list[float]]], most: float | None, least: float) -> str:
    """SQL of the rate after steps, each a move and the residuals that it answers, by domain."""
    if not steps:
        return "start"
    rows = ", ".join(f"named_struct('m', {_array(m)}, 'g', {_array(g)})" for m, g in steps)
    return f"aggregate(array({rows}), start, (r, s) -> {_moved('r', _dot('s.m'), _dot('s.g'), most, least)})"


def _totals(rate: str, k: int, name: str) -> list[Column]:
    return [F.expr(f"coalesce(sum({rate} * tokens * p[{i}]), 0D)").alias(f"{name}{i}") for i in range(k)]


def fit_rates(
    memberships: DataFrame, targets: list[float], rounds: int = 40, tolerance: float = 1e-6, most: float | None = None, least: float = 0.0
) -> tuple[DataFrame, list[float]]:
    """``memberships`` (tokens, p) with rate, and the relative residual of each domain.

    ``targets`` are token totals by position in p.  Steps end when every residual is within
    ``tolerance`` of the total target, when the sum of squared residuals is within 1 % of the
    least one, by a bound from duality, when no step lessens it, or after ``rounds``.
    ``most`` bounds rates above, ``least`` (0 or more) below.
    """
    targets = [float(t) for t in targets]
    k = len(targets)
    total = sum(targets) or 1.0
    names = [*(c for c in memberships.columns if c != "rate"), "rate"]
    begin = float(min(max(1.0, least), most if most is not None else 1.0 + least))
    state, steps = memberships.withColumn("start", F.lit(begin)), []
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    first = state.agg(*_totals("start", k, "t")).first()
    residual = [float(first[f"t{i}"]) - targets[i] for i in range(k)]

    for turn in range(rounds):
        relieve(memberships.sparkSession)  # a round's plans are large, and most rounds write nothing
        rated = state.withColumn("rate", F.expr(_rate(steps, most, least)))
        if len(steps) >= _WRITE:
            state, steps = materialise(rated.withColumn("start", F.col("rate")).drop("rate"), "mix-state"), []
            rated = state.withColumn("rate", F.col("start"))
        squares = sum(x * x for x in residual)
        if max((abs(x) / total for x in residual), default=0.0) <= tolerance:
            break
        if turn % 4 == 3 and _excess(rated, targets, residual, most, least) <= 0.01 * squares:
            break
        slope = _dot(_array(residual))
        low, high = _held("rate", slope, most, least)
        sums = rated.where(f"NOT ({low}) AND NOT ({high})").agg(*[F.expr(f"coalesce(sum(tokens * p[{i}] * p[{j}]), 0D)").alias(f"g{i}_{j}") for i, j in cells]).first()
        matrix = [[float(sums[f"g{min(i, j)}_{max(i, j)}"]) for j in range(k)] for i in range(k)]
        mean = max(sum(matrix[i][i] for i in range(k)) / max(k, 1), 1e-9)
        moves = [[length * x for x in _solve(matrix, residual, damping * mean)] for damping, length in TRIED]
        tried = rated.select("tokens", "p", *[F.expr(_moved("rate", _dot(_array(m)), slope, most, least)).alias(f"c{j}") for j, m in enumerate(moves)])
        sums = tried.agg(*[x for j in range(len(moves)) for x in _totals(f"c{j}", k, f"t{j}_")]).first()
        left = [[float(sums[f"t{j}_{i}"]) - targets[i] for i in range(k)] for j in range(len(moves))]
        best = min(range(len(moves)), key=lambda j: sum(x * x for x in left[j]))
        if sum(x * x for x in left[best]) >= squares * (1 - 1e-12):
            break
        steps.append((moves[best], residual))
        residual = left[best]
    return state.withColumn("rate", F.expr(_rate(steps, most, least))).select(*names), [x / total for x in residual]


def _excess(rated: DataFrame, targets: list[float], residual: list[float], most: float | None, least: float) -> float:
    """How far, at most, the sum of squares lies above the optimum: its distance from a bound by duality."""
    slope = F.expr(_dot(_array(residual)))
    k = len(targets)
    if most is None:  # posteriors sum to 1, so a shift of all residuals lifts all slopes to 0 at least
        found = rated.agg(F.min(slope).alias("low"), *_totals("1D", k, "a")).first()
        y = [x + max(0.0, -float(found["low"] or 0.0)) for x in residual]
        bound = least * sum(v * float(found[f"a{i}"]) for i, v in enumerate(y))
    else:
        y = residual
        bound = float(rated.agg(F.coalesce(F.sum(F.col("tokens") * (least * F.greatest(slope, F.lit(0.0)) + most * F.least(slope, F.lit(0.0)))), F.lit(0.0)).alias("x")).first()["x"])
    return sum(x * x for x in residual) - 2 * (bound - sum(v * t for v, t in zip(y, targets))) + sum(v * v for v in y)


def mix_rates(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float] | None = None,
    budget: float | None = None,
    sample: int = SAMPLE,
    vocabulary: int = VOCABULARY,
    most: float | None = None,
    least: float = 0.0,
    totals: Callable[[dict[str, float]], dict[str, float]] | None = None,
    rounds: int = 40,
) -> DataFrame:
    """One row a document: doc_id, text_hash, tokens, domains, p, rate, copies and residuals.

    ``weights`` are target shares of tokens by domain (all alike if None; scaled to sum
    to 1; a domain left out gets 0).  ``budget`` is the total of expected tokens, by
    default that of the corpus.  ``totals`` replaces both: it makes the target token totals from
    the expected ones of the corpus.  ``copies`` rounds the rate at random by a hash of
    doc_id and text, so its mean is the rate.  Documents without tokens have rate 1 and
    the priors.  Rows equal in doc_id and text count together and share one result row.
    ``residuals`` says by how much of the total target each domain misses its own, the same in
    all rows.  Without domains, all rates are 1.
    """
    domains, priors, model = train(docs, labelled, sample, vocabulary)
    names = domains or ["all"]
    member = materialise(posteriors(docs, names, priors if domains else [0.0], model if domains else model.limit(0)), "mix-members")
    held = member.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[i]), F.lit(0.0)) for i in range(len(names))]).first()
    have = {d: float(x) for d, x in zip(names, held)}
    if totals is not None:
        wanted = totals(have)
    else:
        shares = {d: 1.0 if weights is None or not domains else float(weights.get(d, 0.0)) for d in names}
        wanted = {d: (budget or sum(have.values())) * s / (sum(shares.values()) or 1.0) for d, s in shares.items()}
    rated, missed = fit_rates(member, [float(wanted.get(d, 0.0)) for d in names], rounds, most=most, least=least)
    empty = docs.where("NOT coalesce(text, '') rlike '[^ \\t\\n\\x0B\\f\\r]'").select("doc_id", F.xxhash64("text").alias("text_hash")).distinct()
    total = sum(math.exp(x) for x in priors) or 1.0
    prior = F.array(*[F.lit(math.exp(x) / total) for x in priors] or [F.lit(1.0)])
    rest = empty.select("doc_id", "text_hash", F.lit(0).cast("long").alias("tokens"), prior.alias("p"), F.lit(1.0).alias("rate"))
    both = rated.select("doc_id", "text_hash", "tokens", "p", "rate").unionByName(rest)
    spread = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return both.select(
        "doc_id", "text_hash", "tokens", F.array(*[F.lit(d) for d in names]).alias("domains"), "p", "rate", F.floor(F.col("rate") + spread).cast("int").alias("copies"),
        F.array(*[F.lit(x) for x in missed]).alias("residuals"),
    )


def mixed(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with every row as many times as its ``copies`` in ``rates`` (of mix_rates) say.

    All columns stay, whatever their names.
    """
    held = rates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "copies").where("copies > 0")
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = body.join(held, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("t")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
